"""Personal data, with deobfuscation that keeps source offsets.

Detectors run on the text as it is (the base spans) and again behind a chain of
transducers, each of which reads what the one before it wrote: the first makes
look-alike characters ASCII and drops zero-width ones, the second makes "(at)"
and "dot" an @ and a dot, the third makes spelled digits digits.  Each keeps the source
span of every replacement, and the maps are composed, so what is found at the
end maps back to characters of the source.  What the first transducer shows is added
unless a base span of its kind holds all of it (an address whose first letter is a
look-alike is wider than its base span); what the others show, where no span of its
kind overlaps it.

Null text counts as empty and has no spans; empty texts too.  Every detector and
transducer is linear in the length of the text, which is read whole.  Rows are
independent: repeated rows, ties and null ids pass through, an empty table gives
an empty result, and an added column replaces one of its name.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.batches import bound

KINDS = ["email", "ip", "card", "phone"]

# The patterns of the base kinds, in forms that never look at a character twice per kind.
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_PRE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = start < at and _DOMAIN.match(text, at + 1)
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def detect(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end) of one text."""
    if not _PRE.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]  # first the length: a part can have millions of zeros
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# Letters of other scripts that look like ASCII ones.
LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТХаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρι",
        "ABEKMHOPCTXaeopcyxijsdhqwABEZHIKMNOPTYXovpi",
        strict=True,
    )
)
_HIDDEN = "­​‌‍⁠﻿"
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_ODD = rf"[{_HIDDEN}{''.join(LOOKALIKES)}٠-٩۰-۹०-९․⁰-⁹₀-₉①-⑨！-～\U0001d400-\U0001d7ff]"
_NUMBER = "(?:" + "|".join(DIGIT_WORDS) + ")"
_OPEN, _CLOSE = r"\s?[(\[{<]\s?", r"\s?[)\]}>]\s?"
_DOT_WORD = rf"(?:{_OPEN}(?:dot|\.){_CLOSE}|\sdot\s)"
#: What may stand between the parts of one number, at most three of them.
_GAP = r"[\s,().-]"
_FOLD = re.compile(_ODD)
#: What has to be somewhere in a text for the transducers of words to act.
_WORDS = re.compile(
    rf"[(\[{{<]\s?(?:at|@|dot|\.)\s?[)\]}}>]|\sdot\s"
    rf"|\b{_NUMBER}\b(?:{_GAP}{{1,3}}(?:[0-9]|{_NUMBER}\b)|\.[A-Za-z0-9])|[0-9+]{_GAP}{{0,3}}\b{_NUMBER}\b|[A-Za-z0-9]\.{_NUMBER}\b",
    re.IGNORECASE,
)
_SIGN = re.compile(
    rf"(?P<at>{_OPEN}(?:at|@){_CLOSE}|(?<=[A-Za-z0-9])\sat\s(?=[A-Za-z0-9-]{{1,64}}{_DOT_WORD}))"
    rf"|(?P<dot>(?<=[A-Za-z0-9]){_DOT_WORD}(?=[A-Za-z0-9]))",
    re.IGNORECASE,
)
_RUN = re.compile(rf"(?:\bplus\s)?\b{_NUMBER}(?:[\s,-]{{1,2}}{_NUMBER})*\b", re.IGNORECASE)
_SPELLED = re.compile(rf"plus\s|{_NUMBER}|[\s,-]+", re.IGNORECASE)
_LONG = re.compile(rf"(?:plus\s)?(?:{_NUMBER}[\s,-]{{1,2}}){{2}}", re.IGNORECASE)
_BETWEEN = re.compile(rf"{_GAP}{{0,3}}")
_BEFORE, _AFTER = re.compile(rf"(?:[0-9+]{_GAP}{{0,3}}|[A-Za-z0-9]\.)\Z"), re.compile(rf"{_GAP}{{0,3}}[0-9]|\.[A-Za-z0-9]")


def _plain(c: str) -> str:
    if c in _HIDDEN:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    plain = unicodedata.normalize("NFKC", c)
    if len(plain) == 1 and not plain.isascii() and plain.isdigit():
        plain = str(unicodedata.digit(plain))
    return plain if plain.isascii() else c


def _folds(text: str) -> Iterator[tuple[int, int, str]]:
    """Look-alike and hidden characters."""
    return ((m.start(), m.end(), _plain(m[0])) for m in _FOLD.finditer(text))


def _signs(text: str) -> Iterator[tuple[int, int, str]]:
    """Disguised @ and dots."""
    return ((m.start(), m.end(), "@" if m["at"] else ".") for m in _SIGN.finditer(text))


def _is_number(text: str, m: re.Match, before: re.Match | None, after: re.Match | None) -> bool:
    """Whether spelled digits are three at least, or touch a digit, a plus, a dot or other spelled digits; `before` and `after` are the runs next to them."""
    return bool(
        _LONG.match(m[0])
        or (before and _BETWEEN.fullmatch(text, before.end(), m.start()))
        or (after and _BETWEEN.fullmatch(text, m.end(), after.start()))
        or _BEFORE.search(text[max(0, m.start() - 4) : m.start()])
        or _AFTER.match(text[m.end() : m.end() + 4])
    )


def _digits(text: str) -> Iterator[tuple[int, int, str]]:
    """Spelled digits of numbers."""
    found = list(_RUN.finditer(text))
    for m, before, after in zip(found, [None, *found], [*found[1:], None], strict=False):
        if _is_number(text, m, before, after):
            for x in _SPELLED.finditer(text, m.start(), m.end()):
                word = x[0].lower()
                yield x.start(), x.end(), "+" if word[0] == "p" else DIGIT_WORDS.get(word, "")


class Transduced:
    """What a transducer made of a text, with the map back to it; `before` is what that text was made of."""

    def __init__(self, text: str, edits: Iterator[tuple[int, int, str]], before: Transduced | None = None):
        parts, self.edits, source, there = [], [], 0, 0
        for start, end, new in edits:
            parts += (text[source:start], new)
            there += start - source
            self.edits.append((there, there + len(new), start, end))
            there += len(new)
            source = end
        parts.append(text[source:])
        self.text, self.before = "".join(parts), before
        self.begins = [e[0] for e in self.edits]

    def _place(self, p: int, right: bool) -> int:
        k = last = bisect_right(self.begins, p) - 1
        while k >= 0 and self.edits[k][0] == self.edits[k][1]:
            k -= 1
        if k >= 0 and p < self.edits[k][1]:
            return self.edits[k][3 if right else 2]
        moved = self.edits[last][3] - self.edits[last][1] if last >= 0 else 0
        return p + moved + right

    def source(self, start: int, end: int) -> tuple[int, int]:
        """Span of the first text of the chain that the span start:end was made of."""
        a, b = self._place(start, False), self._place(end - 1, True)
        return self.before.source(a, b) if self.before else (a, b)


def normalise(text: str) -> tuple[Transduced, Transduced]:
    """The text behind the first transducer, and behind all of them."""
    folded = Transduced(text, _folds(text))
    signed = Transduced(folded.text, _signs(folded.text), folded)
    return folded, Transduced(signed.text, _digits(signed.text), signed)


def disguised(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the normalised text shows."""
    plain = text.isascii() or not _FOLD.search(text)
    if plain and not _WORDS.search(text):
        return []
    folded, last = normalise(text)
    held: dict[str, list[tuple[int, int]]] = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
    out = []
    if not plain:
        for kind, a, b in detect(folded.text):
            start, end = folded.source(a, b)
            if not _holds(held[kind], start, end):
                out.append((kind, start, end))
    taken = {k: sorted(held[k] + [(a, b) for kind, a, b in out if kind == k]) for k in KINDS}
    ends = {k: list(accumulate((b for _, b in spans), max)) for k, spans in taken.items()}
    for kind, a, b in detect(last.text) if last.edits or last.before.edits else ():
        start, end = last.source(a, b)
        before = bisect_left(taken[kind], (end,))  # spans that begin before the end
        if not before or ends[kind][before - 1] <= start:
            out.append((kind, start, end))
    return out


def _holds(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of some disjoint spans in order holds all of start:end; only the last that begins before the end can."""
    before = bisect_left(spans, (end,))
    return before > 0 and spans[before - 1][0] <= start and end <= spans[before - 1][1]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for text in batch:
            text = text or ""
            base = detect(text)
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + disguised(text, base))))
        yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def _masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
    def mask(text: str | None, joined: str) -> str | None:
        if not text or not joined:
            return text
        out, done, found = [], 0, [(int(a), -int(b), k) for k, a, b in (x.split(":") for x in joined.split(","))]
        for start, end, kind in sorted(found):  # of spans that begin alike the longest
            if start >= done:
                out += (text[done:start], f"[{kind.upper()}]")
            done = max(done, -end)
        return "".join(out) + text[done:]

    return pd.Series([mask(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone, base_sha256 and spans."""
    bound(docs.sparkSession)
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    scan = F.pandas_udf(_found, ", ".join(f"{n} {'long' if n.startswith('n_') else 'string'}" for n in names))
    held = max(["_found", *docs.columns], key=len) + "_"  # a name that no column has
    found = docs.withColumn(held, scan(F.col(text)))
    return found.withColumns({n: F.col(f"`{held}`.{n}") for n in names}).drop(held)


def masked(text: Column, spans: Column) -> Column:
    """Text with every span replaced by the name of its kind."""
    return F.pandas_udf(_masked, "string")(text, spans)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its personal data are replaced.

    Null texts stay null; n_chars, where there is such a column, is the length of
    the new text; rows of null or repeated ids and further columns, whatever their
    names, pass through; an empty table stays empty.
    """
    found = find(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text"))
    clean = found.withColumn("_clean", masked(F.col("text"), F.col("spans")))
    cells = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        cells["n_chars"] = F.length("_clean").cast(docs.schema["n_chars"].dataType)
    return clean.select(*(cells.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))
