"""Line-first quality rules, in DataFrame functions only.

Every line of a text is judged by itself (navigation separators, symbol runs,
shouting, one word over and over, boilerplate phrases in proportion to the words).
A few words alone on a line may be a heading, verse, an item of a list or code, in
any script, so they fail only as a menu does: next to another such line, and within
three lines of one with separators or boilerplate.  Failed lines are removed; a
document that loses more than `max_lost` of the characters of its lines, or
fails the base counts, is rejected.

Null text counts as no words and is rejected; texts and lines of any length are
judged whole; rows are independent, so repeated rows, ties and null ids pass through
unchanged, an empty table gives an empty result, and further columns, whatever
their names, are kept unless `judge` adds one of that name (then the added one
replaces it).  Nothing is shuffled.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space that parts words, and symbols counted per document.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Patterns of the line rules, valid for Java's and RE2's dialects.
SEPARATOR = r"[|»›•·]"
SYMBOL_RUN = r"[#*$%&<>]"
SHOUT = r"[!?][!?]+"
PHRASES = [
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "subscribe to our", "sign up for", "click here",
    "read more", "enable javascript", "share this", "follow us on", "powered by", "lorem ipsum", "skip to content",
]
BOILERPLATE = "(?i)" + "|".join(PHRASES)
#: Words without any mark of a sentence, a list or code.
ITEM = r"^[\x20\x09]*[\p{L}\p{N}][\p{L}\p{M}\p{N}'&\x20-]*$"
#: A boilerplate phrase fails a line for each so many words of it; an item of a menu has so many words and characters at most, and so near a line of navigation.
BOILERPLATE_WORDS, ITEM_WORDS, ITEM_CHARS, NEAR = 20, 4, 40, 3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body) -> Column:
    """Evaluates `value` once and passes it to `body` as a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, GAP)).otherwise(F.array().cast("array<string>"))


def repeated_words(words: Column, size: int = 5) -> Column:
    """Number of words that lie in a window of `size` words found at least twice."""
    last = F.size(words) - size

    def covered(windows: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            before = F.when(k > 0, F.get(windows, k - 1)["w"] == x["w"])
            after = F.get(windows, k + 1)["w"] == x["w"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        spans = F.transform(F.filter(windows, twice), lambda x: F.sequence(x["i"], x["i"] + (size - 1)))
        return F.size(F.array_distinct(F.flatten(spans)))

    places = F.sequence(F.lit(0), last)
    hashes = F.transform(places, lambda i: F.xxhash64(F.slice(words, i + 1, size)))
    sortable = F.sort_array(F.transform(places, lambda i: F.struct(F.array_join(F.slice(words, i + 1, size), " ").alias("w"), i.alias("i"))))
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(last < 1, 0).when(some, let(sortable, covered)).otherwise(0)


def line_marks(line: Column, phrased: Column) -> Column:
    """(failed, navigation, item): whether a line fails by itself, is navigation or boilerplate, or may be an item of a menu; `phrased` tells whether a phrase may be in it."""

    def judge(words: Column) -> Column:
        n = F.size(words)
        separators = F.regexp_count(line, F.lit(SEPARATOR))
        symbols = F.regexp_count(line, F.lit(SYMBOL_RUN))
        shouts = F.regexp_count(line, F.lit(SHOUT))
        boilerplate = F.when(phrased, F.regexp_count(line, F.lit(BOILERPLATE)) * BOILERPLATE_WORDS >= F.greatest(n, F.lit(1))).otherwise(False)
        navigation = ((separators >= 2) & (separators * 4 >= n)) | boilerplate
        failed = ((symbols >= 2) & (symbols * 2 >= n)) | ((shouts >= 2) & (shouts * 3 >= n)) | ((n >= 10) & (F.size(F.array_distinct(words)) * 10 < n * 3))
        item = (n <= ITEM_WORDS) & (F.length(line) <= ITEM_CHARS) & F.rlike(line, F.lit(ITEM))
        return F.struct(failed.alias("failed"), navigation.alias("navigation"), item.alias("item"))

    return let(word_array(line), judge)


def line_verdicts(lines: Column, phrased: Column) -> Column:
    """Array of (line, failed)."""

    def judged(marks: Column) -> Column:
        is_ = lambda i, what: F.coalesce(F.get(marks, i)[what], F.lit(False))

        def verdict(x: Column, i: Column) -> Column:
            near = [is_(i + k, "navigation") for k in range(-NEAR, NEAR + 1) if k]
            menu = x["marks"]["item"] & (is_(i - 1, "item") | is_(i + 1, "item")) & functools.reduce(operator.or_, near)
            return F.struct(x["line"].alias("line"), (x["marks"]["failed"] | x["marks"]["navigation"] | menu).alias("failed"))

        return F.transform(F.zip_with(lines, marks, lambda a, m: F.struct(a.alias("line"), m.alias("marks"))), verdict)

    return let(F.transform(lines, lambda x: line_marks(x, phrased)), judged)


def judge(docs: DataFrame, text: str = "text", max_lost: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """Adds the base counts, base_failed, the line verdicts, clean_text and kept."""
    # the given columns stay together in one, so that no name of theirs meets one of these rules
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    out = out.withColumn("_words", word_array(F.col("_text")))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0))
    out = out.withColumn("_phrased", functools.reduce(operator.or_, [F.contains(F.lower("_text"), F.lit(p)) for p in PHRASES]))
    out = out.withColumn("_judged", line_verdicts(F.col("_lines"), F.col("_phrased")))
    long = lambda c: c.cast("long")
    lengths = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + F.length(x["line"]))
    out = out.withColumns(
        {
            "n_words": long(F.size("_words")),
            "word_chars": long(F.length(F.translate("_text", SPACES, ""))),
            "n_symbols": long(F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))),
            "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
            "n_repeat_words": long(repeated_words(F.col("_words"))),
            "n_lines": long(F.size("_lines")),
            "n_failed_lines": long(F.size(F.filter("_judged", lambda x: x["failed"]))),
            "line_chars": lengths(F.col("_judged")),
            "lost_chars": lengths(F.filter("_judged", lambda x: x["failed"])),
            "clean_text": F.array_join(F.transform(F.filter("_judged", lambda x: ~x["failed"]), lambda x: x["line"]), "\n"),
        }
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    out = out.withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.col("line_chars") * F.lit(max_lost)))
    added = [c for c in out.columns if not c.startswith("_")]
    return out.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in added], *added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept", "n_lines", "n_failed_lines", "line_chars", "lost_chars")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents (null and empty texts are) go; the others keep the lines that passed.

    n_chars, where there is such a column, is the length of the new text; rows of
    null or repeated ids and further columns, whatever their names, pass through; an
    empty table stays empty.

    A filter on `kept` would be pushed below the columns it is computed from, and
    compute them again inside their own lambdas; exploding the row of a kept
    document computes each column once.
    """
    judged = judge(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), "text"))
    cells = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        cells["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    row = F.struct(*(cells.get(c, F.col(f"given.`{c}`")).alias(c) for c in docs.columns))
    return judged.select(F.explode(F.when(F.col("kept"), F.array(row))).alias("x")).select("x.*")


_SQL_BOILERPLATE, _SQL_ITEM = BOILERPLATE, ITEM.replace("'", "''").replace("{", "{{").replace("}", "}}")

#: One row per document with the verdict of every line folded in.
SQL_JUDGED = rf"""
base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM {{source}}),
word_rows AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM base),
grams AS (
  SELECT r, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g
  FROM word_rows WINDOW o AS (PARTITION BY r ORDER BY i)),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams WHERE g IS NOT NULL),
repeats AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM windows WHERE n > 1) GROUP BY r),
each_line AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM base),
counted AS (
  SELECT r, k, line, regexp_extract_all(line, '{WORD}') AS w,
         len(regexp_extract_all(line, '{SEPARATOR}')) AS sep, len(regexp_extract_all(line, '{SYMBOL_RUN}')) AS sym,
         len(regexp_extract_all(line, '{SHOUT}')) AS sho
  FROM each_line),
marked AS (
  SELECT r, k, line,
         (sym >= 2 AND sym * 2 >= len(w)) OR (sho >= 2 AND sho * 3 >= len(w)) OR (len(w) >= 10 AND len(list_distinct(w)) * 10 < len(w) * 3) AS own,
         (sep >= 2 AND sep * 4 >= len(w)) OR len(regexp_extract_all(line, '{_SQL_BOILERPLATE}')) * {BOILERPLATE_WORDS} >= greatest(len(w), 1) AS navigation,
         len(w) <= {ITEM_WORDS} AND length(line) <= {ITEM_CHARS} AND regexp_matches(line, '{_SQL_ITEM}') AS item
  FROM counted),
judged AS (
  SELECT r, k, line,
         own OR navigation OR (item AND (coalesce(lag(item) OVER o, false) OR coalesce(lead(item) OVER o, false))
         AND max(CAST(navigation AS INT)) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN {NEAR} PRECEDING AND {NEAR} FOLLOWING) = 1) AS failed
  FROM marked WINDOW o AS (PARTITION BY r ORDER BY k)),
lost AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (failed) AS n_failed_lines, sum(length(line)) AS line_chars,
         coalesce(sum(length(line)) FILTER (failed), 0) AS lost_chars,
         string_agg(line, chr(10) ORDER BY k) FILTER (NOT failed) AS clean_text
  FROM judged GROUP BY r),
verdicts AS (
  SELECT b.r, doc_id, len(words) AS n_words, length(regexp_replace(text, '{GAP}', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines,
         coalesce(line_chars, 0) AS line_chars, coalesce(lost_chars, 0) AS lost_chars, coalesce(clean_text, '') AS clean_text
  FROM base b LEFT JOIN repeats USING (r) LEFT JOIN lost USING (r)),
decided AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * lost_chars <= line_chars AS kept
  FROM verdicts)"""

ORACLE = "WITH " + SQL_JUDGED.format(source="documents") + """
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, kept,
       CAST(n_lines AS BIGINT) AS n_lines, CAST(n_failed_lines AS BIGINT) AS n_failed_lines,
       CAST(line_chars AS BIGINT) AS line_chars, CAST(lost_chars AS BIGINT) AS lost_chars
FROM decided"""
