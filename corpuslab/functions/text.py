"""Column functions over text: lines, titles, names, sizes and patterns written in Python's dialect."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"(?U)^\s+|\s+\z"


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode white space included."""
    return F.regexp_replace(text, _BLANK, "")


def lines(text: Column) -> Column:
    """Lines as a file reader gives them: no empty line after a final line feed."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def first_line(text: Column, most: int = 100, otherwise: str = "(no summary)") -> Column:
    """The first line that is not blank, without leading #, cut to `most` characters."""
    cleaned = F.transform(lines(text), lambda x: strip(F.regexp_replace(strip(x), r"^#+", "")))
    return F.coalesce(F.left(F.get(F.filter(cleaned, lambda x: x != ""), 0), F.lit(most)), F.lit(otherwise))


def summary(text: Column, most: int = 100, otherwise: str = "(no summary)") -> Column:
    """Like first_line, but neither code fences nor table rows count."""
    cleaned = F.transform(lines(text), lambda x: strip(F.regexp_replace(strip(x), r"^#+", "")))
    good = F.filter(cleaned, lambda x: (x != "") & ~F.startswith(x, F.lit("```")) & ~F.startswith(x, F.lit("|")))
    return F.coalesce(F.left(F.get(good, 0), F.lit(most)), F.lit(otherwise))


def slug(path: Column, most: int = 50) -> Column:
    """Name of a document from its path: the stem, other characters than word characters and - as _."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.left(F.regexp_replace(stem, r"(?U)[^\w　-鿿\-]", "_"), F.lit(most))


def size_label(n: Column) -> Column:
    """Bytes as B, KB or MB."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", n / (1024 * 1024)), F.lit(" MB")))
    )


def mermaid_id(name: Column) -> Column:
    base = F.regexp_replace(F.element_at(F.split(name, "/"), -1), "[^A-Za-z0-9_]", "_")
    return F.when(base == "", "unknown").otherwise(base)


def markdown_cell(value: Column) -> Column:
    return F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))


def safe_title(title: Column, most: int = 40) -> Column:
    """A title as part of a file name: runs of other characters than word characters and - are one _, cut to `most`."""
    return F.left(F.regexp_replace(F.regexp_replace(title, r"(?U)[^\w\-]+", "_"), "^_+|_+$", ""), F.lit(most))


# Languages by the extension of a file.
EXTENSIONS = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "jsx", "tsx": "tsx", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cs": "csharp",
    "java": "java", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "swift": "swift", "sh": "bash", "sql": "sql", "yaml": "yaml", "json": "json",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """Language of a file by its extension, else the extension."""
    names = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.element_at(names, extension(path)), extension(path))


def indent(text: Column) -> Column:
    """The unit of indentation: a tab where more lines begin with one than with spaces, else as many spaces as the least indented line has; empty if none is."""
    lead = F.transform(lines(text), lambda x: F.regexp_extract(x, r"^([ \t]*)\S", 1))
    tabs = F.size(F.filter(lead, lambda x: F.startswith(x, F.lit("\t"))))
    spaces = F.filter(lead, lambda x: F.startswith(x, F.lit(" ")))
    least = F.array_min(F.transform(spaces, lambda x: F.length(F.regexp_extract(x, "^( +)", 1))))
    return F.when((tabs > 0) & (tabs >= F.size(spaces)), "\t").when(F.size(spaces) > 0, F.repeat(F.lit(" "), least)).otherwise("")


def comments(source: Column, most: int = 20) -> Column:
    """Up to `most` comments of a source text: docstrings of more than 10 characters, blocks of more than 5, lines of more than 10."""
    found = lambda pattern, group, least: F.filter(F.transform(F.regexp_extract_all(source, F.lit(pattern), F.lit(group)), strip), lambda x: F.length(x) > least)
    docs = F.concat(found('(?s)"""(.*?)"""', 1, 10), found("(?s)\'\'\'(.*?)\'\'\'", 1, 10))
    return F.slice(F.concat(docs, found(r"(?s)/\*(.*?)\*/", 1, 5), found(r"(?m)(?://|#)[ \t]*(.*)$", 1, 10)), 1, most)


def utf8_prefix(text: Column, most: int) -> Column:
    """The longest prefix of at most `most` bytes that ends between characters."""
    raw = F.encode(text, "UTF-8")
    # a character has four bytes at most, so one of these cuts is between two
    return F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, max(most - k, 0)).cast("string")) for k in range(4)])


def replace_unique(text: Column, old: str, new: str) -> Column:
    """Text with its one occurrence of `old` replaced; null where there are none or several, or nothing would change."""
    count = (F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / len(old)
    return F.when((count == 1) & F.lit(old != new), F.replace(text, F.lit(old), F.lit(new)))


def edit(text: Column, old: str, new: str) -> Column:
    """(text, error): `old` replaced where it is there once; else the text as it is and why: same, missing or several."""
    count = (F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / max(len(old), 1)
    error = F.when(F.lit(old == new), "same").when((F.lit(old) == "") | (count < 1), "missing").when(count > 1, "several")
    return F.struct(F.when(error.isNull(), F.replace(text, F.lit(old), F.lit(new))).otherwise(text).alias("text"), error.alias("error"))


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """A pattern of Python's dialect for Spark's functions.

    Unicode classes, a dot that stops at line feeds alone, named groups and \\Z
    carry over; conditional groups and named back references raise ValueError.
    """
    re.compile(pattern)
    if re.search(r"\(\?P=|\(\?\(", pattern):
        raise ValueError(f"no counterpart for a construct of {pattern!r}")
    out = re.sub(r"\(\?P<", "(?<", pattern)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)
    return ("(?d)(?iU)" if ignore_case else "(?d)(?U)") + out
