"""Markdown from other formats: HTML, delimited tables and code files."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text as T

# What is left out, and marks around inline text.
_SKIP = frozenset("script style nav footer header aside".split())
_MARK = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
_HEAD = {f"h{k}": "#" * k + " " for k in range(1, 7)}
_PARTED = frozenset("p div section article main body tr ul ol table blockquote".split()) | _HEAD.keys()


#: White space of preformatted text, kept from what tidies the rest.
_HIDE = {ord(" "): "\ue000", ord("\t"): "\ue001", ord("\n"): "\ue002"}
_SHOW = {ord(v): chr(k) for k, v in _HIDE.items()}


class _Writer(HTMLParser):
    """Writes Markdown while a page is read."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skipped = self.pre = self.rows = self.cells = 0
        self.links: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SKIP:
            self.skipped += 1
        if self.skipped:
            return
        if tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag == "tr":
            self.out.append("\n|")
        elif tag in _MARK and not self.pre:
            self.out.append(_MARK[tag])
        elif tag in _PARTED:
            self.out.append("\n\n" + _HEAD.get(tag, ""))

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif self.skipped:
            return
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("td", "th"):
            self.out.append(" |")
            self.cells += 1
        elif tag == "tr":
            self.rows += 1
            if self.rows == 1:
                self.out.append("\n|" + "---|" * self.cells)
        elif tag == "table":
            self.rows = self.cells = 0
            self.out.append("\n\n")
        elif tag in _MARK and not self.pre:
            self.out.append(_MARK[tag])
        elif tag in _PARTED:
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.out.append(data.translate(_HIDE) if self.pre else re.sub(r"\s+", " ", data))


def markdown(html: str | None) -> str:
    """Markdown of one page; null is empty."""
    writer = _Writer()
    body = re.sub(r"(?is)<head\b.*?</head>", "", html or "")
    writer.feed(body)
    writer.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(writer.out))
    text = re.sub(r"\n[ \t]+(?=\S)", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip().translate(_SHOW)


def from_html(html: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series([markdown(x) for x in s], dtype=object), "string")(html)


def table_lines(df: DataFrame, order: list[str], most: int = 100) -> DataFrame:
    """(at, line): a table of the first rows in Markdown, with a note where rows are left out."""
    names = df.columns
    head = F.array(F.lit("| " + " | ".join(names) + " |"), F.lit("|" + "---|" * len(names)))
    first = df.orderBy(*order).limit(most)
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[T.markdown_cell(F.col(c)) for c in names]), F.lit(" |"))
    rows = first.select(F.struct(*order).alias("o"), cells.alias("line")).agg(F.sort_array(F.collect_list(F.struct("o", "line"))).alias("x"))
    total = df.agg(F.count("*").alias("n"))
    note = F.when(F.col("n") > most, F.array(F.concat(F.lit(f"({most} of "), F.col("n").cast("string"), F.lit(" rows)")))).otherwise(F.array().cast("array<string>"))
    both = rows.join(total).select(F.concat(head, F.transform("x", lambda r: r["line"]), note).alias("all"))
    return both.select(F.posexplode("all").alias("at", "line"))


def read_table(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A delimited file with a header; a byte order mark is no part of the first name."""
    df = spark.read.csv(path, header=True, inferSchema=False, sep=separator, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_files(spark: SparkSession, path: str, extensions: list[str], skip: tuple[str, ...] = (".git", "node_modules", "__pycache__")) -> DataFrame:
    """(path, ext, length, modified, text) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    pruned = "|".join(x.replace(".", r"\.") for x in skip)
    found = files.withColumn("ext", ext).where(F.col("ext").isin(extensions) & ~F.rlike("path", F.lit(f"/({pruned})/")))
    return found.select("path", "ext", "length", F.col("modificationTime").alias("modified"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
