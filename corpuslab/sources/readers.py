"""Files of a folder as documents, read by what their extensions say; coverage files; skill folders as sinks."""

from __future__ import annotations

import csv
import io
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.sources import markdown

# Extensions of plain, HTML and delimited files, and of the files that are code; folders that are never read.
PLAIN, HTML, DELIMITED = (".md", ".txt", ".rst"), (".html", ".htm"), (".csv", ".tsv")
CODE = (".py", ".js", ".ts", ".jsx", ".tsx", ".c", ".h", ".cpp", ".hpp", ".java", ".go", ".rs", ".rb")
SKIPPED = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build")
TABLE_ROWS = 100


def table_text(text: str | None, separator: str, most: int | None) -> str:
    """A delimited text, with quoted fields that may hold separators and line breaks, as a Markdown table of its first `most` rows, or all."""
    reader = csv.reader(io.StringIO((text or "").removeprefix("\ufeff"), newline=""), delimiter=separator)
    rows = (x for x in reader if x)
    cells = lambda x: "| " + " | ".join(re.sub(r"\s*[\r\n]+\s*", " ", c).replace("|", "\\|") for c in x) + " |"
    head = next(rows, None)
    if head is None:
        return ""
    out, count = [cells(head), "|" + "---|" * len(head)], 0
    for count, row in enumerate(rows, 1):
        if most is None or count <= most:
            out.append(cells([*row, *[""] * (len(head) - len(row))]))
    return "\n".join(out + ([f"({most} of {count} rows)"] if most is not None and count > most else []))


def _table(text: Column, separator: str, most: int | None) -> Column:
    def read(texts: pd.Series) -> pd.Series:
        csv.field_size_limit(1 << 31)
        return pd.Series([table_text(t, separator, most) for t in texts], dtype=object)

    return F.pandas_udf(read, "string")(text)


def _code(path: Column, text: Column) -> Column:
    """Source in a fence, and its comments as a list."""
    notes = T.comments(text)
    fenced = F.concat(F.lit("```"), T.language(path), F.lit("\n"), text, F.lit("\n```"))
    listed = F.concat(F.lit("\n\n"), F.array_join(F.transform(notes, lambda x: F.concat(F.lit("- "), x)), "\n"))
    return F.concat(fenced, F.when(F.size(notes) > 0, listed).otherwise(""))


def as_markdown(files: DataFrame, table_rows: int | None = TABLE_ROWS) -> DataFrame:
    """Files (path, ext, text) with their text as Markdown: plain text as it is, HTML and delimited files converted, all else as code.

    Tables show their first `table_rows` rows and a note how many there are, or, if that is None, all.
    """
    ext, text = F.col("ext"), F.coalesce("text", F.lit(""))
    converted = (
        F.when(ext.isin(*PLAIN), text)
        .when(ext.isin(*HTML), markdown.from_html(text))
        .when(ext == ".csv", _table(text, ",", table_rows))
        .when(ext == ".tsv", _table(text, "\t", table_rows))
        .otherwise(_code(F.col("path"), text))
    )
    return files.withColumn("text", converted)


def read_documents(spark: SparkSession, path: str, extensions: tuple[str, ...] = PLAIN + HTML + DELIMITED + CODE, skip: tuple[str, ...] = SKIPPED, table_rows: int | None = TABLE_ROWS) -> DataFrame:
    """(path, ext, length, modified, text) of the files below a folder, as Markdown."""
    return as_markdown(markdown.read_files(spark, path, list(extensions), skip), table_rows)


def project(spark: SparkSession, path: str, newest: int | None = None, extensions: tuple[str, ...] = CODE, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, ext, lang, length, modified, n_lines) of source files, by path, or the `newest` ones, newest first."""
    files = markdown.read_files(spark, path, list(extensions), skip)
    listed = files.select("path", "ext", T.language(F.col("path")).alias("lang"), "length", "modified", F.size(T.lines(F.col("text"))).alias("n_lines"))
    return listed.orderBy("path") if newest is None else listed.orderBy(F.desc("modified"), "path").limit(newest)


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """(doc, total, lo, hi): ranges of the files doc/coverage.json below a folder; files that are no JSON have none.

    Spark's readers pass over names that begin with a dot.
    """
    files = markdown.read_files(spark, path, [".json"], ("[.]git",)).where(F.endswith("path", F.lit("/coverage.json")))
    parsed = F.from_json("text", "struct<total_pages:long,processed_ranges:array<array<long>>>", {"mode": "PERMISSIVE"})
    doc = F.element_at(F.split("path", "/"), -2)
    each = files.select(doc.alias("doc"), parsed.alias("c")).select("doc", F.col("c.total_pages").alias("total"), F.explode("c.processed_ranges").alias("r"))
    return each.select("doc", "total", F.get("r", 0).alias("lo"), F.get("r", 1).alias("hi")).where("lo is not null and hi is not null")


def write_skills(docs: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """A folder for each document with its text; documents that are written again are replaced, others stay.

    The files appear when the job commits, whole or not at all.
    """
    rows = docs.select(F.col(name).alias("doc"), F.col(text).alias("value"))
    rows.repartition("doc").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc").text(path, lineSep="\n")


def append_entries(index: DataFrame, entries: DataFrame, section: str = "section", order: str = "at", line: str = "line") -> DataFrame:
    """Lines of an index (section, at, line) with new lines at the end of their sections; sections that are not there are left out."""
    ends = index.groupBy(section).agg(F.max(order).alias("_end"))
    added = entries.join(ends, section).select(section, (F.col("_end") + F.col(order) + 1).alias(order), line)
    return index.select(section, order, line).unionByName(added)
