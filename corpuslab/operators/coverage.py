"""Page coverage: unions of ranges, what they leave open, and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clamp(ranges: DataFrame, key: str, total: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Ranges cut to pages 1 to `total`; empty ones go."""
    return ranges.select(key, total, F.greatest(F.col(lo), F.lit(1)).alias("lo"), F.least(F.col(hi), F.col(total)).alias("hi")).where("lo <= hi")


def merge(ranges: DataFrame, key: str) -> DataFrame:
    """(key, lo, hi): ranges that overlap or touch are one."""
    before = Window.partitionBy(key).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce((F.col("lo") > F.max("hi").over(before) + 1).cast("int"), F.lit(1))
    marked = ranges.select(key, "lo", "hi", new.alias("new"))
    return marked.withColumn("island", F.sum("new").over(upto)).groupBy(key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def gaps(merged: DataFrame, totals: DataFrame, key: str, total: str) -> DataFrame:
    """(key, lo, hi): pages from 1 to the total that no merged range has."""
    order = Window.partitionBy(key).orderBy("lo")
    joined = totals.select(key, total).join(merged, key, "left")
    after = joined.select(key, (F.col("hi") + 1).alias("lo"), (F.coalesce(F.lead("lo").over(order), F.col(total) + 1) - 1).alias("hi"))
    first = joined.groupBy(key, total).agg(F.min("lo").alias("m")).select(key, F.lit(1).cast("long").alias("lo"), F.coalesce(F.col("m") - 1, F.col(total)).alias("hi"))
    return first.unionByName(after.where("lo is not null")).where("lo <= hi")


def share(merged: DataFrame, totals: DataFrame, key: str, total: str) -> DataFrame:
    """(key, pages, pct): pages covered and their whole percentage."""
    pages = merged.groupBy(key).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("pages"))
    joined = totals.join(pages, key, "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
    return joined.select(key, total, "pages", F.floor(F.col("pages") * 100 / F.col(total)).alias("pct"))


def open_contents(contents: DataFrame, open_pages: DataFrame, key: str, level: str = "level", page: str = "page", most_level: int = 2, most: int | None = 50) -> DataFrame:
    """(key, level, title, page): entries of tables of contents from the first open page on, of high levels alone; the first `most` of each, or all."""
    first = open_pages.groupBy(key).agg(F.min("lo").alias("_first"))
    found = contents.join(first, key).where((F.col(level) <= most_level) & (F.col(page) >= F.col("_first"))).drop("_first")
    if most is None:
        return found
    rank = F.row_number().over(Window.partitionBy(key).orderBy(page, level, "title"))
    return found.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")
