"""Keyed relations: checks of references, cascades, first-wins loads and bit offsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dangling(child: DataFrame, foreign: str, parent: DataFrame, key: str, rule: str, row: str) -> DataFrame:
    """(rule, row, value) for rows whose reference has no parent; null and empty references refer to nothing."""
    known = parent.select(F.col(key).alias(foreign)).distinct()
    some = child.where(F.col(foreign).isNotNull() & (F.col(foreign).cast("string") != ""))
    return some.join(known, foreign, "left_anti").select(F.lit(rule).alias("rule"), F.col(row).cast("string").alias("row"), F.col(foreign).cast("string").alias("value"))


def violations(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def overflows(frames: DataFrame, frame: str, size: str, parts: DataFrame, of: str, offset: str, width: str) -> DataFrame:
    """Parts that end beyond eight bits for each byte of their frame."""
    return parts.join(frames.select(F.col(frame).alias(of), F.col(size).alias("frame_bytes")), of).where(F.col(offset) + F.col(width) > F.col("frame_bytes") * 8)


def next_offset(parts: DataFrame, of: str, offset: str, width: str) -> DataFrame:
    """(frame, next_offset): the end of the last part of each frame."""
    return parts.groupBy(of).agg(F.max(F.col(offset) + F.col(width)).alias("next_offset"))


def running_offset(parts: DataFrame, of: str, order: list[str], width: str, base: Column | None = None) -> DataFrame:
    """Adds offset: parts of a frame one after the other, from `base`."""
    before = Window.partitionBy(of).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(width).over(before), F.lit(0)) + (F.lit(0) if base is None else base))


def first_wins(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row of each key with the columns of its first row."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("x")).select(key, "x.*")


def last_wins(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("x")).select(key, "x.*")


def cascade(rows: DataFrame, links: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Rows none of whose references is among deleted keys; `links` has (column, deleted keys, key)."""
    for column, gone, key in links:
        rows = rows.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti")
    return rows


def blank_references(rows: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """Rows with references to deleted keys set to null."""
    marks = gone.select(F.col(key).alias("_gone")).distinct().withColumn("_hit", F.lit(True))
    joined = rows.join(marks, rows[column] == marks["_gone"], "left")
    return joined.withColumn(column, F.when(F.col("_hit").isNull(), F.col(column))).drop("_gone", "_hit")


def edit_first(rows: DataFrame, key: str, value: object, order: str, changes: dict[str, Column]) -> DataFrame:
    """The first row that has the key is changed; KeyError where there is none."""
    first = rows.where(F.col(key) == F.lit(value)).agg(F.min(order)).head()[0]
    if first is None:
        raise KeyError(value)
    hit = (F.col(key) == F.lit(value)) & (F.col(order) == F.lit(first))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})
