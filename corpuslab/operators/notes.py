"""Keyed notes and task lists: small relations that are replaced or upserted as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators import corpus

# States and priorities of a task.
STATES, PRIORITIES = ("pending", "in_progress", "done"), ("high", "medium", "low")


def remember(notes: DataFrame, key: str, content: str) -> DataFrame:
    """Notes (key, content) with one key set; the content is taken as it is."""
    return corpus.upsert(notes, notes.sparkSession.createDataFrame([(key, content)], "key string, content string"), "key")


def recall(notes: DataFrame, key: str | None = None) -> DataFrame:
    return notes if key is None else notes.where(F.col("key") == key)


def progress(tasks: DataFrame) -> DataFrame:
    """(done, total) of tasks (id, content, status, priority)."""
    return tasks.agg(F.count_if(F.col("status") == "done").alias("done"), F.count("*").alias("total"))


def invalid(tasks: DataFrame) -> DataFrame:
    """Tasks whose state or priority is not known."""
    return tasks.where(~(F.col("status").isin(*STATES) & F.col("priority").isin(*PRIORITIES)))
