"""Corpus operators: listing, scored search, grep with context, pages of results, upsert and delete.

Documents are rows (id, scope, text).  Everything runs on the rows of a scan:
grep works on the array of a document's lines, so nothing is shuffled by it, and a
search for k documents keeps k per task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as T


def listing(docs: DataFrame, doc_id: str = "doc_id", scope: str = "source", text: str = "text", only: str | None = None) -> DataFrame:
    """(doc_id, scope, title) of all documents, or of one scope."""
    found = docs if only is None else docs.where(F.col(scope) == only)
    return found.select(F.col(doc_id).alias("doc_id"), F.col(scope).alias("scope"), T.first_line(F.col(text)).alias("title"))


def read(docs: DataFrame, key: object, doc_id: str = "doc_id") -> DataFrame:
    """The rows of one document."""
    return docs.where(F.col(doc_id) == F.lit(key))


def relevance(line: Column, query: str) -> Column:
    """How many words of the query stand in a line; a word asked for twice counts twice."""
    words = re.findall(r"\w+", query.lower())
    low = F.lower(line)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))


def search(index: DataFrame, query: str, line: str = "title", order: str = "doc_id", k: int = 10) -> DataFrame:
    """The k best lines of an index, best first, ties in the order of the index."""
    scored = index.withColumn("score", relevance(F.col(line), query)).where("score > 0")
    return scored.orderBy(F.desc("score"), order).limit(k)


def grep(docs: DataFrame, pattern: str, context: int = 3, doc_id: str = "doc_id", text: str = "text", ignore_case: bool = True) -> DataFrame:
    """(doc_id, island, first_line, last_line, n_hits, snippet).

    Lines that match and `context` lines around them; stretches that touch are one
    island.  Lines count from 1.  A pattern is matched against each line with its
    line feed.  Null text has no lines.
    """
    java = T.java_pattern(pattern, ignore_case)
    # explode gives each of these one value per document; a filter on them would be pushed below
    # and would split the text again for every line
    own = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(T.lines(F.col(text)))).alias("lines"))
    places = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.rlike(F.concat(F.get("lines", i), F.lit("\n")), F.lit(java)))
    hits = F.when(F.size("lines") > 0, places).otherwise(F.array().cast("array<int>"))
    found = own.select("doc_id", "lines", F.explode(F.array(hits)).alias("hits"))
    places = F.when(F.size("hits") > 0, F.sequence(F.lit(0), F.size("hits") - 1))  # none: no rows come of it
    begins = F.filter(places, lambda k: (k == 0) | (F.get("hits", k) - F.get("hits", k - 1) > 2 * context + 1))
    found = found.withColumn("begins", begins)
    stretch = F.transform(
        "begins",
        lambda k, n: F.struct(
            n.cast("long").alias("island"),
            F.greatest(F.lit(0), F.get("hits", k) - context).alias("lo"),
            F.least(F.size("lines") - 1, F.get("hits", F.coalesce(F.get("begins", n + 1), F.size("hits")) - 1) + context).alias("hi"),
            (F.coalesce(F.get("begins", n + 1), F.size("hits")) - k).cast("long").alias("n_hits"),
        ),
    )
    found = found.withColumn("x", F.explode(stretch))
    shown = F.transform(
        F.sequence("x.lo", "x.hi"),
        lambda i: F.concat(
            F.lpad((i + 1).cast("string"), F.greatest(F.lit(4), F.length((i + 1).cast("string"))), F.lit(" ")),
            F.when(F.array_contains("hits", i), " >>> ").otherwise("     "),
            F.regexp_replace(F.get("lines", i), r"(?U)\s+\z", ""),
        ),
    )
    return found.select("doc_id", "x.island", (F.col("x.lo") + 1).cast("long").alias("first_line"), (F.col("x.hi") + 1).cast("long").alias("last_line"), "x.n_hits", F.array_join(shown, "\n").alias("snippet"))


def page_of(found: DataFrame, page: int, key: str = "doc_id", size: int = 20) -> DataFrame:
    """Rows of the keys on one page of matching keys; pages count from 1.

    The keys of a page are the smallest `page * size` at most, less those of the
    pages before, so that only so many keys are ever brought together.
    """
    if page < 1:
        raise ValueError("pages count from 1")
    until = found.select(key).distinct().orderBy(key).limit(page * size)
    keys = until.orderBy(F.desc(key)).limit(size) if page == 1 else until.join(found.select(key).distinct().orderBy(key).limit((page - 1) * size), key, "left_anti")
    return found.join(keys, key, "left_semi")


def scope_stats(docs: DataFrame, scope: str = "source", text: str = "text") -> DataFrame:
    """(scope, n_docs, n_lines, n_bytes, size) per scope."""
    stats = docs.groupBy(F.col(scope).alias("scope")).agg(
        F.count("*").alias("n_docs"), F.sum(F.size(T.lines(F.col(text)))).alias("n_lines"), F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).alias("n_bytes")
    )
    return stats.withColumn("size", T.size_label(F.col("n_bytes")))


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `existing` whose key is not new, and the new rows."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys.select(key).distinct(), key, "left_anti")
