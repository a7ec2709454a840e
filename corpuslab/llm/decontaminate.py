"""Search for short test items inside long documents, by size-partitioned MinHash containment.

An item is contained where at least `percent` of its word shingles are in the
document.  Items are partitioned by the number of their shingles, in powers of two.  A partition has a
signature length of its own, k = u - ceil(percent u) + 1 for its upper size u, and an
item's signature are the k smallest hashes of its shingles: a document that contains the
item misses at most s - ceil(percent s) < k of its s shingles, so it holds one of
the signature at least, and the search loses nothing.  Each partition has an
index from signature hashes to items; what a document finds there is verified by
the exact share of shingles.

Words are runs of letters and digits in lower case A-Z, so punctuation and white
space do not hide an item.  An item shorter than a shingle is one shingle of its
own length; items and documents without words match nothing.  Null text is
empty; documents of any length are searched whole; null ids are kept; repeated rows
each give their rows; empty tables give an empty result; further columns are ignored.

Up to `broadcast_shingles` shingles the items go to all tasks and documents are
read once.  Beyond, a filter over the signatures picks documents, and both sides
are joined on shingles; either way gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import filters
from corpuslab.llm import wordhash as W
from corpuslab.llm.batches import bound, written

SHINGLE, PERCENT, BROADCAST_SHINGLES = 5, 80, 2_000_000


def partition_of(n: int) -> int:
    """Partition p holds items of more than 2**(p - 1) and up to 2**p shingles."""
    return (n - 1).bit_length()


def signature_length(partition: int, percent: int) -> int:
    """Smallest hashes to keep of each item of a partition, of which a document that contains it misses not all."""
    upper = 1 << partition
    return upper - -(-percent * upper // 100) + 1


def _item_shingles(items: DataFrame, item_id: str, text: str, size: int, percent: int) -> DataFrame:
    """(item_id, item, width, partition, n, kept, shingles), one row per item that has words; kept is its signature."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.parts(batches):
            words = W.words(batch.column(1), lower=True, parted=W.NOT_WORD)
            rows = []
            for k, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                if b > a:
                    width = min(size, b - a)
                    s = np.unique(W.grams(words.hashes[a:b], width)[: b - a - width + 1])
                    part = partition_of(len(s))
                    rows.append((k, width, part, len(s), s[: signature_length(part, percent)].view(np.int64), s.view(np.int64)))
            if rows:
                at, width, part, n, kept, shingles = zip(*rows, strict=True)
                columns = [batch.column(0).take(pa.array(at)), batch.column(2).take(pa.array(at)), pa.array(width, pa.int32()), pa.array(part, pa.int32()), pa.array(n, pa.int64())]
                columns += [pa.array(x, pa.list_(pa.int64())) for x in (kept, shingles)]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "item", "width", "partition", "n", "kept", "shingles"])

    kind = items.schema[item_id].dataType.simpleString()
    own = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("item"))
    return own.mapInArrow(cut, f"item_id {kind}, item long, width int, partition int, n long, kept array<long>, shingles array<long>")


def _document_shingles(words: W.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a batch of documents and the document of each."""
    at = W.whole_windows(words, width)
    return W.grams(words.hashes, width)[at], W.owners(words)[at]


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) for every document and item it contains."""
    spark = bound(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prepared = written(_item_shingles(items, item_id, text, size, percent), "items")
    total = prepared.agg(F.sum("n")).head()[0] or 0
    parts = sorted((r["width"], r["partition"]) for r in prepared.select("width", "partition").distinct().collect())
    kinds = own.schema["doc_id"].dataType.simpleString(), prepared.schema["item_id"].dataType.simpleString()
    result = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_shingles long, n_shared long"
    if total <= broadcast_shingles:
        table = spark.sparkContext.broadcast(prepared.toArrow())
        found = own.mapInArrow(_searching(table, parts, percent), result)
    else:
        found = _joined(own, prepared, sorted({w for w, _ in parts}), percent)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def _searching(table, parts: list[tuple[int, int]], percent: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = table.value
        width, part = items["width"].to_numpy(), items["partition"].to_numpy()
        lists = {c: [np.asarray(x.values).view(np.uint64) for x in items[c]] for c in ("kept", "shingles")}
        index = {}
        for w, p in parts:
            own = np.flatnonzero((width == w) & (part == p))
            values = np.concatenate([lists["kept"][k] for k in own])
            of = np.repeat(own, [len(lists["kept"][k]) for k in own])
            order = np.argsort(values, kind="stable")
            index[w, p] = values[order], of[order]
        for batch in W.parts(batches):
            words = W.words(batch.column(1), lower=True, parted=W.NOT_WORD)
            rows = []
            for w in sorted({w for w, _ in index}):
                hashes, doc = _document_shingles(words, w)
                edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                for values, of in (x for (own, _), x in index.items() if own == w):
                    left = np.searchsorted(values, hashes)
                    hit = np.flatnonzero((left < len(values)) & (values[np.minimum(left, len(values) - 1)] == hashes))
                    pairs = set()
                    for h in hit.tolist():
                        for k in range(left[h], np.searchsorted(values, hashes[h], "right")):
                            pairs.add((int(doc[h]), int(of[k])))
                    for d, k in sorted(pairs):
                        s = lists["shingles"][k]
                        shared = int(np.isin(s, hashes[edges[d] : edges[d + 1]]).sum())
                        if shared * 100 >= len(s) * percent:
                            rows.append((d, k, len(s), shared))
            if rows:
                d, k, n, shared = zip(*rows, strict=True)
                ids = items["item_id"].combine_chunks().take(pa.array(k))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), ids, pa.array(n, pa.int64()), pa.array(shared, pa.int64())], ["doc_id", "item_id", "n_shingles", "n_shared"])

    return search


def _joined(own: DataFrame, prepared: DataFrame, widths: list[int], percent: int) -> DataFrame:
    context = own.sparkSession.sparkContext
    blooms = {c: context.broadcast(filters.bloom(prepared.select(F.explode(c)))) for c in ("kept", "shingles")}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.parts(batches):
            words = W.words(batch.column(1), lower=True, parted=W.NOT_WORD)
            for w in widths:
                hashes, doc = _document_shingles(words, w)
                some = np.zeros(batch.num_rows, bool)
                some[doc[filters.may_hold(blooms["kept"].value, hashes)]] = True
                hit = np.flatnonzero(some[doc] & filters.may_hold(blooms["shingles"].value, hashes))
                at = pa.array(doc[hit])
                yield pa.RecordBatch.from_arrays([batch.column(2).take(at), batch.column(0).take(at), pa.array(hashes[hit].view(np.int64)), pa.array(np.full(len(hit), w, np.int32))], ["row", "doc_id", "shingle", "width"])

    kind = own.schema["doc_id"].dataType.simpleString()
    # the numbers of rows are kept in a table, since they need not come out alike again
    numbered = written(own.withColumn("row", F.monotonically_increasing_id()), "numbered").select("doc_id", "text", "row")
    hits = numbered.mapInArrow(find, f"row long, doc_id {kind}, shingle long, width int").distinct()
    by_shingle = prepared.select("item", "item_id", "n", "width", F.explode("shingles").alias("shingle"))
    shared = hits.join(by_shingle, ["shingle", "width"]).groupBy("row", "doc_id", "item", "item_id", "n").agg(F.count("*").alias("n_shared"))
    return shared.where(F.col("n_shared") * 100 >= F.col("n") * percent).select("doc_id", "item_id", F.col("n").alias("n_shingles"), "n_shared")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go.

    Rows of null or repeated ids are judged each by its own text; null and empty
    texts contain nothing and stay; further columns, whatever their names, pass
    through; an empty table stays empty.
    """
    given = docs.columns
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("_row"), "doc_id", "text")
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    leaks = contained(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="_key").select(F.col("doc_id").alias("_key")).distinct()
    leaks = written(leaks, "leaks")  # a table of known size, so that a small one is sent to the documents
    return keyed.join(leaks, "_key", "left_anti").select("_row.*")


SQL_FOUND = r"""
items AS (
  SELECT row_number() OVER () AS item, item_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
texts AS (
  SELECT r, doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM {source}),
item_words AS (SELECT item, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM items),
item_shingles AS (
  SELECT DISTINCT item, g FROM (
    SELECT item, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g
    FROM item_words WINDOW o AS (PARTITION BY item ORDER BY i)) WHERE g IS NOT NULL),
text_words AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM texts),
text_shingles AS (
  SELECT DISTINCT r, g FROM (
    SELECT r, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g
    FROM text_words WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE g IN (SELECT g FROM item_shingles)),
item_sizes AS (SELECT item, count(*) AS n FROM item_shingles GROUP BY item),
shared AS (SELECT r, item, count(*) AS n_shared FROM text_shingles JOIN item_shingles USING (g) GROUP BY r, item),
found AS (SELECT r, item, n, n_shared FROM shared JOIN item_sizes USING (item) WHERE 100 * n_shared >= 80 * n)"""

#: For items of five words and more, which all of the benchmark are.
ORACLE = "WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents)," + SQL_FOUND.format(source="numbered") + """
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, CAST(n_shared AS BIGINT) AS n_shared, n_shared / n AS containment
FROM found JOIN texts USING (r) JOIN items USING (item)"""
