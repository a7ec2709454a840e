"""Removal of passages that an earlier document has, found by level-wise doubling.

A window of `size` words (13) can only repeat if the windows of half its length
inside it do.  Level 1 looks at one window of 7 words for each window of 13: the
one with the smallest hash among the 7 it holds, so that equal windows choose
equal ones.  Only windows of 13 words over survivors of level 1 are extended to
full length.  `passages` doubles on, 26, 52 and so on, until no candidates
survive; the words that go are settled at 13 already.

Windows next to each other that chose the same half make a run, of at most 7
windows.  A run that an earlier document has as a whole needs no further look; of
all equal runs only the first document's goes on to the count of single windows.
Shuffles so carry a few per cent of the windows, whatever the number of copies.

A word goes if a window over it also starts in a document with a smaller id.
Null text has no words; documents with a null id neither lose words nor take
any; rows that share an id take nothing from one another; an empty table gives
an empty result; further columns are ignored.

Hashes have 64 bits.  The filters between the passes over the texts are sized by
their keys and only save work: what they let through by chance is counted exactly.
Texts of any length are read in bounded slices; a run that very many documents
have is one row on one side of its join, whose other side Spark splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import filters
from corpuslab.llm import wordhash as W
from corpuslab.llm.batches import bound, written

SIZE = 13


def _windows(words: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of whole windows, and for each the smallest hash of its windows of half the size."""
    half = (size + 1) // 2
    at = W.whole_windows(words, size)
    return at, W.sliding_min(W.grams(words.hashes, half), size - half + 1)[at]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))


def shared_halves(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(half): hashes chosen by windows of at least two documents; `docs` has (doc_id, text)."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.parts(batches):
            words = W.words(batch.column(0))
            at, half = _windows(words, size)
            doc = W.owners(words)[at]
            order = np.lexsort((half, doc))
            half, doc = half[order], doc[order]
            new = np.ones(len(at), bool)
            new[1:] = (half[1:] != half[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(half[new].view(np.int64))], ["half"])

    rows = docs.where("doc_id is not null").select("text").mapInArrow(chosen, "half long")
    return rows.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")


def _surviving(words: W.Words, ids: pa.Array, halves: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows whose half survived, their documents and the half."""
    at, half = _windows(words, size)
    doc = W.owners(words)[at]
    passed = filters.may_hold(halves, half) & np.asarray(ids.is_valid())[doc]
    return at[passed], doc[passed], half[passed]


def _runs(words: W.Words, ids: pa.Array, halves: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """First window, length, document and hash of each run, and the hashes of all windows."""
    at, doc, half = _surviving(words, ids, halves, size)
    full = W.grams(words.hashes, size)
    new = np.ones(len(at), bool)
    new[1:] = (half[1:] != half[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    begins = np.flatnonzero(new)
    into = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
    begins = np.flatnonzero(into % ((size + 1) // 2) == 0)
    length = np.diff(np.append(begins, len(at)))
    first = at[begins]
    run = W.mix(full[first] + W.mix(full[first + length - 1]) + length.astype(np.uint64)) if len(at) else np.zeros(0, np.uint64)
    return first, length, doc[begins], run, full


def _lists(doc: np.ndarray, rows: int, *columns: np.ndarray) -> list[pa.Array]:
    offsets = pa.array(np.searchsorted(doc, np.arange(rows + 1)), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]


def _kept(words: W.Words, doc: int, keep: np.ndarray | None = None) -> bytes:
    """The words of a document, or those that stay, with one space between."""
    span = slice(int(words.first[doc]), int(words.first[doc + 1]))
    starts, ends = words.starts[span], words.ends[span]
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return b""
    base = int(starts[0])
    data = words.data[base : int(ends[-1])].tobytes()
    return b" ".join([data[a:b] for a, b in zip((starts - base).tolist(), (ends - base).tolist(), strict=True)])


def document_runs(docs: DataFrame, halves: Broadcast, size: int = SIZE) -> DataFrame:
    """(row, doc_id, n_words, whole_sha256, run, start, length), one row per document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.parts(batches):
            words = W.words(batch.column(1))
            first, length, doc, run, _ = _runs(words, batch.column(0), halves.value, size)
            shas = pa.array([hashlib.sha256(_kept(words, k)).hexdigest() for k in range(batch.num_rows)], pa.string())
            lists = _lists(doc, batch.num_rows, run.view(np.int64), (first - words.first[doc]).astype(np.int32), length.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(words.counts), shas, *lists], ["row", "doc_id", "n_words", "whole_sha256", "run", "start", "length"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(find, f"row long, doc_id {kind}, n_words long, whole_sha256 string, run array<long>, start array<int>, length array<int>")


def _first_runs(docs: DataFrame, halves: Broadcast, owners: Broadcast, size: int) -> DataFrame:
    """(run, doc_id, window): the windows of runs for the first document that has each."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.parts(batches):
            words = W.words(batch.column(1))
            first, length, doc, run, full = _runs(words, batch.column(0), halves.value, size)
            rows = np.asarray(batch.column(2)).view(np.uint64)[doc]
            own = filters.may_hold(owners.value, W.mix(run ^ rows))
            first, length, doc, run = first[own], length[own], doc[own], run[own]
            ends = np.cumsum(length)
            places = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length) + np.repeat(first, length)
            offsets = pa.array(np.append(0, ends), pa.int32())
            windows = pa.ListArray.from_arrays(offsets, pa.array(full[places].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(run.view(np.int64)), batch.column(0).take(pa.array(doc)), windows], ["run", "doc_id", "window"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(find, f"run long, doc_id {kind}, window array<long>")


def _mixed(column: DataFrame) -> DataFrame:
    """The one long column of a table, mixed as in the passes over texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(W.mix(np.asarray(batch.column(0)).view(np.uint64)).view(np.int64))], ["h"])

    return column.mapInArrow(run, "h long")


def removed_spans(docs: DataFrame, found: DataFrame, halves: Broadcast, size: int = SIZE) -> DataFrame:
    """(row, spans): words a:b of each document that go; spans may overlap."""
    spark = docs.sparkSession
    runs = found.where(F.size("run") > 0).select("row", "doc_id", F.explode(F.arrays_zip("run", "start", "length")).alias("x")).select("row", "doc_id", "x.*")
    owners = written(runs.groupBy("run").agg(F.min(F.struct("doc_id", "row")).alias("o")).select("run", F.col("o.doc_id").alias("owner"), F.col("o.row").alias("owner_row")), "owners")
    own = spark.sparkContext.broadcast(filters.bloom(_mixed(owners.select(F.col("run").bitwiseXOR(F.col("owner_row"))))))
    windows = written(_first_runs(docs, halves, own, size), "first").select("run", "doc_id", F.posexplode("window").alias("at", "window"))
    holders = windows.groupBy("window").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last")).where("holder < last").drop("last")
    masks = windows.join(holders, "window").where("holder < doc_id").groupBy("run", "doc_id").agg(F.collect_set("at").alias("at")).withColumnRenamed("doc_id", "owner")
    settled = owners.select("run", "owner").join(masks, ["run", "owner"], "left")
    later = F.col("doc_id") > F.col("owner")
    lost = runs.join(settled, "run").where(later | F.col("at").isNotNull())
    span = lambda a, n: F.struct(a.cast("int").alias("a"), (a + n).cast("int").alias("b"))
    spans = F.when(later, F.array(span(F.col("start"), F.col("length") + (size - 1)))).otherwise(F.transform("at", lambda k: span(F.col("start") + k, F.lit(size))))
    return lost.groupBy("row").agg(F.flatten(F.collect_list(spans)).alias("spans"))


def remove(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text); kept_text is null where all words or none stay."""
    bound(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    halves = context.broadcast(filters.bloom(written(shared_halves(own, size), "halves")))
    found = written(document_runs(own, halves, size), "runs")
    spans = removed_spans(own, found, halves, size).withColumnRenamed("row", "of")
    empty = hashlib.sha256(b"").hexdigest()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, merged = [], []
            for spans in batch.column(4).to_pylist():
                out: list[list[int]] = []
                for x in sorted((x["a"], x["b"]) for x in spans or ()):
                    if out and x[0] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], x[1])
                    else:
                        out.append(list(x))
                gone.append(sum(b - a for a, b in out))
                merged.append([y for x in out for y in x])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(gone, pa.int64()), pa.array(merged, pa.list_(pa.int32()))], ["row", "doc_id", "n_words", "whole_sha256", "n_removed", "gone"])

    kind = own.schema["doc_id"].dataType.simpleString()
    joined = found.select("row", "doc_id", "n_words", "whole_sha256").join(spans, F.col("row") == F.col("of"), "left").drop("of")
    judged = written(joined.mapInArrow(merge, f"row long, doc_id {kind}, n_words long, whole_sha256 string, n_removed long, gone array<int>"), "judged")
    part = "n_removed > 0 and n_removed < n_words"
    wanted = context.broadcast(filters.bloom(_mixed(judged.where(part).select("row"))))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = filters.may_hold(wanted.value, W.mix(np.asarray(batch.column(0)).view(np.uint64)))
            yield batch.filter(pa.array(at))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.parts(batches):
            words = W.words(batch.column(4))
            kept = []
            for k, gone in enumerate(batch.column(3).to_pylist()):
                keep = np.ones(int(words.first[k + 1] - words.first[k]), bool)
                for a, b in zip(gone[::2], gone[1::2], strict=True):
                    keep[a:b] = False
                kept.append(_kept(words, k, keep))
            shas = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], shas, pa.array([x.decode() for x in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    # rows that are alike share a key: one text for each key
    some = _keyed(own).select(F.col("row").alias("of"), "text").mapInArrow(texts, "of long, text string").dropDuplicates(["of"])
    partly = judged.where(part).join(some, F.col("row") == F.col("of")).select("doc_id", "n_words", "n_removed", "gone", "text")
    partly = partly.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
    sha = F.when(F.col("n_removed") == 0, F.col("whole_sha256")).otherwise(F.lit(empty))
    settled = judged.where(f"not ({part})").select("doc_id", "n_words", "n_removed", sha.alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))
    return settled.unionByName(partly)


def passages(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, row, start, length): repeated windows, by the longest level they repeat at.

    A window of twice the length is looked at only if both its halves repeat; it
    ends when no window survives a level.
    """
    bound(docs.sparkSession)
    own = docs.select("doc_id", "text")
    halves = docs.sparkSession.sparkContext.broadcast(filters.bloom(written(shared_halves(own, size), "halves")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.parts(batches):
            words = W.words(batch.column(1))
            at, doc, _ = _surviving(words, batch.column(0), halves.value, size)
            full = W.grams(words.hashes, size)[at].view(np.int64)
            where = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column(2).take(where), batch.column(0).take(where), pa.array(full), pa.array((at - words.first[doc]).astype(np.int32))], ["row", "doc_id", "window", "start"])

    kind = own.schema["doc_id"].dataType.simpleString()
    level, length, out = _keyed(own).mapInArrow(find, f"row long, doc_id {kind}, window long, start int"), size, None
    while True:
        repeated = level.groupBy("window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("window")
        level = written(level.join(repeated, "window", "left_semi"), "level")
        here = level.select("doc_id", "row", "start", F.lit(length).alias("length"))
        out = here if out is None else out.unionByName(here)
        if not level.head(1):
            return out.groupBy("doc_id", "row", "start").agg(F.max("length").alias("length"))
        after = level.select("row", (F.col("start") - length).alias("start"), F.col("window").alias("second"))
        level = level.join(after, ["row", "start"]).select("row", "doc_id", F.xxhash64("window", "second").alias("window"), "start").distinct()
        length *= 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")


ORACLE = r"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
placed AS (SELECT r, doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i, len(words) AS n FROM split),
grams AS (
  SELECT r, doc_id, i, n, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o,
         lead(w, 6) OVER o, lead(w, 7) OVER o, lead(w, 8) OVER o, lead(w, 9) OVER o, lead(w, 10) OVER o, lead(w, 11) OVER o, lead(w, 12) OVER o) AS g
  FROM placed WINDOW o AS (PARTITION BY r ORDER BY i)),
owned AS (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS owner FROM grams WHERE i + 12 <= n),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM owned WHERE owner < doc_id),
kept AS (
  SELECT p.r, string_agg(w, ' ' ORDER BY p.i) AS kept, count(*) AS n_kept
  FROM placed p ANTI JOIN gone ON p.r = gone.r AND p.i = gone.i GROUP BY p.r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)"""
