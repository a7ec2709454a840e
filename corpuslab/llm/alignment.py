"""Alignment of two vocabularies: which tokens end together, and how often over the whole corpus.

Each text is encoded once by both vocabularies.  Where tokens of both end at the
same byte, a group ends, and the two tokens are linked.  A task collects its links
as records (pair, document, number), parted by the second vocabulary's id into
radix partitions, and when enough are held it writes each partition as a run:
pairs in the order of the second vocabulary's ids, the documents of each pair
behind it, compressed by zstd in blocks.  Runs are rows of a table in the shared
folder, so they outlive the executor that made them.

Counting reads only the pairs of the runs and how often each occurs.  Groups of at
most FAN_IN runs of a partition are merged by a heap, again and again, until each
partition has one list, whose length is bounded by the vocabularies.  As lists are
in the order of the second vocabulary's ids, an id's largest count is known when
its last pair has been read.

Then each run meets the list of its partition; both are in the same order, so
blocks of the run stream along the list, and what each document's links
contribute is summed by document.  A pair that every document has is spread over
all runs and never meets in one task.

Null and empty texts have no tokens, nor have those that one of the vocabularies
does not give back byte by byte.  Rows are independent: repeated rows, ties and
null ids each get their own row and count each; an empty table gives an empty
result; further columns are ignored.  A document of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import wordhash as W
from corpuslab.llm.batches import bound, written
from corpuslab.llm.packing import WordCachedEncoder, public_path
from corpuslab.llm.token_counts import PieceEncoder

#: Radix partitions; records that a task holds; entries of a block of a run and of a list; lists that are merged at once; bytes of runs that meet one copy of their list.
RADIX, HELD, BLOCK, LIST_BLOCK, FAN_IN, SHARE = 16, 1 << 21, 1 << 15, 1 << 12, 64, 64 << 20
#: Room for ids of the first vocabulary in a pair.
ROOM = 1 << 20


def byte_level_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones as themselves, the others, in order, from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pool:
    """Bytes of all ids of a vocabulary in one array."""

    def __init__(self, entries: list[bytes]):
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def ends(self, ids: np.ndarray, text: np.ndarray) -> np.ndarray | None:
        """Where each token ends, or nothing if the tokens are not the text."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids) or ends[-1] != len(text):
            return None
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(len(text))
        return ends if np.array_equal(self.data[at], text) else None


class PlainWords(WordCachedEncoder):
    """Ids by words met before; the strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.special = []


class Aligner:
    """Both vocabularies."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.first = PlainWords(first)
        byte = byte_level_characters()
        entries = {i: bytes(byte[c] for c in p) for p, i in json.load(open(first, encoding="utf-8"))["model"]["vocab"].items()}
        self.bytes_a = Pool([entries.get(i, b"") for i in range(max(entries) + 1)])
        self.second = PieceEncoder(second)
        self.bytes_b = Pool(self.second.bytes)
        self.writer = Writer(max(len(self.bytes_a.sizes), len(self.bytes_b.sizes)))

    def _first_ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text behind a space; a word of one token stands before it, so that the space is one between words."""
        ids, edges = self.first.encode(pa.array(["x " + t for t in texts], pa.string()))
        return (ids[a + 1 : b].astype(np.int64) for a, b in itertools.pairwise(edges.tolist()))

    def align(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
        """For each text its ids, and for each group the last place of either side; nothing for texts without tokens."""
        for text, a, b in zip(texts, self._first_ids(texts), self.second.encode(texts), strict=True):
            raw = np.frombuffer(f" {text}".encode(), np.uint8)
            b = np.asarray(b, np.int64)
            ends_a = self.bytes_a.ends(a, raw) if len(raw) > 1 and a.max() < len(self.bytes_a.sizes) else None
            ends_b = self.bytes_b.ends(b, raw) if ends_a is not None else None
            if ends_b is None:
                yield None
                continue
            at = np.searchsorted(ends_b, ends_a)  # the last ends are the same
            here = np.flatnonzero(ends_b[at] == ends_a)
            yield a, b, here, at[here]


@cache
def aligner(first: str, second: str) -> Aligner:
    """One for each Python worker, kept from task to task."""
    return Aligner(first, second)


class Writer:
    """Groups as text, `a1,a2|b1;a3|b2,b3`, from the digits of all ids."""

    def __init__(self, ids: int):
        entries = [f"{k},".encode() for k in range(ids)]
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def write(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> bytes:
        """`at_a` and `at_b` are the last places of each group."""
        # a token stands behind those of its side before it and those of the other side in groups before its own (b: up to its own)
        own_a, own_b = np.arange(len(a)), np.arange(len(b))
        place_a = own_a + np.append(0, at_b + 1)[np.searchsorted(at_a, own_a)]
        place_b = own_b + (at_a + 1)[np.searchsorted(at_b, own_b)]
        ids, signs = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        signs[place_a[at_a]], signs[place_b[at_b]] = ord("|"), ord(";")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        out = self.data[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])]
        out[ends - 1] = signs
        return out[:-1].tobytes()


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers as zstd frames, each behind its length."""
    out = []
    for x in arrays:
        frame = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())
        out += (len(frame).to_bytes(4, "little"), frame)
    return b"".join(out)


def _frames(blob: bytes) -> Iterator[bytes]:
    at, unpack = 0, zstandard.ZstdDecompressor()
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        yield unpack.decompress(blob[at + 4 : at + 4 + n])
        at += 4 + n


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of growing numbers, which compress well."""
    return np.diff(x, prepend=x.dtype.type(0))


def _list_blob(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """Pairs in order with their counts, in blocks."""
    return b"".join(_packed(_steps(pairs[k : k + LIST_BLOCK]), counts[k : k + LIST_BLOCK]) for k in range(0, len(pairs), LIST_BLOCK))


def _list_blocks(blob: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    frames = _frames(blob)
    for steps in frames:
        yield np.cumsum(np.frombuffer(steps, np.int64)), np.frombuffer(next(frames), np.int64)


def _run(pairs: np.ndarray, docs: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """The pairs of a run with their counts, and its records: (pair, document, number) in the order of pairs, in blocks."""
    order = np.lexsort((docs, pairs))
    pairs, docs, times = pairs[order], docs[order], times[order]
    new = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    blocks = (slice(k, k + BLOCK) for k in range(0, len(pairs), BLOCK))
    records = b"".join(_packed(_steps(pairs[x]), _steps(docs[x].astype(np.uint32)), times[x].astype(np.uint32)) for x in blocks)
    return _list_blob(pairs[new], np.add.reduceat(times, new)), records


class _Records:
    """Links of the documents of a task, until they are written as runs; documents are numbered by where they are in `rows`."""

    def __init__(self, task: int):
        self.task, self.number = task, 0
        self._clear()

    def _clear(self) -> None:
        self.rows: list[int] = []
        self.held: list[tuple[np.ndarray, int, np.ndarray]] = []
        self.size = 0

    def add(self, row: int, pairs: np.ndarray, times: np.ndarray) -> None:
        self.held.append((pairs, len(self.rows), times))
        self.rows.append(row)
        self.size += len(pairs)

    def runs(self) -> Iterator[tuple]:
        """(radix, run, rows, list, records) of each partition that has records."""
        if not self.size:
            return
        pairs = np.concatenate([p for p, _, _ in self.held])
        docs = np.repeat(np.array([d for _, d, _ in self.held]), [len(p) for p, _, _ in self.held])
        times = np.concatenate([t for _, _, t in self.held])
        part = pairs // ROOM % RADIX
        rows = _packed(_steps(np.array(self.rows, np.int64)))
        for radix in np.unique(part).tolist():
            own = part == radix
            yield radix, (self.task << 24) + self.number, rows, *_run(pairs[own], docs[own], times[own])
        self.number += 1
        self._clear()


_ALIGNED = "row long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, radix int, run long, rows binary, list binary, records binary"
_DOC, _RUN = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"], ["radix", "run", "rows", "list", "records"]


def _aligned(docs: DataFrame, first: str, second: str, held: int) -> DataFrame:
    """Rows of documents, and rows of runs, which have a radix."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, records, kind = aligner(first, second), None, None
        types = [pa.int64(), None, *[pa.int64()] * 3, pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 3]

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t or kind) for c, t in zip(zip(*found, strict=True), types, strict=True)], _DOC + _RUN)

        for batch in W.parts(batches):
            kind, out = batch.schema.field(1).type, []
            names, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            records = records or _Records(names[0])
            for row, doc, found in zip(names, ids, own.align([t or "" for t in batch.column(2).to_pylist()]), strict=True):
                if found is None:
                    out.append((row, doc, 0, 0, 0, "", *[None] * 5))
                    continue
                a, b, at_a, at_b = found
                out.append((row, doc, len(a), len(b), len(at_a), hashlib.sha256(own.writer.write(*found)).hexdigest(), *[None] * 5))
                records.add(row, *np.unique(b[at_b] * ROOM + a[at_a], return_counts=True))
            yield rows(out)
            if records.size >= held:
                for run in records.runs():
                    yield rows([(*[None] * 6, *run)])
        for run in records.runs() if records else ():
            yield rows([(*[None] * 6, *run)])
        W.trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(work, _ALIGNED.format(kind=kind))


def _entries(blob: bytes) -> Iterator[tuple[int, int]]:
    for pairs, counts in _list_blocks(blob):
        yield from zip(pairs.tolist(), counts.tolist(), strict=True)


def merged(blobs: list[bytes]) -> Iterator[tuple[int, int]]:
    """Pairs of several lists in order with the sum of their counts; holds one block of each list."""
    now = None
    for pair, count in heapq.merge(*map(_entries, blobs)):
        if pair != now:
            if now is not None:
                yield now, total
            now, total = pair, 0
        total += count
    if now is not None:
        yield now, total


def pair_counts(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(radix, list): one list of all pairs of a radix with their counts."""

    def work(table: pa.Table) -> pa.Table:
        entries = merged(table["list"].to_pylist())
        blocks = []
        while some := list(itertools.islice(entries, LIST_BLOCK)):
            blocks.append(_list_blob(*np.array(some, np.int64).T))
        return pa.table({"radix": table["radix"][:1], "key": table["group"][:1], "list": pa.array([b"".join(blocks)], pa.binary())})

    lists = runs.select("radix", F.xxhash64("run").alias("key"), "list")
    most = runs.groupBy("radix").count().agg(F.max("count")).head()[0] or 0
    while most > 1:
        most = -(-most // fan_in)
        grouped = lists.withColumn("group", F.pmod("key", F.lit(most))).groupBy("radix", "group")
        lists = written(grouped.applyInArrow(work, "radix int, key long, list binary"), "lists")
    return lists.select("radix", "list")


def best_of_side(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which pairs have the largest count of their id of the second vocabulary; pairs are in order."""
    side = pairs // ROOM
    new = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
    return counts == np.repeat(np.maximum.reduceat(counts, new), np.diff(np.append(new, len(side))))


def _contributions(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum): what the links of each run add to its documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for rows, records, counted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if counted != last:
                    pairs, totals = (np.concatenate(x) for x in zip(*_list_blocks(counted), strict=True))
                    best, last = best_of_side(pairs, totals), counted
                names = np.cumsum(np.frombuffer(next(_frames(rows)), np.int64))
                sums, bests = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
                frames = _frames(records)
                for steps in frames:
                    at = np.searchsorted(pairs, np.cumsum(np.frombuffer(steps, np.int64)))
                    docs = np.cumsum(np.frombuffer(next(frames), np.uint32), dtype=np.uint32)
                    times = np.frombuffer(next(frames), np.uint32).astype(np.int64)
                    np.add.at(sums, docs, totals[at] * times)
                    np.add.at(bests, docs, best[at] * times)
                some = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (names, bests, sums)], ["row", "n_best", "count_sum"])

    # each copy of a list serves a bounded share of the runs of its radix, so that no radix is one task
    shares = runs.groupBy("radix").agg(F.ceil(F.sum(F.octet_length("records")) / SHARE).cast("int").alias("shares"))
    copies = counts.join(shares, "radix").select("radix", "list", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    spread = runs.join(F.broadcast(shares), "radix").select("radix", F.pmod(F.xxhash64("run"), F.col("shares")).cast("int").alias("share"), "rows", "records")
    met = spread.join(copies, ["radix", "share"])
    return met.select("rows", "records", "list").mapInArrow(work, "row long, n_best long, count_sum long")


def align(docs: DataFrame, first: str | None = None, second: str | None = None, text: str = "text", doc_id: str = "doc_id", held: int = HELD, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    bound(docs.sparkSession)
    first, second = first or public_path("byte_bpe_50k.json"), second or public_path("piece_bpe_32k.model")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    aligned = written(_aligned(own, first, second, held), "aligned")
    runs = aligned.where("radix is not null").select(*_RUN)
    added = _contributions(runs, pair_counts(runs, fan_in)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    found = aligned.where("radix is null").select(*_DOC).join(added, "row", "left").na.fill(0, ["n_best", "count_sum"])
    # every token has a byte, so no two tokens of one side end together: a group has one link
    return found.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def links(docs: DataFrame, **options) -> DataFrame:
    """(b, a, n): how often each pair of ids is linked over all documents."""
    bound(docs.sparkSession)
    first, second = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")
    runs = written(_aligned(docs.select("doc_id", "text"), first, second, options.get("held", HELD)), "aligned").where("radix is not null")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                for pairs, counts in _list_blocks(blob):
                    yield pa.RecordBatch.from_arrays([pa.array((pairs // ROOM).astype(np.int32)), pa.array((pairs % ROOM).astype(np.int32)), pa.array(counts)], ["b", "a", "n"])

    return pair_counts(runs, options.get("fan_in", FAN_IN)).select("list").mapInArrow(rows, "b int, a int, n long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
