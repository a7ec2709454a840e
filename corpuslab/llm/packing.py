"""Best-fit packing of whole documents into sequences of bounded length.

Documents are tokenised once in Spark tasks; only lengths matter for packing, and
there are at most `capacity` of them.  So best-fit decreasing runs on the
histogram of lengths: open bins are counted by remaining capacity, a segment tree
over the capacities finds the tightest one that fits in logarithmic time, and all
documents of one length that go the same way are placed in one step.  This is
best-fit decreasing over the whole corpus, with memory bounded by the capacity.
The placement is a short list of runs (length, ranks -> bins); each document's
rank among those of its length comes from counts by (length, salt), so a length
that very many documents share is still ranked by many tasks.

Null text is an empty document of the end id alone; null and repeated ids and
repeated rows are packed like any other row; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.llm import wordhash as W
from corpuslab.llm.batches import bound, written

CAPACITY, END_ID, SALTS, CACHE_BYTES = 2048, 0, 256, 80 << 20
_BREAKS = np.zeros(256, bool)
_BREAKS[[0x20, 0x0A]] = True
_LED = np.uint64(0xA5B85C5E198ED849)


class WordCachedEncoder:
    """Token ids of texts, with the ids of words kept between texts in flat arrays of at most about `CACHE_BYTES`.

    The vocabulary's splitting pattern always breaks before a single space that
    follows and precedes other characters, and around a single line feed; words
    between such places are encoded once and looked up by a 64-bit hash.  Texts in
    which spaces or line feeds meet each other or an end of the text, that hold
    other white space at the edge of a word, or that hold the string of a special
    token, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_feed = self.whole(["\n"])[0]
        assert len(self.line_feed) == 1
        self._forget()

    def _forget(self) -> None:
        #: Sorted hashes of words and the number of each; word n has the ids edges[n]:edges[n + 1] of the pool, none if it needs its text whole.
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.edges, self.pool, self.used = np.zeros(1, np.uint32), np.zeros(1 << 16, np.uint32), 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], lead: str, together: int = 256) -> Iterator[np.ndarray]:
        """Ids of words without line feeds; many go through the tokenizer as lines of one text, which cost less than texts of their own."""
        groups = [words[k : k + together] for k in range(0, len(words), together)]
        for group, ids in zip(groups, self.whole([f"\n{lead}".join([lead + g[0], *g[1:]]) for g in groups]), strict=True):
            stops = np.flatnonzero(ids == self.line_feed[0])
            assert len(stops) == len(group) - 1
            for start, stop in zip([0, *(stops + 1).tolist()], [*stops.tolist(), len(ids)], strict=True):
                yield ids[start:stop]

    def _learn(self, keys: np.ndarray, words: list[str], led: np.ndarray) -> None:
        """Adds words with their keys; `led` tells which follow a space."""
        ids: list[np.ndarray | None] = [None] * len(words)
        for lead in ("", " "):
            some = [k for k in np.flatnonzero(led == bool(lead)).tolist() if not (words[k][0].isspace() or words[k][-1].isspace())]
            for k, x in zip(some, self._words([words[k] for k in some], lead), strict=True):
                ids[k] = x
        sizes = np.array([0 if x is None else len(x) for x in ids], np.int64)
        start, number = self.used, np.arange(len(self.keys), len(self.keys) + len(keys), dtype=np.int32)
        self.edges = np.append(self.edges, (start + np.cumsum(sizes)).astype(np.uint32))
        self.used += int(sizes.sum())
        if self.used > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(max(self.used - len(self.pool), len(self.pool) // 4), np.uint32))
        self.pool[start : self.used] = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.uint32)])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.number = np.insert(self.keys, place, keys), np.insert(self.number, place, number)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin and the last one's end."""
        words = W.words(texts, parted=_BREAKS)
        n, owner = len(texts), W.owners(words)
        lengths = np.asarray(pc.binary_length(texts.fill_null("")), np.int64)
        begins = np.cumsum(lengths) - lengths
        # white space between words is one byte each, and none stands at an edge
        odd = lengths != np.bincount(owner, words.ends - words.starts, n) + np.maximum(words.counts - 1, 0)
        if n and (some := words.counts > 0).any():
            odd[some] |= words.starts[words.first[:-1][some]] != begins[some]
        for special in self.special:
            odd |= np.asarray(pc.match_substring(texts.fill_null(""), special))
        odd &= lengths > 0
        before = np.zeros(len(owner), np.uint8)
        inside = np.arange(len(owner)) != words.first[:-1][owner]
        before[inside] = words.data[words.starts[inside] - 1]
        led = before == 0x20
        live = np.flatnonzero(~odd[owner])
        keys, first, back = np.unique(words.hashes[live] ^ np.where(led[live], _LED, np.uint64(0)), return_index=True, return_inverse=True)
        self._add_missing(keys, live[first], words, led)
        number = self.number[np.searchsorted(self.keys, keys)]
        at = self.edges[number].astype(np.int64)
        size, at = (self.edges[number + 1].astype(np.int64) - at)[back], at[back]
        odd[owner[live[size == 0]]] = True
        use = ~odd[owner[live]]
        live, size, at = live[use], size[use], at[use]
        feeds = (before[live] == 0x0A).astype(np.int64)
        rare = {k: ids for k, ids in zip(np.flatnonzero(odd).tolist(), self.whole([texts[k].as_py() for k in np.flatnonzero(odd).tolist()]), strict=True)}
        count = np.bincount(owner[live], size + feeds, n).astype(np.int64)
        for k, ids in rare.items():
            count[k] = len(ids)
        edges = np.append(0, np.cumsum(count))
        out = np.zeros(edges[-1], np.uint32)
        # words stand in the order of their texts, so each goes behind what came before it in its text
        total = np.cumsum(size + feeds)
        base = total - np.bincount(owner[live], size + feeds, n).cumsum().astype(np.int64)[owner[live]] + edges[1:][owner[live]]
        start = base - size
        out[start[feeds > 0] - 1] = self.line_feed[0]
        run = np.repeat(np.cumsum(size) - size, size)
        step = np.arange(len(run)) - run
        out[np.repeat(start, size) + step] = self.pool[np.repeat(at, size) + step]
        for k, ids in rare.items():
            out[edges[k] : edges[k + 1]] = ids
        return out, edges

    def _missing(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.arange(len(keys))
        return np.flatnonzero(self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys)

    def _add_missing(self, keys: np.ndarray, at: np.ndarray, words: W.Words, led: np.ndarray) -> None:
        """Afterwards all `keys` are known; `at` has a word with each of them."""
        new = self._missing(keys)
        if len(new) and self.used * 4 + (len(self.keys) + len(new)) * 16 > CACHE_BYTES:
            self._forget()
            new = self._missing(keys)
        if len(new):
            self._learn(keys[new], [words.text(k).decode() for k in at[new].tolist()], led[at[new]])


@cache
def _encoder(path: str) -> WordCachedEncoder:
    """One for each Python worker, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordCachedEncoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut where longer than `capacity`; the first piece is the short one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in W.parts(batches, 512):
            rows: list[tuple[int, int, int, int, int]] = []
            encoded, edges = encoder.encode(batch.column(1))
            for k, (a, b) in enumerate(itertools.pairwise(edges.tolist())):
                ids = encoded[a:b].astype("<u4", copy=False).tobytes() + end
                n = b - a + 1
                start, part = 0, 0
                while start < n:
                    size = (n - 1) % capacity + 1 if not part else capacity
                    rows.append((k, part, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
                    start, part = start + size, part + 1
            if rows:
                at, part, start, size, crc = zip(*rows, strict=True)
                columns = [batch.column(0).take(pa.array(at)), pa.array(part, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    bound(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class CapacityTree:
    """Segment tree over remaining capacities; a leaf is set where open bins have that capacity."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.size)

    def set(self, at: int, value: bool) -> None:
        k = at + self.size
        self.some[k] = value
        while k > 1:
            k //= 2
            self.some[k] = self.some[2 * k] or self.some[2 * k + 1]

    def tightest(self, least: int) -> int | None:
        """Smallest set capacity that is at least `least`."""
        k = least + self.size
        while not self.some[k]:
            while k & 1:  # up, until there is a right neighbour
                k //= 2
                if k <= 1:
                    return None
            if k <= 1:
                return None
            k += 1
        while k < self.size:
            k = 2 * k if self.some[2 * k] else 2 * k + 1
        return k - self.size


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, count, first bin, items of a bin, offset).

    The item of `length` with rank first + q goes to bin first_bin + q // per_bin
    at offset + (q % per_bin) * length.
    """
    tree, bins, opened = CapacityTree(capacity), {}, 0
    runs = []

    def put(left: int, first: int, count: int) -> None:
        if left and count:
            bins.setdefault(left, []).append((first, count))
            tree.set(left, True)

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                left, per_bin = capacity, capacity // length
                first, count = opened, -(-todo // per_bin)
                opened += count
            else:
                per_bin = left // length
                first, have = bins[left].pop()
                count = min(have, -(-todo // per_bin))
                if have > count:
                    bins[left].append((first + count, have - count))
                if not bins[left]:
                    tree.set(left, False)
            items = min(todo, count * per_bin)
            runs.append((length, rank, items, first, per_bin, capacity - left))
            whole, rest = divmod(items, per_bin)
            put(left - per_bin * length, first, whole)
            put(left - rest * length, first + whole, 1 if rest else 0)
            rank, todo = rank + items, todo - items
    return runs


def pack(items: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """Adds sequence_id and offset to items, which have doc_id, piece, ids_crc32 and a length of at most `capacity`; `items` is read twice."""
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    table = sorted((r["length"], r["_salt"], r["n"]) for r in counts.collect())  # at most capacity x salts rows
    histogram: dict[int, int] = {}
    before = np.zeros((capacity + 1, salts), np.int64)
    for length, salt, n in table:
        before[length, salt] = histogram.get(length, 0)
        histogram[length] = histogram.get(length, 0) + n
    runs = np.array(best_fit_decreasing(histogram, capacity), np.int64).reshape(-1, 6)
    bounds = {int(k): np.flatnonzero(runs[:, 0] == k) for k in np.unique(runs[:, 0])}
    shared = items.sparkSession.sparkContext.broadcast((before, runs, bounds))

    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")))
    names = items.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, runs, bounds = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy() - 1 + before[length, batch.column("_salt").to_numpy()]
            chosen = np.zeros(len(length), np.int64)
            for k in np.unique(length):
                own = length == k
                chosen[own] = bounds[int(k)][np.searchsorted(runs[bounds[int(k)], 1], rank[own], "right") - 1]
            _, first, _, first_bin, per_bin, offset = runs[chosen].T
            q = rank - first
            columns = [batch.column(c) for c in names] + [pa.array(first_bin + q // per_bin), pa.array(offset + q % per_bin * length)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    path = tokenizer_path or public_path("byte_bpe_50k.json")
    return pack(written(pieces(docs, path, text, capacity=capacity), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: every remaining document as pieces of packed sequences."""
    return pack_documents(docs)
