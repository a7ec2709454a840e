"""Scores of texts under an n-gram model that is kept as an Elias-Fano trie.

The model is trained on the documents whose crc32(id) mod 7 is not 2.  Level 1 is
the sorted hashes of all training tokens with their counts; a word's id is its
place there.  Level n holds, for every node of level n - 1 (the context), the ids
of the words that follow it, as keys (context, word) in one monotone
Elias-Fano sequence, which serves as pointer and successor list at once: a
search goes to the few keys that share the high bits and finds the successor of
the low ones.  Each key has a quantised discounted probability, each context a
quantised weight for what it leaves to the shorter context:

    p(w | c) = max(count(cw) - D, 0) / count(c) + weight(c) p(w | shorter c)

A level is cut into blocks, ranges of keys that about `BLOCK` tokens fall to, by
the counts of the level before; a context with more tokens than that has several
blocks, each a range of words, so no group grows with a frequent word or pair.
Tasks count what they read and send sorted, compressed counts by block; tasks
that each get some blocks in order merge one block at a time and write it to
their file in the shared folder, where scoring tasks map it into memory.  A row
for each block, with the places of cuts, passes the driver.

`min_count` leaves n-grams above level 1 that are found less often to the weight
of their context; at the default of 1 all of them are kept.

Null text is empty and scores its end token; a null id counts as the empty id;
repeated rows count each time; an empty table gives an empty result; further
columns are ignored.  Texts of any length are read in bounded blocks of bytes.
Hashes have 64 bits.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import wordhash as W
from corpuslab.llm.batches import bound, located, shared_folder
from corpuslab.llm.elias_fano import Writer, opened

ORDER, DISCOUNT, MIN_COUNT, BLOCK, FLUSH, TEXTS = 3, 0.6, 1, 1 << 20, 1 << 20, 2 << 20
_END = np.uint64(0x51ED270B7F0C5A3D)
_STEPS = 1000.0  # codes per decade, in 16 bits
_PAIRS = "file int, block int, n int, keys binary, counts binary"
_BUILT = "block int, n long, tokens long, mass double, file string, ranks array<long>, parts array<int>, totals array<long>"
_ZSTD = pa.Codec("zstd", 1)


@dataclass
class Level:
    """Where the keys of a level are: block b begins with context starts[s]; contexts of several blocks have parts[s] of them, by ranges of words."""

    starts: np.ndarray
    parts: np.ndarray
    totals: np.ndarray
    per_file: int = 8
    #: Of each block the number of nodes before it; of each start with several parts the weight of its context.
    bases: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    files: dict[int, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.first = np.append(0, np.cumsum(self.parts))
        # more blocks in a file where there are many, so that looking up a batch of texts opens few files
        self.per_file = min(256, max(8, math.isqrt(int(self.first[-1]))))

    def block(self, contexts: np.ndarray, ids: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Block and start of each key."""
        start = np.searchsorted(self.starts, contexts, "right") - 1
        block = self.first[start]
        many = np.flatnonzero(self.parts[start] > 1)
        block[many] += ids[many] * self.parts[start[many]] // max(words, 1)
        return block, start


@dataclass
class Model:
    folder: str
    order: int
    word_bits: int = 1
    tokens: int = 0
    words: int = 0
    levels: dict[int, Level] = field(default_factory=dict)


def _code(p: np.ndarray) -> np.ndarray:
    """Quantised log10 of numbers in (0, 1], never above them; 0 stands for 1."""
    return np.ceil(-np.log10(np.maximum(p, 1e-30)) * _STEPS - 1e-9).astype(np.uint16)


_VALUE = 10.0 ** (-np.arange(1 << 16) / _STEPS)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a batch with one end after each text, and the place of each token in its text."""
    words = W.words(texts, lower=True)
    tokens = np.insert(words.hashes, words.first[1:], _END)
    counts = words.counts + 1
    return tokens, np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)


def _packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as differences, byte by byte, compressed; likewise their counts."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return tuple(_ZSTD.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True) for x in (steps, counts))


def _unpacked(n: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, number = (np.ascontiguousarray(np.frombuffer(_ZSTD.decompress(x, 8 * n, asbytes=True), np.uint8).reshape(8, n).T).view("<u8").reshape(-1) for x in (keys, counts))
    return np.cumsum(steps), number.astype(np.int64)


class _Pairs:
    """Distinct pairs (context, word) in order."""

    def __init__(self, contexts: np.ndarray, ids: np.ndarray, bits: int, inverse: bool = False):
        top = int(contexts.max(initial=0)).bit_length()
        self.inverse = None
        if top + bits <= 64:
            both = (contexts.astype(np.uint64) << np.uint64(bits)) | ids.astype(np.uint64)
            if inverse:
                both, self.inverse = np.unique(both, return_inverse=True)
                self.counts = None
            else:
                both, self.counts = np.unique(both, return_counts=True)
            self.contexts, self.ids = (both >> np.uint64(bits)).astype(np.int64), (both & np.uint64((1 << bits) - 1)).astype(np.int64)
            return
        order = np.lexsort((ids, contexts))
        contexts, ids = contexts[order], ids[order]
        new = np.append(True, (contexts[1:] != contexts[:-1]) | (ids[1:] != ids[:-1]))[: len(ids)]
        first = np.flatnonzero(new)
        self.contexts, self.ids, self.counts = contexts[first], ids[first], np.diff(np.append(first, len(ids)))
        if inverse:
            self.inverse = np.empty(len(order), np.int64)
            self.inverse[order] = np.cumsum(new) - 1


class _Counter:
    """Counts of the pairs a task has read, given out by block in bounded pieces."""

    def __init__(self, level: Level, word_bits: int, words: int):
        self.level, self.bits, self.words, self.parts, self.size = level, word_bits, words, [], 0

    def add(self, contexts: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((contexts, ids))
        self.size += len(ids)
        if self.size >= FLUSH:
            yield from self.give()

    def give(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        contexts, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        pairs = _Pairs(contexts, ids, self.bits)
        block, start = self.level.block(pairs.contexts, pairs.ids, self.words)
        keys = ((pairs.contexts - self.level.starts[start]).astype(np.uint64) << np.uint64(self.bits)) | pairs.ids.astype(np.uint64)
        edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
        rows = [(int(block[a]) // self.level.per_file, int(block[a]), int(b - a), *_packed(keys[a:b], pairs.counts[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield _record(rows)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "block", "n", "keys", "counts"])


class Reader:
    """The trie as tasks search it."""

    def __init__(self, model: Model):
        self.model = model

    def _by_file(self, level: int, block: np.ndarray) -> Iterator[tuple]:
        """For blocks in order each file and the places of those in it; blocks that were never written are left out."""
        own = self.model.levels[level]
        at = block // own.per_file
        edges = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1]))[: len(at)], len(at))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if int(at[a]) in own.files:
                blocks = opened(own.files[int(at[a])])
                yield blocks, a + np.flatnonzero(blocks.held(block[a:b]))

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and count of each word; the id is -1 where it is unknown."""
        own = self.model.levels[1]
        some, back = np.unique(hashes, return_inverse=True)
        bits = len(own.parts).bit_length() - 1
        block = (some >> np.uint64(64 - bits)).astype(np.int64)
        node, count = np.full(len(some), -1, np.int64), np.zeros(len(some), np.int64)
        for blocks, at in self._by_file(1, block):
            index = blocks.find(block[at], some[at] & np.uint64((1 << (64 - bits)) - 1))
            at, index = at[index >= 0], index[index >= 0]
            count[at] = blocks.column("counts", "u8", block[at], index)
            node[at] = index + own.bases[block[at]]
        return node[back], count[back]

    def follow(self, level: int, contexts: np.ndarray, ids: np.ndarray, valued: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node of level `level`, its probability and the context's weight (both read only if `valued`), for contexts that are nodes (not -1) of the level before; an id of -1 has no node."""
        own, model = self.model.levels[level], self.model
        live = np.flatnonzero(contexts >= 0)
        # unknown words are looked up as the first one, for the weight of their context alone
        pairs = _Pairs(contexts[live], np.maximum(ids[live], 0), model.word_bits, inverse=True)
        block, start = own.block(pairs.contexts, pairs.ids, model.words)
        offset = pairs.contexts - own.starts[start]
        keys = (offset.astype(np.uint64) << np.uint64(model.word_bits)) | pairs.ids.astype(np.uint64)
        found, p, weight = np.full(len(keys), -1, np.int64), np.zeros(len(keys)), np.ones(len(keys))
        for blocks, at in self._by_file(level, block):
            if valued:
                weight[at] = _VALUE[blocks.column("weights", "u2", block[at], offset[at])]
            index = blocks.find(block[at], keys[at])
            at, index = at[index >= 0], index[index >= 0]
            if valued:
                p[at] = _VALUE[blocks.column("codes", "u2", block[at], index)]
            found[at] = index + own.bases[block[at]]
        node, out_p, out_weight = np.full(len(ids), -1, np.int64), np.zeros(len(ids)), np.ones(len(ids))
        known = ids[live] >= 0
        node[live] = np.where(known, found[pairs.inverse], -1)
        if valued:
            many = own.parts[start] > 1
            weight[many] = own.weights[start[many]]
            out_p[live], out_weight[live] = np.where(known, p[pairs.inverse], 0.0), weight[pairs.inverse]
        return node, out_p, out_weight

    def nodes(self, level: int, ids: np.ndarray, place: np.ndarray, valued: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each level from 2 up to `level`: node of the n-gram that ends at each token, its probability and its context's weight."""
        node = ids
        for n in range(2, level + 1):
            before = np.full(len(ids), -1, np.int64)
            inside = np.flatnonzero(place >= n - 1)
            before[inside] = node[inside - 1]
            node, p, weight = self.follow(n, before, ids, valued)
            yield node, p, weight


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def train(texts: DataFrame, order: int = ORDER, discount: float = DISCOUNT, min_count: int = MIN_COUNT, block_tokens: int = BLOCK) -> Model:
    """Counts and writes all levels; `texts` has the one column text."""
    spark = bound(texts.sparkSession)
    size = texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = 8 << max(0, int(size // (512 * block_tokens)).bit_length())
    model = Model(located(spark, f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"), order)
    level = Level(np.arange(blocks, dtype=np.int64), np.ones(blocks, np.int64), np.zeros(blocks, np.int64))
    for n in range(1, order + 1):
        shared = spark.sparkContext.broadcast((model, level))
        counted = texts.mapInArrow(_counting(shared, n), _PAIRS)
        files = -(-int(level.first[-1]) // level.per_file)
        ordered = counted.repartition(files, "file").sortWithinPartitions("file", "block")
        rows = sorted(ordered.mapInArrow(_building(shared, n, discount, min_count, block_tokens), _BUILT).collect(), key=lambda r: r["block"])  # a row for each block
        model.levels[n] = level
        level = _settle(model, n, rows)
        shared.unpersist()
    return model


def _settle(model: Model, n: int, rows: list) -> Level:
    """Puts what the blocks of level n hold together, and cuts the next level."""
    level = model.levels[n]
    sizes, mass = np.zeros(level.first[-1], np.int64), np.zeros(level.first[-1])
    for r in rows:
        sizes[r["block"]], mass[r["block"]] = r["n"], r["mass"]
        level.files[r["block"] // level.per_file] = r["file"]
    level.bases = np.append(0, np.cumsum(sizes))
    level.weights = np.maximum(1 - np.add.reduceat(mass, level.first[:-1]), 1e-6) if len(level.parts) else mass
    if n == 1:
        model.tokens, model.words = sum(r["tokens"] for r in rows), int(level.bases[-1])
        model.word_bits = max(1, model.words.bit_length())
    cuts = [(int(level.bases[r["block"]]) + rank, parts, total) for r in rows for rank, parts, total in zip(r["ranks"], r["parts"], r["totals"], strict=True)] or [(0, 1, 0)]
    return Level(*(np.array(x, np.int64) for x in zip(*cuts, strict=True)))


def _counting(shared, n: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, level = shared.value
        if n == 1:
            yield from _counting_words(batches, level)
            return
        reader, counter = Reader(model), _Counter(level, model.word_bits, model.words)
        for batch in W.joined(W.parts(batches, 512), TEXTS):
            tokens, place = _tokens(batch.column(0))
            ids, _ = reader.words(tokens)
            node = ids
            for node, _, _ in reader.nodes(n - 1, ids, place, valued=False):
                pass
            after = np.flatnonzero(place >= n - 1)
            after = after[node[after - 1] >= 0]
            yield from counter.add(node[after - 1], ids[after])
        yield from counter.give()

    return count


def _counting_words(batches: Iterator[pa.RecordBatch], level: Level) -> Iterator[pa.RecordBatch]:
    bits = len(level.parts).bit_length() - 1
    mask = np.uint64((1 << (64 - bits)) - 1)

    def give(held: list[np.ndarray]) -> pa.RecordBatch:
        words, counts = np.unique(np.concatenate(held), return_counts=True)
        block = (words >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
        return _record([(int(block[a]) // level.per_file, int(block[a]), int(b - a), *_packed(words[a:b] & mask, counts[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)])

    held: list[np.ndarray] = []
    for batch in W.parts(batches, 128):
        held.append(_tokens(batch.column(0))[0])
        if sum(map(len, held)) >= FLUSH:
            yield give(held)
            held = []
    if held:
        yield give(held)


def _building(shared, n: int, discount: float, min_count: int, block_tokens: int):
    """Writes the blocks that a task gets in order; one block at a time is held."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, level = shared.value
        writer, file, rows, block, held = None, None, [], None, []

        def finish() -> None:
            if held:
                rows.append(_write_block(writer, model, level, n, block, held, discount, min_count, block_tokens))
                held.clear()

        def close() -> Iterator[pa.RecordBatch]:
            if writer:
                uri = writer.close()
                W.trim()
                yield _built([(*r[:4], uri, *r[4:]) for r in rows])
                rows.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                of, at, size, keys, counts = (batch.column(c)[k].as_py() for c in range(5))
                if at != block:
                    finish()
                    block = at
                if of != file:
                    yield from close()
                    writer, file = Writer(f"{model.folder}/level-{n}", of * level.per_file), of
                held.append(_unpacked(size, keys, counts))
        finish()
        yield from close()

    return build


def _built(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "n", "tokens", "mass", "file", "ranks", "parts", "totals"])


def _write_block(writer: Writer, model: Model, level: Level, n: int, block: int, held: list, discount: float, min_count: int, block_tokens: int) -> tuple:
    keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys, kind="stable")  # merges what is in order already
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    keys, counts = keys[first], np.add.reduceat(counts, first)
    mass = 0.0
    if n == 1:
        bits = 64 - (len(level.parts).bit_length() - 1)
        writer.add(block, keys, bits, {"counts": counts.astype(np.uint64)})
        followed = np.where(keys == _END & np.uint64((1 << bits) - 1), 0, counts) if block == int(_END >> np.uint64(bits)) else counts
    else:
        start = int(np.searchsorted(level.first, block, "right")) - 1
        many = level.parts[start] > 1
        contexts = (keys >> np.uint64(model.word_bits)).astype(np.int64)
        number = int(contexts[-1]) + 1
        after = level.starts[start + 1] if start + 1 < len(level.starts) else model.levels[n - 1].bases[-1]
        number = max(number, int(after - level.starts[start]))
        total = np.full(number, level.totals[start]) if many else np.bincount(contexts, counts, number)
        tokens, kept = int(counts.sum()), counts >= min_count
        keys, contexts, counts = keys[kept], contexts[kept], counts[kept]
        p = (counts - discount) / total[contexts]
        codes, left = _code(p), 1 - np.bincount(contexts, p, number)
        mass = float(1 - left[0]) if many else 0.0
        bits = model.word_bits + max(1, number.bit_length())
        writer.add(block, keys, bits, {"codes": codes, "weights": _code(np.maximum(left, 1e-6))})
        followed = counts
    ranks, parts, totals = _cuts(followed, block_tokens)
    return block, len(keys), int(counts.sum()) if n == 1 else tokens, mass, ranks, parts, totals


def _cuts(counts: np.ndarray, block_tokens: int) -> tuple[list[int], list[int], list[int]]:
    """Where the next level is cut: nodes that begin a block, the number of blocks and of tokens of each that has several; at the first node too."""
    if not len(counts):
        return [], [], []
    large = counts > block_tokens
    begins = large.copy()
    begins[0] = True
    begins[1:] |= large[:-1]
    run = np.cumsum(np.where(large, 0, counts)) // block_tokens
    begins[1:] |= run[1:] != run[:-1]
    ranks = np.flatnonzero(begins)
    parts = np.where(large[ranks], -(-counts[ranks] // block_tokens), 1)
    return ranks.tolist(), parts.tolist(), np.where(parts > 1, counts[ranks], 0).tolist()


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every text."""
    spark = bound(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader = Reader(model)
        for batch in W.joined(W.parts(batches, 512), TEXTS):
            tokens, place = _tokens(batch.column(1))
            ids, count = reader.words(tokens)
            p = base = (count + 1) / (model.tokens + model.words + 1)
            for _, own, weight in reader.nodes(model.order, ids, place):
                p = own + weight * p
            starts = np.flatnonzero(place == 0)
            sums = [np.add.reduceat(x, starts) if len(starts) else x[:0] for x in ((count > 0).astype(np.int64), np.log10(base), np.log10(p))]
            sizes = np.diff(np.append(starts, len(tokens)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *(pa.array(x) for x in sums)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~is_held_out(F.col("doc_id"))).select("text"))
    out = score(docs, model)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
