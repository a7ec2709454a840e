"""Token counts by the piece vocabulary, with huge documents encoded in overlapping chunks.

A document longer than `chunk` characters becomes rows of one core each, which any
task may take.  A core is encoded together with `overlap` characters of its
neighbours.  Near a cut both encodings have tokens, and they are spliced behind a
token that stands at the same bytes in both.

That place is proven, not guessed: pairs are merged by the score of what they
make, so a row of pieces is the encoding of its text if, and only if, each two
neighbours are the encoding of what they spell together (the first merge over a
border between two pieces would also be made with these two alone).  All
neighbours inside a chunk are such pairs, and behind a common token the next one
was its neighbour in the second chunk.  The spliced row therefore is the encoding
of the whole document, however the chunks were cut.

Where an overlap has no common token, both chunks are encoded again with one, then
two, four and more whole cores on either side.  Once they hold the whole document
they are equal, so this ends.

Null and empty texts have no tokens.  Rows are independent: repeated rows, ties,
null ids and copies of huge texts are counted each for itself; an empty table
gives an empty result; further columns are ignored.  U+2581 is counted as the
space that the vocabulary takes it for.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import wordhash as W
from corpuslab.llm.batches import bound, written
from corpuslab.llm.packing import public_path

LIMIT, CHUNK, OVERLAP = 4096, 1 << 15, 256
MARK = "▁"


class PieceEncoder:
    """Piece ids of texts and the number of bytes that each id stands for."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(map(self.model.id_to_piece, range(n)))]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@cache
def encoder(path: str) -> PieceEncoder:
    """One for each Python worker, kept from task to task."""
    return PieceEncoder(path)


_CORES = "row long, doc_id {kind}, n_bytes long, part int, parts int, n_tokens long, start long, stop long, lead string, core string, tail string"


def _cores(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Documents of up to `chunk` characters with their count; others as cores with what is next to them, counted later."""

    def cells(text: str) -> Iterator[tuple]:
        parts, at = -(-len(text) // chunk), 0
        for part in range(parts):
            a, b = part * chunk, (part + 1) * chunk
            core = text[a:b]
            stop = at + len(core.encode())
            yield part, parts, None, at, stop, text[max(0, a - overlap) : a], core, text[b : b + overlap]
            at = stop

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.parts(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            short = [k for k, t in enumerate(texts) if len(t) <= chunk]
            counts = encoder(path).encode([texts[k] for k in short])
            yield rows(batch, sizes, short, [(0, 1, len(ids), *[None] * 5) for ids in counts])
            for k, t in enumerate(texts):
                if len(t) > chunk:
                    pieces = cells(t.replace(MARK, " "))
                    while held := list(itertools.islice(pieces, 64)):
                        yield rows(batch, sizes, [k] * len(held), held)

    def rows(batch: pa.RecordBatch, sizes: list[int], at: list[int], found: list[tuple]) -> pa.RecordBatch:
        where = pa.array(at, pa.int64())
        columns = list(zip(*found, strict=True)) or [()] * len(kinds)
        own = [batch.column(0).take(where), batch.column(1).take(where), pa.array([sizes[k] for k in at], pa.int64())]
        return pa.RecordBatch.from_arrays([*own, *map(pa.array, columns, kinds)], names)

    names = ["row", "doc_id", "n_bytes", "part", "parts", "n_tokens", "start", "stop", "lead", "core", "tail"]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 3, *[pa.string()] * 3]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(cut, _CORES.format(kind=kind))


_TOKENS = "array<struct<a: bigint, b: bigint, id: int>>"
_ENCODED = f"row long, part int, last boolean, n long, head {_TOKENS}, head_at long, foot {_TOKENS}, foot_at long"


def _encoded(windows: DataFrame, path: str, overlap: int) -> DataFrame:
    """Number of tokens of every window, and those within `overlap` bytes of the start of its core (head) and of its stop (foot), with the number of tokens before them."""
    token = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("id", pa.int32())])

    def near(ids: np.ndarray, ends: np.ndarray, cut: int) -> tuple[list[dict], int]:
        lo, hi = np.searchsorted(ends, [cut - overlap, cut + overlap], "right")
        lo = max(int(lo), 1)  # the first token may hold the space that is put before a text
        spans = zip(ends[lo - 1 : hi - 1].tolist(), ends[lo:hi].tolist(), ids[lo:hi].tolist(), strict=True)
        return [{"a": a, "b": b, "id": i} for a, b, i in spans], lo

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in W.parts(batches, 16):
            out = []
            places = zip(*(batch.column(c).to_pylist() for c in ("begin", "start", "stop")), strict=True)
            for ids, (begin, start, stop) in zip(own.encode(batch.column("window").to_pylist()), places, strict=True):
                ids = np.asarray(ids, np.int32)
                ends = begin - 1 + np.cumsum(own.lengths[ids])
                out.append((len(ids), *near(ids, ends, start), *near(ids, ends, stop)))
            kinds = [pa.int64(), pa.list_(token), pa.int64(), pa.list_(token), pa.int64()]
            columns = [*batch.columns[:3], *map(pa.array, zip(*out, strict=True), kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "part", "last", "n", "head", "head_at", "foot", "foot_at"])

    return windows.select("row", "part", "last", "begin", "start", "stop", "window").mapInArrow(run, _ENCODED)


def _first_windows(cores: DataFrame) -> DataFrame:
    begin = F.col("start") - F.octet_length("lead")
    return cores.select("row", "part", (F.col("part") == F.col("parts") - 1).alias("last"), begin.alias("begin"), "start", "stop", F.concat("lead", "core", "tail").alias("window"))


def _wider_windows(cores: DataFrame, failed: DataFrame, more: int) -> DataFrame:
    """The chunks on both sides of `failed` cuts with `more` whole cores before and behind them."""
    wanted = failed.select("row", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("of")).distinct()
    reach = wanted.select("row", "of", F.explode(F.sequence(F.col("of") - more, F.col("of") + more)).alias("part"))
    pieces = reach.join(cores.select("row", "part", "parts", "start", "stop", "core"), ["row", "part"])
    own = F.col("part") == F.col("of")
    return pieces.groupBy("row", F.col("of").alias("part")).agg(
        (F.max("parts") - 1 == F.first("of")).alias("last"),
        F.min("start").alias("begin"),
        F.max(F.when(own, F.col("start"))).alias("start"),
        F.max(F.when(own, F.col("stop"))).alias("stop"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "core"))), lambda x: x["core"]), "").alias("window"),
    )


def _seams(encoded: DataFrame) -> DataFrame:
    """(row, part, moved): for the cut behind each part, how many tokens the sum over parts counts too few or too many; null if nothing is common."""
    left = encoded.where("not last").select("row", "part", "foot", "foot_at")
    right = encoded.where("part > 0").select("row", (F.col("part") - 1).alias("part"), "head", "head_at")
    both = left.join(right, ["row", "part"]).withColumn("common", F.array_intersect("foot", "head"))
    token = F.get("common", F.floor(F.size("common") / 2).cast("int"))
    place = lambda tokens, at: F.col(at) + F.array_position(tokens, token)
    return both.select("row", "part", (place("foot", "foot_at") - place("head", "head_at")).alias("moved"))


def count(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; `chunk` has to be over twice `overlap`, and that longer than any piece."""
    if not 64 <= overlap < chunk / 2:
        raise ValueError("an overlap has at least 64 characters, a chunk more than two overlaps")
    path = path or public_path("piece_bpe_32k.model")
    bound(docs.sparkSession)
    all_rows = written(_cores(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), path, chunk, overlap), "cores")
    cores = all_rows.where("parts > 1")
    spread = lambda windows: windows.repartition("row", "part")
    encoded = written(_encoded(spread(_first_windows(cores)), path, overlap), "encoded")
    seams, more = written(_seams(encoded), "seams"), 1
    while (failed := seams.where("moved is null")).head(1):
        again = _encoded(spread(_wider_windows(cores, failed, more)), path, overlap)
        kept = encoded.join(failed.select("row", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part")), ["row", "part"], "left_anti")
        encoded = written(kept.unionByName(again), "encoded")
        seams, more = written(_seams(encoded), "seams"), more * 2
    terms = cores.where("part = 0").select("row", "doc_id", "n_bytes", F.lit(0).cast("long").alias("n"))
    nothing = [F.lit(None).cast(cores.schema[c].dataType).alias(c) for c in ("doc_id", "n_bytes")]
    for part in (encoded.where("last").select("row", *nothing, "n"), seams.select("row", *nothing, F.col("moved").alias("n"))):
        terms = terms.unionByName(part)
    huge = terms.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    found = all_rows.where("parts = 1").select("doc_id", "n_bytes", "n_tokens").unionByName(huge.drop("row"))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(spark.read.parquet(f"{sf_dir}/documents.parquet"))
