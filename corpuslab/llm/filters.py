"""Summaries of bounded size: a count sketch and a Bloom filter over 64-bit hashes.

Both only save work.  The sketch orders hashes from rare to frequent; any order
gives the same result.  What passes the filter is counted exactly afterwards.
The filter has as many bits as its keys need for one false hit in a hundred, up
to 2**MOST_BITS; with more keys than that it lets more through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKETCH_BITS, SKETCH_PARTS, LEAST_BITS, MOST_BITS = 20, 64, 16, 28


def sketch_rows(counts: np.ndarray) -> pa.RecordBatch:
    """The counts of one task in parts: (part int, n binary)."""
    parts = np.split(counts.astype("<u4"), SKETCH_PARTS)
    return pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "n"])


def gather_sketch(rows: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Sum of the counts of all tasks: 2**bits entries, whatever the input."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in table["n"])
        return pa.table({"part": table["part"][:1], "n": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(1 << bits, np.int64)
    size = len(out) // SKETCH_PARTS
    for r in rows.groupBy("part").applyInArrow(add, "part int, n binary").collect():
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["n"], np.int64)
    return out


def frequency_levels(sketch: np.ndarray) -> np.ndarray:
    """How far each bucket lies above the usual one, in standard deviations of chance; 0 for usual buckets."""
    usual = max(float(np.median(sketch)), 1.0)
    return np.maximum(0, np.minimum(np.round((sketch - usual) / np.sqrt(usual) - 3), 60_000)).astype(np.uint16)


def bucket(hashes: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    return (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def bloom_bits(keys: int) -> int:
    """Bits (as a power of 2) at which fewer than one key in a hundred that was not put in seems to be."""
    return min(MOST_BITS, max(LEAST_BITS, (18 * keys).bit_length()))


def bloom(hashes: DataFrame, bits: int | None = None) -> np.ndarray:
    """Filter of the one long column of `hashes`, which is read once to count it unless `bits` is given: at most 2**(bits - 6) rows to the driver."""
    bits = bloom_bits(hashes.count()) if bits is None else bits

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            for place in _places(batch.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(words, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        at = np.flatnonzero(words)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 16)]), pa.array(words[at[k : k + (1 << 16)]].view(np.int64))], ["at", "bits"])

    table = hashes.mapInArrow(own, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table["at"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False only for hashes that were not put in."""
    bits = int(len(words)).bit_length() + 5
    one, two = ((words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) for p in _places(hashes, bits))
    return (one & two).astype(bool)
