"""Vectorised word, n-gram and selection hashing over Arrow string columns.

Everything here works on the UTF-8 bytes of one Arrow batch with numpy, inside
Spark tasks.  Words are maximal runs of bytes outside the six ASCII white-space
bytes, so a multi-byte character never splits.  Hashes are 64 bits wide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are neither letters, digits nor part of a longer character.
NOT_WORD = np.zeros(256, bool)
NOT_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser; spreads all bits of every value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLOCK = 1 << 18


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of the base."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _INVERSES = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span, computed over blocks of bytes, so that memory does not grow with a text; a word longer than a block takes one of its own."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        block = data[base : ends[j - 1]]
        n = len(block)
        power, inverse = (_POWER[:n], _INVERSES[:n]) if n <= _BLOCK else (_powers(_BASE, n), _powers(_INVERSE, n))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[block] * power, out=total[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
        i = j
    return out


@dataclass
class Words:
    """Words of a batch: hash, byte start and end of each; document d owns words first[d]:first[d+1]."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(texts: pa.Array, lower: bool = False, hashed: bool = True, parted: np.ndarray = _SPACE) -> Words:
    """Words of every text, between bytes of `parted`; A-Z become lower case first if asked.  Null and blank texts have none."""
    data, offsets = _buffers(texts)
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64), data)
    if lower:
        data = _LOWER[data]
    inside = ~parted[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    if not hashed:
        return Words(np.zeros(0, np.uint64), starts, ends, first, data)
    return Words(_word_hashes(data, starts, ends), starts, ends, first, data)


def _shifted(a: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(a)
    out[: max(len(a) - k, 0)] = a[k:]
    return out


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` consecutive words that start at each word; the last size-1 entries mean nothing.

    Built by doubling: a run of m + n words is the run of m, shifted on, plus the run of n.
    """
    block, width = hashes, 1
    out, done = None, 0
    while size:
        if size & 1:
            if out is None:
                out, done = block, width
            else:
                out, done = block * _step_power(done) + _shifted(out, width), done + width
        size >>= 1
        if size:
            block, width = block * _step_power(width) + _shifted(block, width), 2 * width
    return mix(out)


def _step_power(n: int) -> np.uint64:
    return np.uint64(pow(int(_STEP), n, 1 << 64))


def sliding_min(a: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each `size` entries that start at an entry; the last size-1 see fewer."""
    out, width = a.copy(), 1
    while width < size:
        step = min(width, size - width)
        if step < len(out):
            out[:-step] = np.minimum(out[:-step], out[step:])
        width += step
    return out


def parts(batches, rows: int = 64, size: int = 512 << 10):
    """The batches in slices of few rows and bytes, whose arrays stay in the CPU's caches; a longer row is a slice of its own.  At the end freed memory is given back."""
    for batch in batches:
        if batch.nbytes <= size:
            if batch.num_rows:
                yield from (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))
            continue
        wide = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                wide += np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
        edges, k = np.append(0, np.cumsum(wide)), 0
        while k < batch.num_rows:
            stop = min(k + rows, max(k + 1, int(np.searchsorted(edges, edges[k] + size, "right")) - 1))
            yield batch.slice(k, stop - k)
            k = stop
    trim()


def joined(batches, size: int):
    """The batches put together until they have `size` bytes, for work with a cost for each batch."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield _together(held)
            held, total = [], 0
    if held:
        yield _together(held)


def _together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(k) for b in batches]) for k in range(batches[0].num_columns)], names=batches[0].schema.names)


def owners(w: Words) -> np.ndarray:
    """Index of the document of every word."""
    return np.repeat(np.arange(len(w.first) - 1), w.counts)


def whole_windows(w: Words, size: int) -> np.ndarray:
    """Positions where a window of `size` words lies within one document."""
    left = np.repeat(w.first[1:], w.counts) - np.arange(len(w.starts))
    return np.flatnonzero(left >= size)


def trim() -> None:
    """Gives freed memory of this Python worker back; workers are kept between tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)
