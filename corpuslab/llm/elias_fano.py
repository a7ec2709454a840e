"""Elias-Fano coded blocks of sorted integers, and the memory-mapped files that hold them.

A file has blocks one after the other and a directory at its end, so that a task
writes it as a stream.  In a block the low bits of the keys are packed, the high
bits are in unary, the place of every sixteenth zero of the unary part is kept, and
so is the number of zeros before each word of it, so that no search runs over the
many keys that may share their high bits; further columns of the block follow.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import OrderedDict

import numpy as np
from pyarrow import fs

_ONE, _WORD = np.uint64(1), np.uint64(63)
_EVERY = 16
_ODD, _PAIRS, _NIBBLES, _BYTES, _TOPS = (np.uint64(x * 0x0101010101010101) for x in (0x55, 0x33, 0x0F, 0x01, 0x80))
#: Of each rank and byte the place of the set bit with that rank.
_IN_BYTE = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[r] for r in range(8) for b in range(256)], np.int64)
#: Bytes of files that are read whole, where the store is not a file system of the machine.
HELD = 256 << 20


def encode(values: np.ndarray, bits: int) -> tuple[dict[str, np.ndarray], int]:
    """Arrays that hold sorted distinct values below 2**bits, and the number of low bits."""
    n = len(values)
    low = max(0, bits - max(n, 1).bit_length())
    values = values.astype(np.uint64)
    packed = np.zeros(n * low // 64 + 2, np.uint64)
    place = np.arange(n, dtype=np.uint64) * np.uint64(low)
    word, shift = (place >> np.uint64(6)).astype(np.int64), place & _WORD
    lows = values & ((_ONE << np.uint64(low)) - _ONE)
    _or_into(packed, word, lows << shift)
    over = shift + np.uint64(low) > 64
    _or_into(packed, word[over] + 1, lows[over] >> (np.uint64(64) - shift[over]))
    high = values >> np.uint64(low)
    zeros = 1 << (bits - low)
    ones = high + np.arange(n, dtype=np.uint64)
    unary = np.zeros((n + zeros) // 64 + 2, np.uint64)
    _or_into(unary, (ones >> np.uint64(6)).astype(np.int64), _ONE << (ones & _WORD))
    # the k-th zero stands behind all values whose high part is at most k
    k = np.arange(0, zeros, _EVERY)
    samples = np.append(k + np.searchsorted(high, k.astype(np.uint64), "right"), n + zeros).astype(np.uint32)
    before = np.cumsum(64 - np.bitwise_count(unary).astype(np.int64))
    return {"low": packed, "high": unary, "samples": samples, "before": np.append(0, before[:-1]).astype(np.uint32)}, low


def _or_into(out: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """out[at] |= bits for `at` in order."""
    if len(at):
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[first]] |= np.bitwise_or.reduceat(bits, first)


def _select(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit with that rank, which every word has: its byte by sums of counts by byte, its place in the byte from a table."""
    sums = word - ((word >> np.uint64(1)) & _ODD)
    sums = (sums & _PAIRS) + ((sums >> np.uint64(2)) & _PAIRS)
    sums = ((sums + (sums >> np.uint64(4))) & _NIBBLES) * _BYTES
    rank = rank.astype(np.uint64)
    # bytes up to which there are no more set bits than the rank
    at = np.bitwise_count(((rank * _BYTES | _TOPS) - sums) & _TOPS).astype(np.uint64) << np.uint64(3)
    rank -= ((sums << np.uint64(8)) >> at) & np.uint64(255)
    return at.astype(np.int64) + _IN_BYTE[(rank << np.uint64(8)) | ((word >> at) & np.uint64(255))]


class Blocks:
    """Search in one file."""

    def __init__(self, raw: np.ndarray):
        size = int.from_bytes(raw[-8:].tobytes(), "little")
        head = json.loads(raw[len(raw) - 8 - size : len(raw) - 8].tobytes())
        body = raw[: (len(raw) - 8 - size) // 8 * 8]
        self.words, self.halves, self.shorts = body.view(np.uint64), body.view(np.uint32), body.view(np.uint16)
        self.first: int = head["first"]
        self.at = {k: np.array(v, np.int64) for k, v in head["at"].items()}
        self.width, self.filled = np.array(head["width"], np.uint64), np.array(head["filled"], bool)

    def held(self, block: np.ndarray) -> np.ndarray:
        """Whether each block was written, and not left out."""
        of = block - self.first
        inside = of < len(self.filled)
        return inside & self.filled[np.where(inside, of, 0)]

    def column(self, name: str, kind: str, block: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Entries of a column of blocks."""
        at = self.at[name][block - self.first]
        return self.shorts[at // 2 + index] if kind == "u2" else self.words[at // 8 + index]

    def _bits(self, base: np.ndarray, place: np.ndarray) -> np.ndarray:
        """64 bits from a place on, counted from the word `base`."""
        word, shift = base + (place >> 6), place.astype(np.uint64) & _WORD
        return (self.words[word] >> shift) | (self.words[word + 1] << _ONE << (_WORD - shift))

    def _zero(self, of: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the unary part, k from 0."""
        samples, before = self.at["samples"][of] // 4 + k // _EVERY, self.at["before"][of] // 4
        # the last word with no more than k zeros before it
        word, last = (self.halves[x].astype(np.int64) >> 6 for x in (samples, samples + 1))
        while len(live := np.flatnonzero(word < last)):
            mid = (word[live] + last[live] + 1) >> 1
            fits = self.halves[before[live] + mid] <= k[live]
            word[live] = np.where(fits, mid, word[live])
            last[live] = np.where(fits, last[live], mid - 1)
        rank = k - self.halves[before + word].astype(np.int64)
        return (word << 6) + _select(~self.words[self.at["high"][of] // 8 + word], rank)

    def find(self, block: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Index in its block of each value, or -1: the high bits name a short range, in which the successor of the low bits is searched; neighbours with the same high bits share it."""
        of, values = block - self.first, values.astype(np.uint64)
        width, base = self.width[of], self.at["low"][of] // 8
        high, mask = (values >> width).astype(np.int64), (_ONE << width) - _ONE
        want = values & mask
        first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (high[1:] != high[:-1]))[: len(of)])
        begin, size = self._range(of[first], high[first])
        shared = np.diff(np.append(first, len(values)))
        lo, size = np.repeat(begin - high[first], shared), np.repeat(size, shared)
        stop = lo + size
        # the last key of each range that is not above its value, or the first one
        at, live, start, own = lo.copy(), np.arange(len(values)), lo, (base, width, mask, want)
        while len(some := np.flatnonzero(size > 1)):
            if 4 * len(some) < 3 * len(size):
                at[live] = start
                live, start, size, own = live[some], start[some], size[some], tuple(x[some] for x in own)
            half = size >> 1
            start = start + half * (self._lows(*own[:3], start + half) <= own[3])
            size = size - half
        at[live] = start
        hit = (at < stop) & (self._lows(base, width, mask, at) == want)
        return np.where(hit, at, -1)

    def _range(self, of: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each high part the place of its first one in the unary part and the number of its ones."""
        begin = np.where(high > 0, self._zero(of, np.maximum(high - 1, 0)) + 1, 0)
        zeros = ~self._bits(self.at["high"][of] // 8, begin)
        size = np.bitwise_count((zeros & (~zeros + _ONE)) - _ONE).astype(np.int64)
        long = np.flatnonzero(size == 64)
        size[long] = self._zero(of[long], high[long]) - begin[long]
        return begin, size

    def _lows(self, base: np.ndarray, width: np.ndarray, mask: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._bits(base, at * width.astype(np.int64)) & mask


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Writer:
    """Writes blocks `first`, first + 1 and so on to a new file; blocks that are left out are empty ones."""

    def __init__(self, folder: str, first: int):
        self.uri = f"{folder}/{uuid.uuid4().hex}.ef"
        store, path = _store(self.uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        self.out, self.size = store.open_output_stream(path), 0
        self.first, self.width, self.filled, self.at = first, [], [], {}

    def add(self, block: int, keys: np.ndarray, bits: int, columns: dict[str, np.ndarray]) -> None:
        while self.first + len(self.width) < block:
            self._put(np.zeros(0, np.uint64), 1, {k: v[:0] for k, v in columns.items()}, False)
        self._put(keys, bits, columns, True)

    def _put(self, keys: np.ndarray, bits: int, columns: dict[str, np.ndarray], filled: bool) -> None:
        arrays, low = encode(keys, bits)
        self.width.append(low)
        self.filled.append(filled)
        for name, a in (arrays | columns).items():
            self.at.setdefault(name, []).append(self.size)
            data = a.tobytes() + b"\0" * (-a.nbytes % 8)
            self.out.write(data)
            self.size += len(data)

    def close(self) -> str:
        head = json.dumps({"first": self.first, "width": self.width, "filled": self.filled, "at": self.at}).encode()
        self.out.write(head + len(head).to_bytes(8, "little"))
        self.out.close()
        return self.uri


_mapped: dict[str, Blocks] = {}
_read: OrderedDict[str, tuple[int, Blocks]] = OrderedDict()


def opened(uri: str) -> Blocks:
    """The blocks of a file: mapped where the store is a file system of the machine; else read, and the files read last kept."""
    if uri in _mapped:
        return _mapped[uri]
    if uri in _read:
        _read.move_to_end(uri)
        return _read[uri][1]
    store, path = _store(uri)
    if store.type_name == "local":
        if len(_mapped) >= 4096:
            _mapped.clear()
        _mapped[uri] = Blocks(np.asarray(np.memmap(path, np.uint8, "r")))
        return _mapped[uri]
    with store.open_input_file(path) as f:
        raw = np.frombuffer(f.read(), np.uint8)
    _read[uri] = (len(raw), Blocks(raw))
    while len(_read) > 1 and sum(n for n, _ in _read.values()) > HELD:
        _read.popitem(last=False)
    return _read[uri][1]
