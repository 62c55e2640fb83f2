"""Vectorised text primitives shared by the operators: Arrow buffers as numpy bytes, spans, their hashes, kept results.

`span_hash` sums a value drawn for each (place in the span, eight bytes), so no text has a structure that makes it collide;
`distinct_spans` and `Kept` hold bytes against bytes wherever a hash stands for a text within a worker. `Rolling` is a
polynomial hash modulo 2**64, which periodic texts can make collide: it only ever proposes, and bytes decide. All values
come from splitmix64 of small integers, hence are the same in every worker and every run.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LIBC = ctypes.CDLL(None) if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim") else None
#: Text bytes that one vectorised step handles; bounds a worker's memory, never what is read.
STEP_BYTES = 2 << 20


def splitmix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    with np.errstate(over="ignore"):
        z = np.asarray(x, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


BYTE_VALUES = splitmix64(np.arange(256, dtype=np.uint64))
_BASE = int(splitmix64(np.array([1 << 20], dtype=np.uint64))[0]) | 1
_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or of its inverse; grown on demand and kept by the worker."""
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


class Rolling:
    """Prefix sums over a sequence of 64-bit values, for the hash of any of its spans."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * powers(n), out=self.prefix[1:])
        self.inverse = powers(n + 1, inverse=True)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return splitmix64((self.prefix[end] - self.prefix[start]) * self.inverse[start])


#: Bytes of a span up to which all spans are read together, eight bytes at a time; longer ones one by one.
_TOGETHER = 256
_HEAD_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


def _at_place(word: np.ndarray, place: np.ndarray) -> np.ndarray:
    return splitmix64(word ^ splitmix64(place.astype(np.uint64) + np.uint64(1 << 32)))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span data[start:end]: the sum over its eight-byte words of a value drawn for (place, word)."""
    size, words = end - start, eights(data)
    out = size.astype(np.uint64)
    at, k = np.flatnonzero((size > 0) & (size <= _TOGETHER)), 0
    while len(at):
        left = size[at] - 8 * k
        out[at] += _at_place(words[start[at] + 8 * k] & _HEAD_BYTES[np.minimum(left, 8)], np.array([k]))
        at, k = at[left > 8], k + 1
    for i in np.flatnonzero(size > _TOGETHER):
        word = words[start[i] : end[i] : 8].copy()
        word[-1] &= _HEAD_BYTES[(size[i] - 1) % 8 + 1]
        out[i] += _at_place(word, np.arange(len(word))).sum()
    return splitmix64(out)


def same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which spans of data equal the spans of other, byte for byte."""
    size = end - start
    same = size == stop - begin
    one = eights(data)
    two = one if other is data else eights(other)
    at, k = np.flatnonzero(same & (size > 0) & (size <= _TOGETHER)), 0
    while len(at):
        left = size[at] - 8 * k
        equal = (one[start[at] + 8 * k] ^ two[begin[at] + 8 * k]) & _HEAD_BYTES[np.minimum(left, 8)] == 0
        same[at[~equal]] = False
        at, k = at[equal & (left > 8)], k + 1
    for i in np.flatnonzero(same & (size > _TOGETHER)):
        same[i] = np.array_equal(data[start[i] : end[i]], other[begin[i] : stop[i]])
    return same


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, number): a key for each distinct span in ascending order, the first span that has it, and the number
    of every span's. Equal numbers mean equal bytes."""
    key = span_hash(data, start, end)
    while True:
        distinct, first, number = np.unique(key, return_index=True, return_inverse=True)
        at = first[number]
        differ = np.flatnonzero(~same_bytes(data, start, end, data, start[at], end[at]))
        if not len(differ):
            return distinct, first, number
        key[differ] = splitmix64(key[differ])  # they leave the first one's group together, and are compared again


class Kept:
    """Ids of distinct byte strings, kept by a worker from step to step; found by hash, held against the bytes."""

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.lo, self.hi, self.begin, self.stop = (np.zeros(0, dtype=np.int64) for _ in range(4))
        self.ids, self.spelling = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint8)

    def look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, make: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each span stand in `ids`. `make` gives the ids of new spans end to end and their n+1 offsets.
        Beyond `most` strings all are forgotten."""
        key, first, number = distinct_spans(data, start, end)
        place = np.searchsorted(self.keys, key)
        have = self.keys[np.minimum(place, len(self.keys) - 1)] == key if len(self.keys) else np.zeros(len(key), dtype=bool)
        k, f = place[have], first[have]
        full = len(self.keys) + len(key) - int(have.sum()) > self.most
        if full or not same_bytes(data, start[f], end[f], self.spelling, self.begin[k], self.stop[k]).all():
            self.forget()
            place, have = np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=bool)
        if not have.all():
            new, at = first[~have], place[~have]
            ids, offsets = make(start[new], end[new])
            _, source = ranges(start[new], end[new])
            spelled = np.concatenate([[0], np.cumsum(end[new] - start[new])]) + len(self.spelling)
            self.keys = np.insert(self.keys, at, key[~have])
            self.lo, self.hi = np.insert(self.lo, at, offsets[:-1] + len(self.ids)), np.insert(self.hi, at, offsets[1:] + len(self.ids))
            self.begin, self.stop = np.insert(self.begin, at, spelled[:-1]), np.insert(self.stop, at, spelled[1:])
            self.ids, self.spelling = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.spelling, data[source]])
            place = np.searchsorted(self.keys, key)
        return self.lo[place][number], self.hi[place][number]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes end to end, and the n+1 offsets of its rows in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def whole_numbers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A column of 64-bit ids: values (zero for null), and which are null. No value passes through a double."""
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, or of one longer row; every row is in exactly one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lower_table(word: np.ndarray) -> np.ndarray:
    """Byte to byte: A-Z lower-cased, what is outside `word` (a mask of 256) zero."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return np.where(word[table], table, 0).astype(np.uint8)


def byte_mask(ranges: list[tuple[int, int]]) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    for a, b in ranges:
        mask[a : b + 1] = True
    return mask


#: Bytes of words: digits, letters and all of UTF-8 above ASCII; zero bytes separate.
ALNUM = lower_table(byte_mask([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)]))
#: Bytes of words between ASCII white space; NUL is a word byte, kept apart by the mask.
NONSPACE_MASK = ~byte_mask([(0x20, 0x20), (0x09, 0x0D)])


class Words:
    """The words of a step's rows: byte spans, the row of each, and a 64-bit hash of each lower-cased word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, spaces: bool = False):
        lowered = lower_table(np.ones(256, dtype=bool))[data]
        inside = NONSPACE_MASK[data] if spaces else ALNUM[data] != 0
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1] | edge[1:n]
            last[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.lowered = lowered
        self.hash = span_hash(lowered, self.start, self.end)
        #: Words before each row; the words of row r are [first[r], first[r + 1]).
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))

    def text(self, i: int) -> bytes:
        return self.lowered[self.start[i] : self.end[i]].tobytes()


def give_back() -> None:
    """Return freed memory to the system: a reused worker would else hold the most that any earlier stage took."""
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work` on a task's batches, with its memory given back at the task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expand [lo, hi) ranges: the range's number and the value, one row each."""
    size = hi - lo
    owner = np.repeat(np.arange(len(lo)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
