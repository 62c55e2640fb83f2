"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

A batch's text is cut wherever no vocabulary piece holds the two neighbouring characters, as no merge can cross such a
place; distinct chunks that the worker has not met yet are laid end to end and get a suffix array. Every piece is
binary-searched in it; its occurrence range gives the edges (position, length, piece), which are sorted by position.
Then the edges are relaxed: a BPE model joins, again and again, the neighbouring tokens whose joint edge has the best
score, the leftmost of equals, until no edge spans two neighbours. All chunks take a step at a time; a chunk of very
many characters uses a heap. Characters without a piece fall back to byte pieces.

The vocabulary is read from a model file whose place is a parameter; only models without normalisation (identity, a
dummy prefix, kept blanks) are taken, others are refused. Ids equal the public library's.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows are encoded alike; very long
texts are encoded whole; other columns are ignored; an empty table gives no rows; a literal U+2581 decodes to a blank, as in
the library.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as T
from .staging import small_batches

#: Text bytes of a step.
STEP = 1 << 20
#: Inside this module a blank is the byte BLANK, and SEPARATOR stands between chunks; neither occurs in UTF-8.
BLANK, SEPARATOR = 0xFF, 0xFE
_MARK = "▁".encode()
_NONE = np.int64(1 << 40)
#: Fields of a packed edge: position, then length, then rank.
_LENGTH_BITS, _RANK_BITS = 6, 17


def _inner(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with blanks and literal marks as BLANK."""
    raw = data.tobytes()
    if _MARK[:1] in raw and _MARK in raw:
        raw = raw.replace(_MARK, b" ")
    return np.frombuffer(raw.replace(b" ", bytes([BLANK])), dtype=np.uint8)


class Vocabulary:
    def __init__(self, file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=file)
        if sp.normalize(" ﬁ\t\n a  ") != "▁▁ﬁ\t\n▁a▁▁":
            raise ValueError("only models without normalisation and with a dummy prefix are supported")
        n = sp.get_piece_size()
        self.bytes: list[bytes] = []
        ids, scores = [], []
        self.fallback = np.full(256, sp.unk_id(), dtype=np.int64)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.fallback[int(piece[1:-1], 16)] = i
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.encode().replace(_MARK, bytes([BLANK])))
                ids.append(i)
                scores.append(sp.get_score(i))
        text = [self.bytes[i] for i in ids]
        if max(map(len, text)) >= 1 << _LENGTH_BITS or n >= 1 << _RANK_BITS:
            raise ValueError("the vocabulary is too large for a packed edge")
        self.id_of = {t: i for t, i in zip(text, ids, strict=True)}
        order = np.argsort(-np.array(scores), kind="stable")
        rank = np.empty(len(ids), dtype=np.int64)
        best = np.array(scores)[order]
        rank[order] = np.cumsum(np.diff(best, prepend=best[0]) != 0)  # equal scores share a rank
        self.rank, self.length = rank, np.array([len(t) for t in text], dtype=np.int64)
        self.ids = np.array(ids, dtype=np.int64)
        words = -(-int(self.length.max()) // 8)
        padded = np.zeros((len(text), words * 8), dtype=np.uint8)
        for k, t in enumerate(text):
            padded[k, : len(t)] = np.frombuffer(t, dtype=np.uint8)
        used = np.arange(words * 8)[None, :] < self.length[:, None]
        self.low = padded.view(">u8").astype(np.uint64)
        self.high = np.where(used, padded, 255).astype(np.uint8).view(">u8").astype(np.uint64)
        #: Whether some piece holds the bytes x, y next to each other.
        self.joint = np.zeros((256, 256), dtype=bool)
        for t in text:
            b = np.frombuffer(t, dtype=np.uint8)
            self.joint[b[:-1], b[1:]] = True
        self.decode_at = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes])])
        self.decode_bytes = np.frombuffer(b"".join(self.bytes).replace(bytes([BLANK]), b" "), dtype=np.uint8)


class SuffixArray:
    """All suffixes of a byte string, sorted by their first `depth` bytes at least."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        padded = np.concatenate([text, np.zeros(depth + 8, dtype=np.uint8)])
        self.word = np.zeros(n + depth, dtype=np.uint64)
        for k in range(8):
            self.word |= padded[k : k + n + depth].astype(np.uint64) << np.uint64(56 - 8 * k)
        first = self.word[:n]
        self.order = np.argsort(first)
        known = 8
        while known < depth:
            # suffixes with equal prefixes so far are sorted by their next eight bytes, within their places
            w = [self.word[self.order + k] for k in range(0, known, 8)]
            same = np.ones(n, dtype=bool)
            for x in w:
                same[1:] &= x[1:] == x[:-1]
            same[0] = False
            tied = same.copy()
            tied[:-1] |= same[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            group = np.cumsum(~same[at])
            o = np.lexsort((self.word[self.order[at] + known], group))
            self.order[at] = self.order[at][o]
            known += 8
        self.n = n

    def ranges(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of every pattern: the ranges of suffixes that start with it."""
        head = self.word[self.order]
        lo, hi = np.searchsorted(head, low[:, 0], "left"), np.searchsorted(head, high[:, 0], "right")
        for k in range(1, low.shape[1]):
            more = np.flatnonzero((length > 8 * k) & (hi > lo))
            if len(more):
                lo[more], hi[more] = self._within(lo[more], hi[more], low[more, k], 8 * k, False), self._within(lo[more], hi[more], high[more, k], 8 * k, True)
        return lo, hi

    def _within(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, shift: int, after: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (live := lo < hi).any():
            mid = (lo + hi) // 2
            w = self.word[self.order[np.minimum(mid, self.n - 1)] + shift]
            low = live & ((w <= value) if after else (w < value))
            lo, hi = np.where(low, mid + 1, lo), np.where(live & ~low, mid, hi)
        return lo


class Edges:
    """Occurrences of pieces in a text, sorted by position: packed (position, length, rank)."""

    def __init__(self, text: np.ndarray, v: Vocabulary):
        sa = SuffixArray(text, v.low.shape[1] * 8)
        lo, hi = sa.ranges(v.low, v.high, v.length)
        piece, at = T.ranges(lo, hi)
        packed = ((sa.order[at] << _LENGTH_BITS | v.length[piece]) << _RANK_BITS) | v.rank[piece]
        self.packed = np.sort(packed)

    def rank(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The rank of the edge from start to end, _NONE where there is none."""
        size = end - start
        fits = size < 1 << _LENGTH_BITS
        key = (start << _LENGTH_BITS | np.where(fits, size, 0)) << _RANK_BITS
        at = np.minimum(np.searchsorted(self.packed, key), max(len(self.packed) - 1, 0))
        if not len(self.packed):
            return np.full(len(start), _NONE)
        got = self.packed[at]
        return np.where(fits & (got >> _RANK_BITS == key >> _RANK_BITS), got & ((1 << _RANK_BITS) - 1), _NONE)


def relax(edges: Edges, start: np.ndarray, end: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join neighbouring tokens of a chunk along the best edge until none is left: starts and ends of the tokens."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    many = np.bincount(chunk, minlength=1)
    large = many[chunk] > LARGE
    if large.any():
        for c in np.unique(chunk[large]):
            done.append(_relax_heap(edges, start[chunk == c], end[chunk == c]))
        start, end, chunk = start[~large], end[~large], chunk[~large]
    join = np.full(len(start), _NONE)
    inner = np.flatnonzero(chunk[1:] == chunk[:-1])
    join[inner] = edges.rank(start[inner], end[inner + 1])
    while len(start):
        head = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        best = np.minimum.reduceat(join, head)
        size = np.diff(np.append(head, len(start)))
        live = np.repeat(best < _NONE, size)
        if not live.all():
            done.append((start[~live], end[~live]))
            start, end, chunk, join = start[live], end[live], chunk[live], join[live]
            if not len(start):
                break
            keep = best < _NONE
            best, size = best[keep], size[keep]
        at = np.flatnonzero(join == np.repeat(best, size))
        at = at[np.concatenate([[True], chunk[at][1:] != chunk[at][:-1]])]  # the leftmost of each chunk
        end[at] = end[at + 1]
        stay = np.ones(len(start), dtype=bool)
        stay[at + 1] = False
        at -= np.arange(len(at))  # one token fewer before each
        start, end, chunk, join = start[stay], end[stay], chunk[stay], join[stay]
        join[at] = _NONE
        left = np.flatnonzero(np.append(chunk[1:] == chunk[:-1], False))
        touched = np.zeros(len(start), dtype=bool)
        touched[at] = True
        touched[np.maximum(at - 1, 0)] = True
        again = left[touched[left]]
        join[again] = edges.rank(start[again], end[again + 1])
    s = np.concatenate([np.zeros(0, dtype=np.int64), *(x for x, _ in done)])
    e = np.concatenate([np.zeros(0, dtype=np.int64), *(x for _, x in done)])
    order = np.argsort(s)
    return s[order], e[order]


#: Tokens of a chunk from which a heap is used: n log n steps instead of n steps over all.
LARGE = 256


def _relax_heap(edges: Edges, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(start)
    following, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), end.tolist()
    begin, alive = start.tolist(), [True] * n
    first = edges.rank(start[:-1], end[1:])
    heap = [(int(r), i, stop[i + 1]) for i, r in enumerate(first) if r < _NONE]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = following[i]
        if i >= 0 and j < n:
            r = int(edges.rank(np.array([begin[i]]), np.array([stop[j]]))[0])
            if r < _NONE:
                heapq.heappush(heap, (r, i, stop[j]))

    while heap:
        _, i, until = heapq.heappop(heap)
        if not alive[i] or following[i] >= n or stop[following[i]] != until:
            continue
        j = following[i]
        alive[j] = False
        stop[i], following[i] = stop[j], following[j]
        if following[i] < n:
            before[following[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    keep = np.array(alive)
    return start[keep], np.array(stop, dtype=np.int64)[keep]


class Encoder:
    """Whole texts to ids; a worker keeps the ids of up to KEPT chunks from step to step."""

    KEPT = 1 << 19
    #: Bytes of new chunks that get one suffix array.
    TEXT = 1 << 18

    def __init__(self, file: str):
        self.v = Vocabulary(file)
        self.kept = T.Kept(self.KEPT)

    def chunks(self, text: np.ndarray, begin: np.ndarray, finish: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks text[begin:finish] end to end, and their n+1 offsets."""
        size = finish - begin
        place = np.concatenate([[0], np.cumsum(size + 1)])
        laid = np.full(place[-1], SEPARATOR, dtype=np.uint8)
        _, source = T.ranges(begin, finish)
        _, target = T.ranges(place[:-1], place[:-1] + size)
        laid[target] = text[source]
        edges = Edges(laid, self.v)
        lead = np.flatnonzero((laid & 0xC0 != 0x80) & (laid != SEPARATOR))
        chunk = np.searchsorted(place, lead, side="right") - 1
        last = np.append(lead[1:], place[-1] - 1)
        stop = np.minimum(last, place[chunk] + size[chunk])
        start, end = relax(edges, lead, stop, chunk)
        owner = np.searchsorted(place, start, side="right") - 1
        ids, count = self._ids(laid, start, end, edges)
        return ids, np.concatenate([[0], np.cumsum(np.bincount(owner, weights=count, minlength=len(size)).astype(np.int64))])

    def _ids(self, laid: np.ndarray, start: np.ndarray, end: np.ndarray, edges: Edges) -> tuple[np.ndarray, np.ndarray]:
        """A token's id from its bytes: tokens are few kinds, so each distinct one is looked up once."""
        known = edges.rank(start, end) < _NONE
        _, first, number = T.distinct_spans(laid, start, end)
        raw = laid.tobytes()
        of = np.array([self.v.id_of.get(raw[start[k] : end[k]], -1) for k in first], dtype=np.int64)
        count = np.where(known, 1, end - start)
        offsets = np.concatenate([[0], np.cumsum(count)])
        ids = np.empty(offsets[-1], dtype=np.int64)
        ids[offsets[:-1][known]] = of[number[known]]
        bare = np.flatnonzero(~known)
        _, source = T.ranges(start[bare], end[bare])
        _, target = T.ranges(offsets[bare], offsets[bare + 1])
        ids[target] = self.v.fallback[laid[source]]
        return ids, count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and the n+1 offsets."""
        rows = [b"" if a == z else b"\xff" + _inner(data[a:z]).tobytes() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        text = np.frombuffer(b"".join(rows), dtype=np.uint8)
        row = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        if not len(text):
            return np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
        cut = np.ones(len(text), dtype=bool)
        cut[1:] = ~self.v.joint[text[:-1], text[1:]] & (text[1:] & 0xC0 != 0x80)
        cut[row[:-1][np.diff(row) > 0]] = True
        begin = np.flatnonzero(cut)
        finish = np.append(begin[1:], len(text))
        lo, hi = self.kept.look_up(text, begin, finish, lambda a, z: self._new(text, a, z))
        _, at = T.ranges(lo, hi)
        before = np.concatenate([[0], np.cumsum(hi - lo)])
        return self.kept.ids[at], before[np.searchsorted(begin, row)]

    def _new(self, text: np.ndarray, begin: np.ndarray, finish: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new chunks, TEXT bytes of them with one suffix array."""
        ends = np.cumsum(finish - begin + 1)
        ids, offsets, i = [np.zeros(0, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + self.TEXT)))
            got, where = self.chunks(text, begin[i:j], finish[i:j])
            ids.append(got)
            offsets.append(where[1:] + offsets[-1][-1])
            i = j
        return np.concatenate(ids), np.concatenate(offsets)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows end to end, without the dummy prefix, and the n+1 offsets."""
        at = self.v.decode_at
        _, source = T.ranges(at[ids], at[ids + 1])
        text = self.v.decode_bytes[source]
        size = np.concatenate([[0], np.cumsum(at[ids + 1] - at[ids])])[offsets]
        some = np.diff(size) > 0
        head = size[:-1][some]
        drop = head[text[head] == 0x20]
        lost = np.searchsorted(drop, size)  # blanks dropped before each offset
        return np.delete(text, drop), size - lost


@functools.cache
def encoder_of(file: str) -> Encoder:
    return Encoder(file)


def encode(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids and decoded (the text that the ids stand for)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(file)
        for b in batches:
            data, offsets = T.text_bytes(b.column(1))
            for i, j in T.steps(offsets, STEP):
                ids, places = e.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                raw, ends = e.decode(ids, places)
                lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids, pa.int32()))
                decoded = pa.StringArray.from_buffers(j - i, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists, decoded], ["doc_id", "ids", "decoded"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(T.tidy(work), f"doc_id {kind}, ids array<int>, decoded string")


def digest(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as little-endian 32-bit integers) and round_trip (decoding gives the text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(file)
        for b in batches:
            data, offsets = T.text_bytes(b.column(1))
            for i, j in T.steps(offsets, STEP):
                part, place = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                ids, places = e.encode(part, place)
                raw, ends = e.decode(ids, places)
                packed, flat, same = ids.astype("<u4").tobytes(), part.tobytes(), raw.tobytes()
                crc = [zlib.crc32(packed[4 * a : 4 * z]) for a, z in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
                trip = [flat[a:z] == same[c:d] for a, z, c, d in zip(place[:-1].tolist(), place[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(places), pa.int64()), pa.array(crc, pa.int64()), pa.array(trip, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(T.tidy(work), f"doc_id {kind}, n_ids bigint, ids_crc32 bigint, round_trip boolean")


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_file())
