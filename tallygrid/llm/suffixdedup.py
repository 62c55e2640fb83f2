"""Removal of repeated substrings by a distributed difference-cover algorithm.

A difference cover D modulo v has, for any two positions i and j, a shift d < v that takes both into the sample
{p : p mod v in D}. The classic algorithm takes v = 3, sorts the sample by triples, recurses on the triples' names
until all are distinct, and merges the rest. Here only prefixes of LENGTH bytes matter and names are 64-bit hashes,
so a larger period does the same with far fewer suffixes, and each level only keeps suffixes whose name is not yet unique:

1. Sample: positions in the cover (12 of 133). Two equal strings of 200 bytes have a pair of sampled suffixes that share
   at least 200 - 133 + 1 = 68 bytes. Names of 68-byte prefixes are sorted over the corpus, equal neighbours found;
   unique suffixes drop out.
2. Recursion: the remaining sampled suffixes are named by longer prefixes, 200 + 133 - 1 = 332 bytes. Where these are
   shared, all 133 suffixes that start in the period are repeated, without any row of their own; only the first
   occurrence of each name goes on, to stand for the others.
3. Merge: the other suffixes near a sampled one that is left get names of 200 bytes, are sorted with those of the first
   occurrences, and adjacent equal prefixes are repeats.

All three sorts run on packed names (see exchange.py), never on a row a suffix, and no full suffix array is written:
840 MB of text would need some 17 GB of positions and ranks. Texts are held as blocks of whole documents in a written
table, so every level recomputes a block's names in the same order and an answer is a bit a name.

Defined cases: null and empty texts have no bytes; documents shorter than LENGTH lose nothing; repeated rows are repeats
of each other; a null id stays null; ties do not arise, as every occurrence is removed; other columns are ignored; an empty table gives no
rows. A document must fit into a worker (some 50 bytes a byte of text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from . import textkit as T
from .staging import release_shuffles, small_batches, stage

LENGTH = 200
#: Text bytes of a block; a worker holds some 50 bytes a byte.
BLOCK_BYTES = 4 << 20
#: A perfect difference set: each residue modulo 133 but 0 is the difference of exactly one ordered pair.
PERIOD, COVER = 133, (0, 9, 10, 12, 26, 30, 67, 74, 82, 109, 114, 120)
_BLOCK = "block_id bigint, doc_ids binary, absent binary, offsets binary, data binary"


def text_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """Documents in blocks of whole texts of about `limit` bytes: (block_id, doc_ids, absent, offsets, data), written."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            data, offsets = T.text_bytes(b.column(1))
            ids, absent = T.whole_numbers(b.column(0))
            for i, j in T.steps(offsets, limit):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids[i:j], absent[i:j], offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]))], ["block_id", "doc_ids", "absent", "offsets", "data"])
                number += 1

    return stage(small_batches(docs).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(T.tidy(work), _BLOCK), group_bytes=2 * limit)


class Block:
    """One block's bytes and the names of its suffixes."""

    def __init__(self, row: dict, length: int, period: int, cover: tuple[int, ...]):
        self.data = np.frombuffer(row["data"], dtype=np.uint8)
        self.offsets = np.frombuffer(row["offsets"], dtype=np.int64)
        self.doc_ids, self.absent = np.frombuffer(row["doc_ids"], dtype=np.int64), np.frombuffer(row["absent"], dtype=bool)
        self.length, self.period = length, period
        # a value for each place and the seven bytes behind it: what a name hashes has no structure of the text's own
        self.rolling = T.Rolling(T.splitmix64(T.eights(self.data)[:-1]))
        n = len(self.data)
        base = np.arange(0, n, period)[:, None] + np.array(cover)[None, :]
        at = base.ravel()
        at = at[at < n]
        end = self.offsets[1:][np.searchsorted(self.offsets, at, side="right") - 1]
        begin = self.offsets[np.searchsorted(self.offsets, at, side="right") - 1]
        fits = (at + self.short <= end) & (end - begin >= length)
        self.sample, self.end = at[fits], end[fits]

    @property
    def short(self) -> int:
        return self.length - self.period + 1

    @property
    def long(self) -> int:
        return self.length + self.period - 1

    def names(self, at: np.ndarray, length: int) -> np.ndarray:
        return self.rolling.spans(at, at + length - min(7, length - 1))

    def left(self, replies: list[dict] | None, bits: int) -> np.ndarray:
        """Level 1's answer: the sampled suffixes whose short name is shared."""
        names = self.names(self.sample, self.short)
        distinct, _ = X.condensed(names, None)
        shared, _ = X.flags(distinct, replies, bits)
        return shared[np.searchsorted(distinct, names)]

    def longer(self, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Level 2's suffixes (those left that have room for the long prefix) and names."""
        at = self.sample[left & (self.sample + self.long <= self.end)]
        return at, self.names(at, self.long)

    def covered(self, left: np.ndarray, replies: list[dict] | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Masks of positions: repeated by a shared long name; among these, those that another occurrence stands for."""
        at, names = self.longer(left)
        distinct, _ = X.condensed(names, None)
        shared, first = X.flags(distinct, replies, bits)
        number = np.searchsorted(distinct, names)
        head = np.zeros(len(at), dtype=bool)
        head[np.unique(number, return_index=True)[1]] = True  # positions ascend: the first of equal ones here
        stands = first[number] & head
        return self._spread(at[shared[number]], self.period), self._spread(at[shared[number] & ~stands], self.period)

    def merged(self, left: np.ndarray, covered: np.ndarray, delegated: np.ndarray) -> np.ndarray:
        """Level 3's suffixes: a sampled suffix that is left stands in their period, and no other occurrence stands for them."""
        n = len(self.data)
        near = self._spread(np.maximum(self.sample[left] - self.period + 1, 0), self.period)
        room = np.zeros(n, dtype=bool)
        for a, z in zip(self.offsets[:-1], self.offsets[1:], strict=True):
            room[a : max(a, z - self.length + 1)] = True
        return np.flatnonzero((near | covered) & ~delegated & room)

    def _spread(self, at: np.ndarray, width: int) -> np.ndarray:
        """Positions within `width` from any of `at` on."""
        n = len(self.data)
        step = np.zeros(n + 1, dtype=np.int32)
        np.add.at(step, at, 1)
        np.add.at(step, np.minimum(at + width, n), -1)
        return np.cumsum(step[:-1]) > 0


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER, limit: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: doc_id, n_bytes, starts and ends (of the maximal removed runs, in bytes), kept (the bytes
    that stay). `period` and `cover` may be any difference cover with length >= period."""
    if length < period or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("not a difference cover that fits the length")
    blocks = text_blocks(docs, doc_id, text, limit)
    spark = docs.sparkSession
    size = blocks.select(F.sum(F.octet_length("data"))).first()[0] or 0
    bits = X.bucket_bits(size * len(cover) // period)

    def block(row: dict) -> Block:
        return Block(row, length, period, cover)

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in X.each_block(batches):
            b = block(row)
            yield X.request(row["block_id"], b.names(b.sample, b.short), None, bits)

    def second_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in X.each_block(batches):
            b = block(row)
            yield X.request(row["block_id"], b.longer(b.left(row["r1"], bits))[1], None, bits)

    def third_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in X.each_block(batches):
            b = block(row)
            left = b.left(row["r1"], bits)
            covered, delegated = b.covered(left, row["r2"], bits)
            at = b.merged(left, covered, delegated)
            yield X.request(row["block_id"], b.names(at, length), covered[at], bits)

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in X.each_block(batches):
            b = block(row)
            left = b.left(row["r1"], bits)
            covered, delegated = b.covered(left, row["r2"], bits)
            at = b.merged(left, covered, delegated)
            names = b.names(at, length)
            distinct, _ = X.condensed(names, None)
            shared, _ = X.flags(distinct, row["r3"], bits)
            repeated = covered
            repeated[at[shared[np.searchsorted(distinct, names)]]] = True
            yield _documents(b, b._spread(np.flatnonzero(repeated), length))

    r1 = X.answers(blocks.mapInArrow(T.tidy(first_level), X.REQUEST))
    release_shuffles(spark)
    one = X.attach(blocks, r1, "r1")
    r2 = X.answers(one.mapInArrow(T.tidy(second_level), X.REQUEST))
    release_shuffles(spark)
    two = X.attach(one, r2, "r2")
    r3 = X.answers(two.mapInArrow(T.tidy(third_level), X.REQUEST))
    release_shuffles(spark)
    return X.attach(two, r3, "r3").mapInArrow(T.tidy(result), "doc_id bigint, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary")


def _documents(b: Block, removed: np.ndarray) -> pa.RecordBatch:
    starts, ends, kept = [], [], []
    for a, z in zip(b.offsets[:-1], b.offsets[1:], strict=True):
        gone = removed[a:z]
        if not gone.any():
            starts.append([])
            ends.append([])
            kept.append(b.data[a:z].tobytes())
            continue
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        starts.append(np.flatnonzero(edge == 1).tolist())
        ends.append(np.flatnonzero(edge == -1).tolist())
        kept.append(b.data[a:z][~gone].tobytes())
    runs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(b.doc_ids, mask=b.absent), pa.array(np.diff(b.offsets)), pa.array(starts, runs), pa.array(ends, runs), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "starts", "ends", "kept"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("bigint").alias("n_removed"), F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, str | None], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The definition, for tests: a table of all strings of `length` bytes."""
    seen: dict[bytes, int] = {}
    raw = {d: (t or "").encode() for d, t in texts.items()}
    for t in raw.values():
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = {}
    for d, t in raw.items():
        gone = np.zeros(len(t) + 1, dtype=np.int8)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = 1
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[gone[:-1] == 0])
        out[d] = (len(t), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out
