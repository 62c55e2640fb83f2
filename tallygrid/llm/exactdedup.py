"""Exact deduplication over a minimal perfect hash of the historical digests.

Digests (SHA-256 of the text with A-Z lower-cased, UTF-8) are dealt into buckets. A bucket's history becomes a minimal perfect hash:
levels of bit arrays in which a key that is alone at its place stays and the others go down a level; a key's slot
is the number of set bits before its own. Slots hold the full digest, the winner's locator and the group's size. The
index is a written table, a row a bucket, that any later job can load. A later batch's distinct digests look up their
slot, and only equal digest bytes make a member; nonmembers group separately.

Copies are counted before any shuffle (a partial aggregate by digest), so a group that holds a third of all rows
sends one row a task. Only groups of several rows join back to documents, broadcast where their measured size allows; beyond,
the join is one that Spark can split where it is skewed.

Defined cases: null counts as empty text; of equal texts the row with the largest id stays; repeated rows with one
id form a group with that id, all marked kept; a null id is smaller than any other, and a group without any id has a null
keep_id and all its rows marked kept; very long texts are digested whole; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as T
from .staging import shared_folder, small, small_batches, stage

#: Distinct digests that a bucket is made for; a bucket is one task's memory (about 100 bytes a digest).
BUCKET = 1 << 17
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key (which with the id finds a row again) and the 32 digest bytes of each row's normalised text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = T.text_bytes(b.column(2))
            view = memoryview(data)
            out = [hashlib.sha256(bytes(view[s:e]).translate(_LOWER)).digest() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "text_key", "digest"])

    rows = small_batches(docs).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    return rows.mapInArrow(T.tidy(work), "doc_id bigint, text_key bigint, digest binary")


class PerfectHash:
    """A minimal perfect hash of distinct digests (n rows of 4 uint64), all steps vectorised."""

    GAMMA = 2.0

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, level = keys, 0
        while len(left):
            size = max(64, int(len(left) * self.GAMMA))
            at = self._place(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            self._add(alone)
            left, level = left[~alone[at]], level + 1

    def _add(self, alone: np.ndarray) -> None:
        before = int(self.levels[-1][2][-1]) + 1 if self.levels else 0
        self.levels.append((len(alone), alone, before + np.cumsum(alone) - 1))

    def dump(self) -> tuple[bytes, bytes]:
        """Sizes of the levels, and their bits."""
        return np.array([n for n, _, _ in self.levels], dtype="<i8").tobytes(), b"".join(np.packbits(alone).tobytes() for _, alone, _ in self.levels)

    @classmethod
    def load(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        out, place = cls(np.zeros((0, 4), dtype=np.uint64)), 0
        for n in np.frombuffer(sizes, dtype="<i8").tolist():
            out._add(np.unpackbits(np.frombuffer(bits, dtype=np.uint8, count=-(-n // 8), offset=place), count=n).astype(bool))
            place += -(-n // 8)
        return out

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (T.splitmix64(keys[:, level % 4] ^ np.uint64(0x51ED2701 * (level + 1))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key that was put in; any slot or -1 for others, so compare digests."""
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (size, alone, rank) in enumerate(self.levels):
            at = self._place(keys[left], level, size)
            here = alone[at]
            out[left[here]] = rank[at[here]]
            left = left[~here]
        return out


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    return T.text_bytes(column)[0].view(np.uint8).copy().view(np.uint64).reshape(-1, 4)


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values, zero for null, and which are null."""
    return pc.fill_null(column, 0).to_numpy(), column.is_null().to_numpy()


def _digest_column(keys: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in keys], pa.binary())


_GROUP = "digest binary, keep_id bigint, group_size bigint"
_INDEX = "bucket int, sizes binary, bits binary, digests binary, keep_ids binary, absent binary, group_sizes binary"


def build_bucket(table: pa.Table) -> pa.Table:
    """One bucket's index: the perfect hash and its slots."""
    keys = _keys(table.column("digest"))
    index = PerfectHash(keys)
    order = np.argsort(index.slots(keys))
    keep, absent = _ids(table.column("keep_id"))
    slots = (keys, keep.astype("<i8"), absent, table.column("group_size").to_numpy().astype("<i8"))
    row = [table.column("bucket")[0].as_py(), *index.dump(), *(x[order].tobytes() for x in slots)]
    return pa.table([pa.array([x], pa.int32() if isinstance(x, int) else pa.binary()) for x in row], names=["bucket", "sizes", "bits", "digests", "keep_ids", "absent", "group_sizes"])


def resolve_bucket(table: pa.Table) -> pa.Table:
    """(digest, keep_id, group_size) for all digests of one bucket, those of its stored index and those of the batch."""
    stored, batch = table.filter(table.column("bits").is_valid()), table.filter(table.column("bits").is_null())
    old, ids, absent, counts = np.zeros((0, 4), dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)
    index = PerfectHash(old)
    if stored.num_rows:
        row = stored.to_pylist()[0]
        index = PerfectHash.load(row["sizes"], row["bits"])
        old = np.frombuffer(row["digests"], dtype=np.uint64).reshape(-1, 4)
        ids, absent, counts = (np.frombuffer(row[c], dtype=t).copy() for c, t in (("keep_ids", "<i8"), ("absent", bool), ("group_sizes", "<i8")))
    new = _keys(batch.column("digest"))
    at = index.slots(new)
    member = at >= 0
    member[member] = (old[at[member]] == new[member]).all(axis=1)
    new_ids, new_absent = _ids(batch.column("keep_id"))
    new_counts = batch.column("group_size").to_numpy()
    at, one, none = at[member], new_ids[member], new_absent[member]
    ids[at] = np.where(none, ids[at], np.where(absent[at], one, np.maximum(ids[at], one)))
    absent[at] &= none
    counts[at] += new_counts[member]
    apart = ~member
    every = np.concatenate([old, new[apart]])
    keep = pa.array(np.concatenate([ids, new_ids[apart]]), mask=np.concatenate([absent, new_absent[apart]]))
    return pa.table({"digest": _digest_column(every), "keep_id": keep, "group_size": pa.array(np.concatenate([counts, new_counts[apart]]), pa.int64())})


class Index:
    """The stored index of a history: a folder that all executors share, with a row a bucket."""

    def __init__(self, spark: SparkSession, folder: str):
        self.rows = spark.read.schema(_INDEX).parquet(folder)
        self.buckets = int(folder.rsplit("-", 1)[1])

    @classmethod
    def build(cls, history: DataFrame, folder: str, buckets: int) -> Index:
        """From rows (doc_id, digest). Written under folder, whose name ends with the number of buckets."""
        folder = f"{folder}-{buckets}"
        dealt = cls._counted(history, buckets)
        dealt.groupBy("bucket").applyInArrow(build_bucket, _INDEX).write.parquet(folder)
        return cls(history.sparkSession, folder)

    @staticmethod
    def _counted(rows: DataFrame, buckets: int) -> DataFrame:
        """Distinct digests with their largest id and their number, dealt by leading digest bytes."""
        first = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("bigint")
        counted = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        return counted.withColumn("bucket", (first % buckets).cast("int"))

    def resolve(self, batch: DataFrame) -> DataFrame:
        """(digest, keep_id, group_size) of history and batch together. One pass over both sides by bucket."""
        both = self._counted(batch, self.buckets).unionByName(self.rows, allowMissingColumns=True)
        return both.groupBy("bucket").applyInArrow(resolve_bucket, _GROUP)


def dedup(docs: DataFrame, is_history, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256. `is_history`: which rows (a condition on
    doc_id) form the historical index; the others are the batch that is held against it."""
    return _resolved(docs, is_history, doc_id, text).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _resolved(docs: DataFrame, is_history, doc_id: str, text: str) -> DataFrame:
    rows = stage(digests(docs, doc_id, text))
    old = F.coalesce(is_history, F.lit(False))
    history = Index.build(rows.filter(old), f"{shared_folder(docs.sparkSession)}/index-{uuid.uuid4().hex}", rows.count() // BUCKET + 1)
    groups = stage(history.resolve(rows.filter(~old)).filter("group_size > 1"))
    found = rows.join(small(groups, 80), "digest", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", "text_key", "digest", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"))


def keep_one(docs: DataFrame, is_history, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, all columns as they are; the rows that go are joined away, by id and text."""
    gone = _resolved(docs, is_history, doc_id, text).filter(~F.col("kept")).select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key"))
    side = small(stage(gone.distinct(), light=True), 32)
    return docs.join(side, docs[doc_id].cast("bigint").eqNullSafe(side["_doc_id"]) & (F.xxhash64(docs[text]) == side["_text_key"]), "left_anti")


def even():
    """The query's history: every document with an even id, the rest arrives as the batch."""
    return F.col("doc_id") % 2 == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), even())


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""
