"""Which 64-bit keys of a block occur elsewhere? Asked and answered over one shuffle, without a row for each key.

Every block (a row of a written table) sorts its distinct keys and sends them in packed slices, one for each bucket of the key
space. A bucket sorts what it gets and answers each block with bits: the key is shared (another block has it, or
the block has it more than once), and the block is the first that has it. A key is sent once a block however often
it occurs, so a key that stands in a third of all rows costs one entry a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import staging
from .staging import stage

#: Keys that a bucket is made for: 4 MB, some 20 MB in the task that sorts it.
BUCKET_KEYS = 1 << 19
REQUEST = "bucket int, block_id bigint, keys binary, many binary"
_REPLY = "block_id bigint, bucket int, shared binary, first binary"


def bucket_bits(keys: int) -> int:
    return max(0, (keys // BUCKET_KEYS).bit_length())


def request(block_id: int, keys: np.ndarray, many: np.ndarray | None, bits: int) -> pa.RecordBatch:
    """The slices of one block. `many`: keys that are known to be shared already."""
    distinct, often = condensed(keys, many)
    place = cuts(distinct, bits)
    rows = [k for k in range(len(place) - 1) if place[k + 1] > place[k]]
    return pa.RecordBatch.from_arrays(
        [pa.array(rows, pa.int32()), pa.array([block_id] * len(rows), pa.int64()), pa.array([distinct[place[k] : place[k + 1]].tobytes() for k in rows], pa.binary()), pa.array([np.packbits(often[place[k] : place[k + 1]]).tobytes() for k in rows], pa.binary())],
        ["bucket", "block_id", "keys", "many"],
    )


def condensed(keys: np.ndarray, many: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order; whether each stands more than once or is marked."""
    order = np.argsort(keys)
    k = keys[order]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
    often = np.diff(np.append(head, len(k))) > 1
    if many is not None and len(k):
        often |= np.logical_or.reduceat(many[order], head)
    return k[head], often


def cuts(distinct: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.array([0, len(distinct)])
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(distinct, edges), [len(distinct)]])


def _answer(table: pa.Table) -> pa.Table:
    table = table.sort_by("block_id")
    parts = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("keys")]
    many = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), dtype=np.uint8), count=len(p)) for x, p in zip(table.column("many"), parts, strict=True)]).astype(bool)
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")  # of equal keys the smallest block stands first
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    head = np.flatnonzero(new)
    shared_group = (np.diff(np.append(head, len(k))) > 1) | np.logical_or.reduceat(many[order], head)
    shared = np.empty(len(k), dtype=bool)
    shared[order] = np.repeat(shared_group, np.diff(np.append(head, len(k))))
    first = np.empty(len(k), dtype=bool)
    first[order] = new
    rows, place = [], 0
    bucket = table.column("bucket")[0].as_py()
    for b, p in zip(table.column("block_id").to_pylist(), parts, strict=True):
        s = slice(place, place + len(p))
        place += len(p)
        if shared[s].any():
            rows.append((b, bucket, zlib.compress(np.packbits(shared[s]).tobytes(), 1), zlib.compress(np.packbits(first[s]).tobytes(), 1) if (first[s] & shared[s]).any() else None))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block_id", "bucket", "shared", "first"])


def answers(requests: DataFrame) -> DataFrame:
    """(block_id, replies): the bits of each block's buckets, only where a key is shared. Written."""
    replies = requests.groupBy("bucket").applyInArrow(_answer, _REPLY)
    return stage(replies.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "shared", "first")).alias("replies")))


def attach(blocks: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """blocks with a column of replies (null where nothing is shared). Replies beyond a broadcast are the hashed side of a join by shuffle, as
    a sort would hold the blocks, of some megabytes each."""
    size = replies.select(F.sum(F.aggregate("replies", F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x["shared"]) + F.coalesce(F.octet_length(x["first"]), F.lit(0)) + 32))).first()[0] or 0
    side = replies.withColumnRenamed("replies", name)
    return blocks.join(F.broadcast(side) if size <= staging.BROADCAST_BYTES else side.hint("shuffle_hash"), "block_id", "left")


def flags(distinct: np.ndarray, replies: list[dict] | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For a block's distinct keys in order: shared, and shared with this block the first."""
    shared, first = np.zeros(len(distinct), dtype=bool), np.zeros(len(distinct), dtype=bool)
    place = cuts(distinct, bits) if replies else None
    for r in replies or ():
        a, z = place[r["bucket"]], place[r["bucket"] + 1]
        shared[a:z] = np.unpackbits(np.frombuffer(zlib.decompress(r["shared"]), dtype=np.uint8), count=z - a)
        if r["first"] is not None:
            first[a:z] = np.unpackbits(np.frombuffer(zlib.decompress(r["first"]), dtype=np.uint8), count=z - a)
    return shared, first & shared


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, so that one block's arrays are held at once."""
    for b in batches:
        for k in range(b.num_rows):
            yield {name: b.column(c)[k].as_py() for c, name in enumerate(b.schema.names)}
