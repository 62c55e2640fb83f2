"""Token ids as fixed-width bit-packed files.

An id takes the minimum number of bits that the vocabulary needs. A file is a header, an index of documents, the offset of
every block of BLOCK ids, and the blocks, each packed from a byte boundary on; so any id is found by arithmetic and a block is
unpacked by numpy at once. Documents stand in ascending id order: a range partition by id, sorted, is a shard, and its files
follow one another. A file is a row (shard, file, content) of a table in the shared folder, as only Spark's writers reach
every store.

Encoding goes through the tokenizers library, once for each distinct piece of a batch. The tokenizer's normaliser
and pre-tokeniser work within white space and ASCII letter/punctuation borders, so text is cut there (never beside an
apostrophe or a non-ASCII byte) and the pieces' ids are put together again; a text with one of the special tokens'
spellings, or a tokenizer of another kind, is encoded whole.

Defined cases: a null text is empty and has the end id alone; null ids come first, in ascending order, and stay null; repeated ids stand beside each other; a very long text is one
document of one file; an empty table has no files; other columns are ignored.
"""

from __future__ import annotations

import functools
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as T
from .staging import GROUP_BYTES, small_batches, stage

MAGIC = b"PACKIDS1"
#: Ids of a block, and (about) of a file.
BLOCK, FILE_IDS = 4096, 1 << 19
END_ID = 1
_HEAD = struct.Struct("<8sHHIIQ")  # magic, bits, whether ids are absent, documents, blocks, ids


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Lowest bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    flags = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, dtype="<u2", count=n).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flags.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_file(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, bits: int, absent: np.ndarray | None = None) -> bytes:
    """`absent`: which documents have no id. Their bits stand behind the blocks, and only if there is one."""
    absent = absent if absent is not None and absent.any() else np.zeros(0, dtype=bool)
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    places = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    head = _HEAD.pack(MAGIC, bits, len(absent) > 0, len(doc_ids), len(blocks), len(ids))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), places.tobytes(), *blocks, np.packbits(absent).tobytes()])


class PackedFile:
    """Random access to one file's bytes."""

    def __init__(self, content: bytes):
        magic, self.bits, absent, n, blocks, self.length = _HEAD.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a packed-id file")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(content, dtype="<i8", count=n, offset=at)
        self.sizes = np.frombuffer(content, dtype="<u4", count=n, offset=at + 8 * n)
        self.places = np.frombuffer(content, dtype="<u8", count=blocks + 1, offset=at + 12 * n)
        self.data = memoryview(content)[at + 12 * n + 8 * (blocks + 1) :]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        self.absent = np.unpackbits(np.frombuffer(self.data[self.places[-1] :], dtype=np.uint8), count=n).astype(bool) if absent else np.zeros(n, dtype=bool)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids [lo, hi) of the file; only their blocks are unpacked."""
        first = lo // BLOCK
        out = [unpack(self.data[self.places[k] : self.places[k + 1]], min(BLOCK, self.length - k * BLOCK), self.bits) for k in range(first, (hi + BLOCK - 1) // BLOCK)]
        return np.concatenate([np.zeros(0, dtype=np.uint32), *out])[lo - first * BLOCK : hi - first * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


_APART = T.byte_mask([(0x20, 0x20), (0x09, 0x0D)])
#: Byte classes for cuts: 1 ASCII letter, 2 ASCII punctuation but the apostrophe, 3 digit, 0 never cut beside.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0x21:0x7F] = 2
_KIND[0x30:0x3A] = 3
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[0x27] = 0


class PieceEncoder:
    """Ids of whole texts from the ids of their distinct pieces."""

    GROUP, CALL = 512, 32  # pieces joined by blanks, and such texts in one call
    KEPT = 1 << 20  # pieces whose ids a worker keeps (some 40 MB) from step to step

    def __init__(self, file: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        spec = json.loads(self.tokenizer.to_str())
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        suffix = spec["model"].get("end_of_word_suffix")
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        lowers = spec["normalizer"] is not None and self.tokenizer.normalizer.normalize_str(upper) == upper.lower()
        self.by_piece = bool(suffix) and lowers and spec["pre_tokenizer"] is not None
        self.is_end = np.zeros(self.size, dtype=bool)
        if self.by_piece:
            self.is_end[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.kept = T.Kept(self.KEPT)

    @property
    def bits(self) -> int:
        return max(1, int(self.size - 1).bit_length())

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _single(piece: str) -> bool:
        """Whether the pre-tokeniser surely makes one token of it: letters alone, or ASCII punctuation without an apostrophe."""
        if piece.isascii():
            return piece.isalpha() or not any(c.isalnum() or c == "'" or c.isspace() or not c.isprintable() for c in piece)
        return unicodedata.normalize("NFC", piece).lower().isalpha()

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' ids end to end, and the n+1 offsets."""
        single = [k for k, p in enumerate(pieces) if self._single(p)]
        lengths = np.zeros(len(pieces), dtype=np.int64)
        joined = [" ".join([pieces[k] for k in single[i : i + self.GROUP]]) for i in range(0, len(single), self.GROUP)]
        flat = np.concatenate([np.zeros(0, dtype=np.int64), *(x for i in range(0, len(joined), self.CALL) for x in self.whole(joined[i : i + self.CALL]))])
        ends = np.flatnonzero(self.is_end[flat]) + 1
        if len(ends) != len(single) or len(flat) and ends[-1] != len(flat):
            # a tokenizer that makes several words of such a piece: each is encoded on its own
            single, flat, ends = [], flat[:0], ends[:0]
        alone = set(single)
        rest = [k for k in range(len(pieces)) if k not in alone] if len(single) < len(pieces) else []
        lengths[single] = np.diff(ends, prepend=0)
        apart = self.whole([pieces[k] for k in rest])
        lengths[rest] = [len(x) for x in apart]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        out = np.empty(offsets[-1], dtype=np.int64)
        _, at = T.ranges(offsets[single], offsets[np.array(single, dtype=np.int64) + 1] if single else offsets[:0])
        out[at] = flat
        for k, x in zip(rest, apart, strict=True):
            out[offsets[k] : offsets[k + 1]] = x
        return out, offsets

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and the n+1 offsets."""
        raw = data.tobytes()
        if not self.by_piece or any(s in raw for s in self.special):
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            got = self.whole(texts)
            return np.concatenate([np.zeros(0, dtype=np.int64), *got]), np.concatenate([[0], np.cumsum([len(x) for x in got], dtype=np.int64)])
        n = len(data)
        inside, kind = ~_APART[data], _KIND[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        if n:
            cut[1:n] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) | ~inside[1:] | ~inside[:-1]
        start = np.flatnonzero(inside & cut[:n])
        end = np.append(start[1:], n)
        stop = np.flatnonzero(cut)
        end = stop[np.searchsorted(stop, start, side="right")] if len(start) else start
        lowered = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
        raw = lowered.tobytes()
        lo, hi = self.kept.look_up(lowered, start, end, lambda a, z: self.pieces([raw[i:j].decode() for i, j in zip(a.tolist(), z.tolist(), strict=True)]))
        _, at = T.ranges(lo, hi)
        before = np.concatenate([[0], np.cumsum(hi - lo)])
        return self.kept.ids[at], before[np.searchsorted(start, offsets)]


@functools.cache
def encoder_of(file: str) -> PieceEncoder:
    """One encoder a worker, with the pieces that it keeps."""
    return PieceEncoder(file)


def encoded(batches: Iterator[pa.RecordBatch], encoder: PieceEncoder, end_id: int | None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids of documents, their sizes, their token ids end to end with the end id after each) for steps of (id, text)."""
    for b in batches:
        data, offsets = T.text_bytes(b.column(1))
        for i, j in T.steps(offsets):
            ids, places = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if end_id is not None:
                ids = np.insert(ids, places[1:], end_id)
            yield b.column(0).slice(i, j - i), np.diff(places) + (end_id is not None), ids


def write_files(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = END_ID, shards: int | None = None) -> DataFrame:
    """All documents' ids in files, in ascending id order: (shard, file, ids, content).

    Texts are dealt by ranges of the id before they are encoded: the sample that sets the ranges reads the child's
    rows, and would otherwise encode everything twice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(file)
        shard, number = TaskContext.get().partitionId(), 0
        for names, sizes, ids in encoded(batches, encoder, end_id):
            (doc_ids, absent), ends = T.whole_numbers(names), np.cumsum(sizes)
            first = 0
            while first < len(sizes):  # a file ends after the document with which it has FILE_IDS
                begin = ends[first - 1] if first else 0
                last = min(int(np.searchsorted(ends, begin + FILE_IDS)) + 1, len(sizes))
                raw = write_file(doc_ids[first:last], sizes[first:last], ids[begin : ends[last - 1]], encoder.bits, absent[first:last])
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([ends[last - 1] - begin], pa.int64()), pa.array([raw], pa.binary())], ["shard", "file", "ids", "content"])
                number, first = number + 1, last

    rows = small_batches(docs).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    # the input's splits are bounded in bytes, so with as many shards a shard is, too
    n = shards or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return stage(ordered.mapInArrow(T.tidy(work), "shard int, file int, ids bigint, content binary"), "none", group_bytes=GROUP_BYTES)


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, read from the files."""
    totals = files.groupBy("shard", "file").agg(F.sum("ids").alias("n"))
    # one row a file, half a million ids each: few rows; shards first, so that no single task ranks all files
    shard = totals.groupBy("shard").agg(F.sum("n").alias("n"))
    before = shard.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    place = totals.select("shard", "file", (F.sum("n").over(Window.partitionBy("shard").orderBy("file")) - F.col("n")).alias("file_start"))
    starts = place.join(before, "shard").select("shard", "file", (F.col("file_start") + F.col("shard_start")).alias("start"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, f, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                p = PackedFile(raw.as_py())
                crc = [zlib.crc32(p.document(k).astype("<u4").tobytes()) for k in range(len(p.doc_ids))]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([s] * n, pa.int32()), pa.array([f] * n, pa.int32()), pa.array(p.doc_ids, mask=p.absent), pa.array(p.starts[:-1]), pa.array(p.sizes.astype(np.int64)), pa.array(crc, pa.int64())], ["shard", "file", "doc_id", "offset", "n_tokens", "ids_crc32"])

    rows = files.select("shard", "file", "content").mapInArrow(T.tidy(work), "shard int, file int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(starts, ["shard", "file"]).select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_files(write_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))
