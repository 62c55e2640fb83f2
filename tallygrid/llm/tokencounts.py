"""Token counts as delta-maintained rollups.

A store is a folder of commits. Each commit is one batch's signed delta, summed by source, language and tokenizer version:
an insert adds a document's counts, a delete takes them away, a revision takes the old counts and adds the new
ones. Totals are the sum of the commits, so no document is read again to maintain them. A batch is written to a side
folder and renamed to its batch id, a step that fails where that name exists: a batch that is delivered again changes
nothing, and a job that dies before the rename leaves nothing that counts. `compact` folds commits into one and then
swaps a pointer; whenever it dies, either the old commits count or the new one does.

Counting cuts texts at single blanks between words, where no token of the tokenizers' pattern crosses; a worker
encodes each distinct part once and keeps its counts. Only sums leave a worker (a partial aggregate by source and
language), so a source that holds a third of all rows is a row a task.

Defined cases: null and empty texts count zero tokens and one document; null source or language is a group of its own;
repeated rows count as often as they stand; a revision replaces the counts of each row, whatever its id; a deletion takes
all rows of an id, and none for a null id; very long texts are counted whole; other columns are ignored, whatever their
names; an empty batch commits an empty delta.
"""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as T
from .staging import shared_folder, small, small_batches, stage

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_bytes bigint"
#: Tokenizer versions and their rank files; the places are parameters of the public tokenizers' package.
VERSIONS = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


class Counter:
    """Token counts of whole texts, for several tokenizer versions at once."""

    KEPT = 1 << 19  # parts whose counts a worker keeps

    def __init__(self, versions: tuple[str, ...]):
        import public_tokenizers
        import tiktoken

        self.encodings = []
        for file in versions:
            with open(public_tokenizers.path(file), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.encodings.append(tiktoken.Encoding(file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
        self.kept = T.Kept(self.KEPT)

    @staticmethod
    def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of parts: the rows' own, and single blanks between characters that surely are no white space."""
        n = len(data)
        at = np.flatnonzero(data == 0x20)
        at = at[(at > 0) & (at + 1 < n)]
        before, after, two, three = data[at - 1], data[at + 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        # white space outside ASCII starts with one of these bytes
        wide = np.zeros(256, dtype=bool)
        wide[[0xC2, 0xE1, 0xE2, 0xE3]] = True
        clear = (after > 0x20) & (after != 0x7F) & ~wide[after]
        clear &= ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & ~wide[two] & ~wide[three])
        cut = np.zeros(n + 1, dtype=bool)
        cut[at[clear]] = True
        cut[offsets] = True
        return np.flatnonzero(cut[:n])

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row of counts for each text, a column for each version."""
        raw, many = data.tobytes(), len(self.encodings)

        def new(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            parts = [raw[a:z].decode() for a, z in zip(start.tolist(), end.tolist(), strict=True)]
            counts = np.array([[len(e.encode_ordinary(x)) for x in parts] for e in self.encodings], dtype=np.int64)
            return counts.T.ravel(), np.arange(len(parts) + 1) * many

        start = self.cuts(data, offsets)
        lo, _ = self.kept.look_up(data, start, np.append(start[1:], len(data)), new)
        at = np.searchsorted(start, offsets)
        sums = [np.concatenate([[0], np.cumsum(self.kept.ids[lo + v], dtype=np.int64)]) for v in range(many)]
        return np.stack([x[at[1:]] - x[at[:-1]] for x in sums], axis=1)


@functools.cache
def counter_of(versions: tuple[str, ...]) -> Counter:
    return Counter(versions)


def count(docs: DataFrame, versions: tuple[str, ...] = VERSIONS, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", mark: Column | None = None) -> DataFrame:
    """The ledger: a row for each document and version, with its counts, and whether `mark` holds for the document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = T.text_bytes(b.column(3))
            for i, j in T.steps(offsets):
                tokens = counter_of(versions).count(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k, v in enumerate(versions):
                    rows = [b.column(c).slice(i, j - i) for c in (0, 1, 2, 4)]
                    yield pa.RecordBatch.from_arrays([*rows, pa.array([v] * (j - i), pa.string()), pa.array(tokens[:, k]), pa.array(np.diff(offsets[i : j + 1]))], ["doc_id", "source", "lang", "marked", "tokenizer", "n_tokens", "n_bytes"])

    kind = docs.schema[doc_id].dataType.simpleString()
    marked = F.lit(False) if mark is None else F.coalesce(mark, F.lit(False))
    rows = small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), marked.alias("marked"))
    return rows.mapInArrow(T.tidy(work), f"doc_id {kind}, source string, lang string, marked boolean, tokenizer string, n_tokens bigint, n_bytes bigint")


def signed(ledger: DataFrame, sign: int) -> DataFrame:
    """Ledger rows as a delta: +1 for inserts and new versions, -1 for deletes and old versions."""
    return ledger.select(*KEYS, F.lit(sign).cast("bigint").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"), (F.col("n_bytes") * sign).alias("n_bytes"))


def revision(old: DataFrame, new: DataFrame) -> DataFrame:
    return signed(old, -1).unionByName(signed(new, 1))


def _summed(delta: DataFrame) -> DataFrame:
    return delta.groupBy(*KEYS).agg(*(F.sum(c).cast("bigint").alias(c) for c in SUMS))


class Store:
    """Totals in a folder that all executors share.

    commits/BATCH holds a batch's delta. folded/NAME holds a compaction's sums (sums) and the names of the commits that it took in (names). live/N names the
    compaction that counts; the largest N is the pointer. known/BATCH says, once the pointer has moved, that the batch is in a compaction.

    A reader takes what the pointer names and the commits that are not known, and looks at the pointer again once it has listed all files: if it
    moved, the reader begins anew. Nothing that the pointer or the one before it needs is deleted: a compaction's commits go when the next one counts, its sums when the one
    after that does. So totals that were planned stay readable through one compaction, and fail aloud after two. What is listed is bounded by the commits of two compactions."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(folder).getFileSystem(conf)
        root = self._fs.makeQualified(self._path(folder))
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf)
        self._plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        for name in ("commits", "folded", "live", "side", "known"):
            self._fs.mkdirs(self._path(f"{folder}/{name}"))

    def _names(self, what: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{what}")))

    def _renamed(self, source: str, target: str) -> bool:
        """A rename that never replaces and never moves into what is there."""
        try:
            self._context.rename(self._fs.makeQualified(self._path(source)), self._fs.makeQualified(self._path(target)), self._plain)
        except Py4JJavaError as e:
            if self._fs.exists(self._path(target)) and "FileAlreadyExists" in e.java_exception.getClass().getName():
                self._fs.delete(self._path(source), True)
                return False
            raise
        return True

    def commit(self, batch: str, delta: DataFrame) -> bool:
        """Add the batch's delta once; False if a batch of that id was there, folded or not."""
        name = quote(batch, safe="")
        target = f"{self.folder}/commits/{name}"
        if self._known(name) or self._fs.exists(self._path(target)):
            return False
        side = f"{self.folder}/side/{uuid.uuid4().hex}"
        _summed(delta).write.parquet(side)
        if not self._renamed(side, target):
            return False
        if self._known(name):  # folded and gone since the first look; no reader counts what is known
            self._fs.delete(self._path(target), True)
            return False
        return True

    def _known(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/known/{name}"))

    def _generations(self) -> list[tuple[int, str]]:
        """(number, folder) of the compactions that the pointers name, oldest first. Few: old pointers go with their sums."""
        out = []
        for n in self._names("live"):
            stream = self._fs.open(self._path(f"{self.folder}/live/{n}"))
            try:
                out.append((int(n), f"{self.folder}/folded/{stream.readUTF()}"))
            finally:
                stream.close()
        return out

    def _pointer(self) -> str | None:
        return max(self._names("live"), default=None)

    def _open(self, folded: str | None) -> list[str]:
        """Commits that are in no compaction."""
        done = set(self._taken(folded)) if folded else set()
        return [n for n in self._names("commits") if n not in done and not self._known(n)]

    def _taken(self, folded: str) -> list[str]:
        """The commits that a compaction took in: those between it and the one before."""
        return [r.name for r in self.spark.read.schema("name string").parquet(f"{folded}/names").collect()]

    def _rows(self, folded: str | None, names: list[str]) -> DataFrame:
        """Its files are listed here and now, all of them or none."""
        paths = [f"{self.folder}/commits/{n}" for n in names] + ([f"{folded}/sums"] if folded else [])
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def _read(self) -> DataFrame:
        """All deltas as of one moment."""
        while True:
            pointer, rows = self._pointer(), None
            try:
                folded = dict((f"{k:012d}", f) for k, f in self._generations()).get(pointer) if pointer else None
                if folded or not pointer:
                    rows = self._rows(folded, self._open(folded))
            except (AnalysisException, Py4JJavaError):  # files of an older compaction went while they were listed
                if self._pointer() == pointer:
                    raise
            if rows is not None and self._pointer() == pointer:
                return rows

    def totals(self) -> DataFrame:
        """Current totals; groups whose documents are all gone drop out."""
        return _summed(self._read()).filter("n_docs <> 0 or n_tokens <> 0 or n_bytes <> 0")

    def compact(self) -> bool:
        """One compaction in place of the last one and all commits since. A crash at any step changes no total; of two
        maintainers at once one wins. False if there is nothing to fold or the other has won."""
        generations = self._generations()
        last, folded = generations[-1] if generations else (-1, None)
        if folded:
            self._settle(generations)
        names = self._open(folded)
        if not names:
            return False
        new = uuid.uuid4().hex
        _summed(self._rows(folded, names)).write.parquet(f"{self.folder}/folded/{new}/sums")
        self.spark.createDataFrame([(n,) for n in names], "name string").write.parquet(f"{self.folder}/folded/{new}/names")
        side = f"{self.folder}/side/{new}"
        stream = self._fs.create(self._path(side), False)
        stream.writeUTF(new)
        stream.close()
        if not self._renamed(side, f"{self.folder}/live/{last + 1:012d}"):
            self._fs.delete(self._path(f"{self.folder}/folded/{new}"), True)
            return False
        self._settle([*generations, (last + 1, f"{self.folder}/folded/{new}")])
        return True

    def _settle(self, generations: list[tuple[int, str]]) -> None:
        """Mark the commits of the compaction that counts; delete the commits of the one before it, and the sums of those still before. Each step may be
        done again by whoever comes next."""
        for name in self._taken(generations[-1][1]):
            self._fs.mkdirs(self._path(f"{self.folder}/known/{name}"))
        if len(generations) > 1:
            for name in self._taken(generations[-2][1]):
                self._fs.delete(self._path(f"{self.folder}/commits/{name}"), True)
        for k, folded in generations[:-2]:
            self._fs.delete(self._path(folded), True)
            self._fs.delete(self._path(f"{self.folder}/live/{k:012d}"), False)


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def masked(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "<email>")


def maintain(docs: DataFrame, gone: DataFrame, folder: str, versions: tuple[str, ...] = VERSIONS) -> DataFrame:
    """The query's life of a corpus: all documents arrive; the same batch is delivered again; documents with an e-mail
    address are revised (address masked); documents that `gone` names are deleted with the counts they have then."""
    store = Store(docs.sparkSession, folder)
    ledger = stage(count(docs, versions, mark=F.col("text").rlike(EMAIL)))
    store.commit("arrival", signed(ledger, 1))
    store.commit("arrival", signed(ledger, 1))
    changed = docs.filter(F.col("text").rlike(EMAIL))
    new = stage(count(changed.withColumn("text", masked(F.col("text"))), versions))
    store.commit("revision", revision(ledger.filter("marked"), new))
    now = ledger.filter("not marked").unionByName(new)
    gone = small(stage(gone.select("doc_id").distinct(), light=True), 16)
    store.commit("deletion", signed(now.join(gone, "doc_id", "left_semi"), -1))
    return store.totals()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return maintain(docs, labels.filter("toxic = 1"), f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
