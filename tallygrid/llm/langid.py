"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector, drawn from a hash of its code point. The vector of an n-gram binds
(multiplies) its letters' vectors, each permuted (rolled) by its place from the right. A document's vector bundles (adds) its
n-grams' vectors, and a language's prototype bundles the unit vectors of its sample. The prediction is the
prototype with the largest cosine.

A step of documents is a counts matrix (documents by the step's distinct n-grams) times the n-grams' vectors, one
matrix product, so no n-gram leaves the worker and nothing is shuffled.

Sequences: lower-cased text, every run of non-letters one blank, one blank at either end; three symbols an n-gram.
Defined cases: null text or text without a letter is `und` with score 0; ties go to the first language by name;
without any labelled document all is `und`; documents without lang are predicted but not learned from; repeated
rows count as often as they stand. The prototypes are fitted on a bounded sample, SAMPLE_PER_LANGUAGE documents a
language, whole texts; all documents are predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as T
from .staging import small, small_batches, stage

DIMENSIONS = 1024
#: The bound of the fit: so many documents of each language at most, from SALTS equal parts by hash of the id.
SAMPLE_PER_LANGUAGE, SALTS = 512, 16
#: Languages at most; a corpus has few, and a column that isn't a language should fail, not fill the driver.
LANGUAGES = 1000
UNKNOWN = "und"
_CELLS, _GRAMS, _STEP = 2 << 20, 4096, 1 << 20


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row of -1 and 1 for each code point, the same wherever it is drawn."""
    words = T.splitmix64(T.splitmix64(points.astype(np.uint64))[:, None] + np.arange(dimensions // 64, dtype=np.uint64)[None, :])
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


class Grams:
    """The n-grams of a step: for each its document and its number among the distinct ones, and their letters."""

    def __init__(self, texts: list[str | None]):
        low = [f" {t.lower()} " if t else " " for t in texts]
        size = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
        points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        row = np.repeat(np.arange(len(low)), size)
        present = np.flatnonzero(np.bincount(points))
        letters = np.array([c for c in present if chr(c).isalpha()], dtype=np.int64)
        symbol = np.zeros(int(points.max(initial=0)) + 1, dtype=np.int32)
        symbol[letters] = np.arange(1, len(letters) + 1)
        sequence = symbol[points]
        keep = sequence > 0
        self.letters = np.bincount(row[keep], minlength=len(low))
        first = np.concatenate([[True], row[1:] != row[:-1]])
        keep[1:] |= (sequence[:-1] > 0) & (row[1:] == row[:-1])
        keep |= first
        sequence, row = sequence[keep].astype(np.int64), row[keep]
        inside = row[2:] == row[:-2] if len(row) > 2 else np.zeros(0, dtype=bool)
        k = len(letters) + 1
        code = ((sequence[:-2] * k + sequence[1:-1]) * k + sequence[2:])[inside] if len(row) > 2 else np.zeros(0, dtype=np.int64)
        self.row = row[:-2][inside] if len(row) > 2 else np.zeros(0, dtype=np.int64)
        if k**3 <= 1 << 22:
            codes = np.flatnonzero(np.bincount(code, minlength=1)) if len(code) else code
            number = np.zeros(k**3, dtype=np.int64)
            number[codes] = np.arange(len(codes))
            self.number = number[code]
        else:
            codes, self.number = np.unique(code, return_inverse=True)
        self.codes, self.k = codes, k
        self.points = np.concatenate([[32], letters])

    def vectors(self, lo: int, hi: int, dimensions: int) -> np.ndarray:
        v = letter_vectors(self.points, dimensions)
        code = self.codes[lo:hi]
        a, b, c = code // (self.k * self.k), code // self.k % self.k, code % self.k
        return (np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]).astype(np.float32)


def bundles(texts: list[str | None], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's bundle as a unit vector (zero without letters), and its number of letters."""
    g = Grams(texts)
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    begin = np.searchsorted(g.row, np.arange(len(texts) + 1))
    for lo in range(0, len(g.codes), _GRAMS):
        hi = min(lo + _GRAMS, len(g.codes))
        v = g.vectors(lo, hi, dimensions)
        few = max(1, _CELLS // (hi - lo))
        for i in range(0, len(texts), few):
            j = min(i + few, len(texts))
            s = slice(begin[i], begin[j])
            number, row = g.number[s], g.row[s] - i
            mine = (number >= lo) & (number < hi)
            counts = np.bincount(row[mine] * (hi - lo) + number[mine] - lo, minlength=(j - i) * (hi - lo))
            out[i:j] += counts.reshape(j - i, hi - lo).astype(np.float32) @ v
    out[g.letters == 0] = 0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1), g.letters


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str | None]]]:
    _, offsets = T.text_bytes(batch.column(column))
    for i, j in T.steps(offsets, _STEP):
        yield i, j, batch.column(column).slice(i, j - i).to_pylist()


def sample(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Ids and languages of the bounded sample. Ranks are taken within salted parts of a language, so that no task
    holds a whole language; the limit is pushed below the shuffle."""
    salts = max(1, min(SALTS, per_language))
    salt = F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(salts))
    order = Window.partitionBy("lang", "salt").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = labelled.select("doc_id", "lang", salt.alias("salt")).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= per_language // salts).select("doc_id", "lang")


def fit(docs: DataFrame, learn_from, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages by name and their unit prototypes, from the sample of the rows where `learn_from` holds."""
    rows = docs.filter(learn_from & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    if rows.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    chosen = small(stage(sample(rows, per_language).select("doc_id").distinct(), light=True), 16)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for i, j, texts in _parts(b, 0):
                v, letters = bundles(texts)
                langs = np.array(b.column(1).slice(i, j - i).to_pylist(), dtype=object)
                for x in {x for x, n in zip(langs, letters, strict=True) if n}:
                    sums[x] = sums.get(x, 0) + v[langs == x].sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["lang", "total"])

    parts = small_batches(rows).join(chosen, "doc_id", "left_semi").select("text", "lang").mapInArrow(T.tidy(partial), "lang string, total binary")
    totals: dict[str, np.ndarray] = {}
    for r in parts.toLocalIterator():  # a row a task and language
        totals[r.lang] = totals.get(r.lang, 0) + np.frombuffer(r.total, dtype=np.float64)
    names = sorted(totals)
    p = np.array([totals[x] / max(np.linalg.norm(totals[x]), 1e-12) for x in names], dtype=np.float32).reshape(len(names), DIMENSIONS)
    return names, p


def predictor(names: list[str], prototypes: np.ndarray):
    """texts -> (languages, scores), the cosine cut to 0..1."""

    def predict(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        v, letters = bundles(texts)
        if not names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cosine = v @ prototypes.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best].astype(np.float64), 0, 1)
        return [names[k] if n else UNKNOWN for k, n in zip(best, letters, strict=True)], np.where(letters > 0, score, 0.0)

    return predict


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score; one row a document."""
    predict = predictor(*model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in _parts(b, 1):
                langs, scores = predict(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(T.tidy(work), f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", least: float = 0.0) -> DataFrame:
    """The documents whose language is found with a score above `least`, all columns as they are."""
    predict, place = predictor(*model), docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in _parts(b, place):
                langs, scores = predict(texts)
                yield b.slice(i, j - i).filter(pa.array([x != UNKNOWN for x in langs]) if least <= 0 else pa.array([x != UNKNOWN and s > least for x, s in zip(langs, scores, strict=True)]))

    return small_batches(docs).mapInArrow(T.tidy(work), docs.schema)


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text modulo 5; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, fit(docs, fold() != 0))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
