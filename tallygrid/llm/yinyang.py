"""Vector code compression: a product quantiser whose codebooks are trained by Yinyang Lloyd, in integers.

A vector is cut into equal parts and each part is coded as the number of its codebook's nearest entry. The entries of a codebook are clustered into groups
once. Every part of every vector keeps one lower bound a group: what its distance to any entry of the group, its own excepted, is at least.
When entries move, a group's bound falls by the farthest that any of its entries moved. A group whose bound still lies strictly above the distance to the
own entry holds neither a nearer entry nor a tie, and is not scanned. Bounds are integers, rounded down (drifts and the own distance are rounded up), and
what is scanned is compared by integer squares and entry numbers, so rounding can cost a scan but never changes a code.

A round is one pass over a written table of vectors with codes and bounds, written anew in the shared folder; the old one goes. Sums by part and entry are partial aggregates;
entries * parts rows go to the driver, which has the codebooks (both numbers are parameters).

Defined cases: null vectors and those with a null or non-finite component have no row; ids that are null are the last to be first entries, and of repeated ids the smaller vector is
the earlier; repeated rows are rows of their own; with fewer vectors than entries the codebooks have as many entries as there are vectors; equal entries: the
lower index is used; a null label is a label; vectors whose length differs from `dims` fail the job by name, as codes over them share no parts, and so does a component beyond
vectors.BOUND; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm import vectors as V
from tallygrid.llm.staging import discard, small, stage

PARTS, ENTRIES, ROUNDS, SCALE, DIMS, GROUPS = 4, 256, 4, 1024, 64, 16
_FAR = 1 << 30


def grouped(book: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each entry: a few rounds of k-means over the codebook, from entries evenly apart. Any grouping gives the same codes."""
    centres = book[np.linspace(0, len(book) - 1, min(groups, len(book))).astype(int)]
    for _ in range(rounds):
        group = V.distances(book, centres).argmin(axis=1)
        for g in np.unique(group):
            centres[g] = book[group == g].mean(axis=0)
    return np.unique(group, return_inverse=True)[1]


class Codebook:
    """One part's entries, their groups, and how far each group has drifted since the bounds were made."""

    def __init__(self, entries: np.ndarray, group: np.ndarray, drift: np.ndarray):
        self.entries, self.group, self.drift = entries, group, drift
        self.members = [np.flatnonzero(group == g) for g in range(len(drift))]

    @classmethod
    def first(cls, entries: np.ndarray, groups: int = GROUPS) -> Codebook:
        group = grouped(entries, groups)
        return cls(entries, group, np.zeros(int(group.max()) + 1, dtype=np.int64))

    def moved(self, entries: np.ndarray) -> Codebook:
        far = V.root_above(V.row_distances(entries, self.entries))
        return Codebook(entries, self.group, np.array([far[m].max() for m in self.members]))

    def assign(self, x: np.ndarray, code: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(code, squared distance, bounds, distances computed) of the parts x, from their codes and bounds of the round before."""
        lower = np.maximum(lower - self.drift, 0)
        code, best = code.copy(), V.row_distances(x, self.entries[code])
        reach, done = V.root_above(best), len(x)
        for g, members in enumerate(self.members):
            at = np.flatnonzero(lower[:, g] <= reach)
            if not len(at):
                continue
            apart = V.distances(x[at], self.entries[members])
            done += apart.size
            row, place = np.arange(len(at)), apart.argmin(axis=1)  # members ascend, so the first of equals is the lowest entry
            least, nearest = apart[row, place], members[place]
            apart[row, place] = _FAR * _FAR
            second = np.minimum(apart.min(axis=1), _FAR * _FAR)
            won = (least < best[at]) | (least == best[at]) & (nearest < code[at])
            lower[at, g] = V.root_below(np.where(won | (nearest == code[at]), second, least))
            left = won & (self.group[code[at]] != g)  # the entry that was left is one of its group's others now
            home = at[left], self.group[code[at[left]]]
            lower[home] = np.minimum(lower[home], V.root_below(best[at[left]]))
            code[at[won]], best[at[won]] = nearest[won], least[won]
            reach[at[won]] = V.root_above(least[won])
        return code, best, lower, done


_ROW = "vec_id {}, label {}, v array<int>, code array<int>, lower array<int>, error bigint"


def _scan(books: list[Codebook], dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts, width = len(books), dims // len(books)
    edges = np.cumsum([0, *(len(b.members) for b in books)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, code = V.matrix(b.column("v"), dims), V.matrix(b.column("code"), parts)
            fresh = b.column("lower").null_count > 0  # the first round: nothing is bounded
            lower = np.zeros((len(x), edges[-1]), dtype=np.int64) if fresh else V.matrix(b.column("lower"), int(edges[-1]))
            error = np.zeros(len(x), dtype=np.int64)
            for p, book in enumerate(books):
                code[:, p], apart, lower[:, edges[p] : edges[p + 1]], _ = book.assign(x[:, p * width : (p + 1) * width], code[:, p], lower[:, edges[p] : edges[p + 1]])
                error += apart
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), V.lists(code), V.lists(lower), pa.array(error, pa.int64())], ["vec_id", "label", "v", "code", "lower", "error"])

    return work


def sums(rows: DataFrame, parts: int, dims: int) -> list[dict[int, tuple[int, list[int]]]]:
    """Count and componentwise sums of each entry, by part: parts * entries rows."""
    width = dims // parts
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col("code")[p].alias("entry"), F.slice("v", p * width + 1, width).alias("x")) for p in range(parts)])).alias("e")
    got = rows.select(each).groupBy("e.part", "e.entry").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("e.x")[i]).alias(f"s{i}") for i in range(width)]).collect()
    out: list[dict] = [{} for _ in range(parts)]
    for r in got:
        out[r["part"]][r["entry"]] = (r["n"], list(r[3:]))
    return out


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, groups: int = GROUPS, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, v, code, lower, error) of every usable vector after the last round, and the codebooks (parts, entries, dims / parts)."""
    if not (0 < entries <= 256 and 0 < dims <= V.MOST_DIMS and parts > 0 and dims % parts == 0):
        raise ValueError("codes have a byte a part, and parts divide the dimensions")
    whole = F.col("vector")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")).filter(V.usable(whole))
    fits = F.when(F.size(whole) == dims, V.integers(whole, scale)).otherwise(F.raise_error(F.concat(F.lit(f"a vector has not {dims} components but "), F.size(whole).cast("string"))))
    none = F.lit(None).cast("array<int>")
    now = stage(rows.select("vec_id", "label", fits.cast("array<int>").alias("v"), F.array_repeat(F.lit(0), parts).alias("code"), none.alias("lower"), F.lit(0).cast("bigint").alias("error")))
    first = np.array([r["v"] for r in now.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()], dtype=np.int64)
    if not len(first):
        return now, np.zeros((parts, 0, dims // parts), dtype=np.int64)
    books = [Codebook.first(b, groups) for b in np.split(first, parts, axis=1)]
    kinds = [now.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    for after in range(rounds + 1):
        last, now = now, stage(now.mapInArrow(_scan(books, dims), _ROW.format(*kinds)))
        discard(last)
        if after < rounds:
            books = [b.moved(V.means(b.entries, s)) for b, s in zip(books, sums(now, parts, dims), strict=True)]
    return now, np.stack([b.entries for b in books])


def hexed(code: Column, parts: int) -> Column:
    """Two hex digits an index, in part order."""
    return F.lower(F.concat(*[F.lpad(F.hex(code[p]), 2, "0") for p in range(parts)]))


def compress(vectors: DataFrame, **options) -> tuple[DataFrame, np.ndarray]:
    """One row a usable vector: vec_id, code, error, label_error, codebooks_sha256; and the codebooks. `options` as of fit."""
    rows, books = fit(vectors, **options)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    by_label = stage(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), light=True)
    joined = rows.join(small(by_label, 64), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", hexed(F.col("code"), len(books)).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")), books


def expand(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """codes with `vector`: what the codes stand for, the middle of each component's interval."""
    at = [F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") for p in range(len(books))]
    spark = codes.sparkSession
    for p, book in enumerate(books):  # a side has at most 256 rows
        side = spark.createDataFrame([(k, [(int(c) + 0.5) / scale for c in row]) for k, row in enumerate(book)], f"_e{p} int, _x{p} array<double>")
        codes = codes.join(F.broadcast(side), at[p] == F.col(f"_e{p}"))
    return codes.withColumn("vector", F.concat(*[f"_x{p}" for p in range(len(books))])).drop(*[f"_{c}{p}" for p in range(len(books)) for c in "ex"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def _sql() -> str:
    width = DIMS // PARTS
    apart = " + ".join(f"(x.v[{i}] - c.v[{i}]) * (x.v[{i}] - c.v[{i}])" for i in range(1, width + 1))
    steps = [
        f"w AS MATERIALIZED (SELECT vec_id, label, [CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0)",
        f"x AS MATERIALIZED (SELECT vec_id, p, v[p * {width} + 1 : p * {width} + {width}] AS v FROM (SELECT vec_id, v, unnest(range({PARTS})) AS p FROM w))",
        f"c0 AS MATERIALIZED (SELECT p, k, v FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, v FROM x) WHERE k < {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x.p, any_value(x.v) AS v, min(({apart}) * {ENTRIES} + k) AS best FROM x JOIN c{r} c ON x.p = c.p GROUP BY vec_id, x.p)")
        if r < ROUNDS:
            steps.append(f"m{r} AS MATERIALIZED (SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT p, k, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, best % {ENTRIES} AS k, unnest(v) AS e, unnest(range({width})) AS i FROM a{r}) GROUP BY p, k, i) GROUP BY p, k)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.p = c.p AND m.k = c.k)")
    return f"""WITH {", ".join(steps)},
t AS (SELECT vec_id, string_agg(format('{{:02x}}', CAST(best % {ENTRIES} AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT w.vec_id, t.code, t.error, CAST(sum(t.error) OVER (PARTITION BY w.label) AS BIGINT) AS label_error, b.codebooks_sha256 FROM w JOIN t ON t.vec_id = w.vec_id CROSS JOIN b"""


SQL = _sql()
