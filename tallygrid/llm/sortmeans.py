"""Centroid clustering by sort-means, in integers.

Each round sorts, for every centroid, the other centroids by their distance from it. A vector is held against the centroid that it had, and
then against the others in that centroid's order, until one is strictly farther than twice the vector's current distance: by the triangle
inequality neither it nor any behind it can be as near. Distances are squared 64-bit integers, so the bound is 4 times the square, ties are real
ties, and the result equals that of a full scan.

A round is one pass over a written table of vectors with their clusters, which is written anew with the new clusters in the shared folder; the old
one goes. Sums by cluster are partial aggregates; k rows go to the driver, which has the k centroids (k is a parameter) and sends them with the
next round's tasks.

Defined cases: vectors that are null, of another length than `dims`, or with a null or non-finite component have no row in the result; a null id hashes to
null and comes last among the seeds; of repeated ids the smaller vector is the earlier seed; repeated rows are rows of their own; with fewer
vectors than k there are as many centroids as vectors; a component beyond vectors.BOUND fails the job; other columns are ignored, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm import vectors as V
from tallygrid.llm.staging import discard, stage

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: The most centroids: k * k distances and k * dims numbers go with every task.
MOST_CLUSTERS = 4096


class Order:
    """For each centroid the others, nearest first (ties: smaller number), and their squared distances."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        apart = V.distances(centroids, centroids)
        np.fill_diagonal(apart, -1)  # itself first, and then dropped
        self.others = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.others, axis=1)

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector (ties: smaller number) and its squared distance, from the one it had before."""
        cluster, distance = before.copy(), V.row_distances(x, self.centroids[before])
        for a in np.unique(before):
            at = np.flatnonzero(before == a)
            reach = np.searchsorted(self.apart[a], 4 * distance[at], side="right")  # centroids at exactly twice the distance may still tie
            for rank in range(int(reach.max(initial=0))):
                at, reach = at[reach > rank], reach[reach > rank]
                other = self.others[a, rank]
                far = V.row_distances(x[at], self.centroids[other])
                nearer = (far < distance[at]) | (far == distance[at]) & (other < cluster[at])
                cluster[at[nearer]], distance[at[nearer]] = other, far[nearer]
        return cluster, distance


_ROW = "vec_id {}, v array<int>, cluster int, distance bigint"


def _scan(order: Order, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cluster, distance = order.assign(V.matrix(b.column("v"), dims), b.column("cluster").to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "v", "cluster", "distance"])

    return work


def sums(rows: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of each cluster: k rows."""
    got = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims)]).collect()
    return {r["cluster"]: (r["n"], list(r[2:])) for r in got}


def seeds(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k smallest sha256 of `seed:id`; each task sends k rows at most."""
    at = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in rows.select("v", at.alias("at")).orderBy(F.asc_nulls_last("at"), "v").limit(k).collect()], dtype=np.int64)


def fit(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance) of every usable vector after the last round, and the integer centroids."""
    if not (0 < k <= MOST_CLUSTERS and 0 < dims <= V.MOST_DIMS):
        raise ValueError(f"k must be within {MOST_CLUSTERS} and dims within {V.MOST_DIMS}")
    whole = F.col("vector")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")).filter((F.size(whole) == dims) & V.usable(whole))
    now = stage(rows.select("vec_id", V.integers(whole, scale).alias("v"), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")))
    centroids = seeds(now, k, seed)
    for after in range(rounds + 1):
        if not len(centroids):
            break
        last, now = now, stage(now.mapInArrow(_scan(Order(centroids), dims), _ROW.format(now.schema["vec_id"].dataType.simpleString())))
        discard(last)
        if after < rounds:
            centroids = V.means(centroids, sums(now, dims))
    return now, centroids


def cluster(vectors: DataFrame, **options) -> DataFrame:
    """One row a usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. `options` as of fit."""
    rows, centroids = fit(vectors, **options)
    inertia = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    every = sum(inertia.values())
    named = [(k, s, every, hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, s in inertia.items()]
    side = rows.sparkSession.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    apart = " + ".join(f"(x.v[{i}] - c.v[{i}]) * (x.v[{i}] - c.v[{i}])" for i in range(1, DIMS + 1))
    parts = [
        f"x AS MATERIALIZED (SELECT vec_id, [CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS v FROM embeddings WHERE len(embedding) = {DIMS} AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0)",
        f"c0 AS MATERIALIZED (SELECT k, v FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k, v FROM x) WHERE k < {CLUSTERS})",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(x.v) AS v, min(({apart}) * {CLUSTERS} + k) AS best FROM x CROSS JOIN c{r} c GROUP BY vec_id)")
        if r < ROUNDS:
            parts.append(f"m{r} AS MATERIALIZED (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT k, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT best % {CLUSTERS} AS k, unnest(v) AS e, unnest(range({DIMS})) AS i FROM a{r}) GROUP BY k, i) GROUP BY k)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.k = c.k)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.best % {CLUSTERS} AS INTEGER) AS cluster, CAST(a.best // {CLUSTERS} AS BIGINT) AS distance, CAST(sum(a.best // {CLUSTERS}) OVER (PARTITION BY a.best % {CLUSTERS}) AS BIGINT) AS cluster_inertia,
CAST(sum(a.best // {CLUSTERS}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.k = a.best % {CLUSTERS}"""


SQL = _sql()
