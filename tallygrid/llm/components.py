"""Connected components of an edge table, by alternating large-star and small-star steps, all in tables.

Each step is a partial minimum by node and a join back, so a node with very many neighbours costs one row a task in
the minimum, and its rows in the join are a skew that Spark splits. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): for each node of an edge the smallest node that it reaches. Self-edges and repeats are fine; an
    empty table gives an empty one."""
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = stage(pair, light=True)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above a node hang on the least of its neighbourhood
        large = both.join(_minimum(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
        large = large.unionByName(now.filter("u = v"))
        # small star: neighbours below a node, and the node, hang on the least of them
        small = large.join(_minimum(large), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct("u", F.col("least").alias("v")))).alias("e")).select("e.u", "e.v")
        now = stage(small.distinct(), light=True)
        mark = now.select(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if mark == before or mark[0] == 0:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
        before = mark
