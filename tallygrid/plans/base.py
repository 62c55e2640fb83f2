"""The tables that stand in for scored questions, in Spark and as the opening of the DuckDB texts.

embeddings: option k is the centroid of class k, its score ten times the dot product, the gold option the label. documents with labels: yes/no questions whose
P(yes) follows from the text's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions import menus as M
from tallygrid.operators import metrics
from tallygrid.sources.readers import table


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, as the order of a sum is no part of a result."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, z, q, gold, label, options, family, decoy. Centroids are one row, as large as the menu."""
    e = table(spark, sf_dir, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centroid = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    menu = centroid.agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("menu"))
    dot = lambda c: F.aggregate(F.zip_with(c, "embedding", lambda a, b: a * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    rows = e.join(F.broadcast(menu)).select(F.col("vec_id").alias("row_id"), "label", F.transform("menu", lambda m: m["label"]).alias("options"), F.transform("menu", lambda m: 10 * dot(m["c"])).alias("z"))
    gold = M.position_of(F.col("options"), F.col("label"))
    family = F.when(F.col("row_id") % 7 != 0, F.concat(F.lit("f"), (F.col("row_id") % 4).cast("string")))
    decoy = F.when(F.col("row_id") % 3 != 0, (F.col("label") + 1) % F.size("options"))
    return rows.withColumns({"q": M.softmax(F.col("z")), "gold": gold, "family": family, "decoy": decoy.cast("int")})


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.features(scored(spark, sf_dir))


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p, y, lang."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", ((F.col("n_chars") % 97) / F.lit(96.0)).alias("p"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y")), "doc_id")


def passes(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    """question, pass, options, q, gold: rows shuffled by pass, the scores sharper in each."""
    s = scored(spark, sf_dir).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    order = M.shuffled(F.size("options"), F.col("row_id"), F.col("pass"))
    s = s.withColumn("_o", order)
    z = F.transform(M.taken(F.col("z"), F.col("_o")), lambda x: x * (1 + 0.25 * F.col("pass")))
    return s.select(F.col("row_id").alias("question"), "pass", M.taken(F.col("options"), F.col("_o")).alias("options"), M.softmax(z).alias("q"), M.position_of(F.col("_o"), F.col("gold")).alias("gold"), "label", "family", "decoy", F.col("row_id"))


#: DuckDB: p has a row for each question and option (row_id, gold, pos, z, p, rk), f a row for each question.
SCORED = """WITH d AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
c AS (SELECT label AS k, i, avg(v) AS cv FROM d GROUP BY label, i),
z AS (SELECT d.vec_id AS row_id, d.label AS gold, c.k AS pos, 10 * sum(d.v * c.cv) AS z FROM d JOIN c ON d.i = c.i GROUP BY d.vec_id, d.label, c.k),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY row_id)) AS e FROM z),
p AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, pos) AS rk FROM (SELECT row_id, gold, pos, z, e / sum(e) OVER (PARTITION BY row_id) AS p FROM e)),
f AS (SELECT row_id, any_value(gold) AS gold, max(p) AS conf, max(CASE WHEN rk = 1 THEN pos END) AS pred, max(CASE WHEN pos = gold THEN p END) AS pg, max(CASE WHEN pos = gold THEN rk END) AS grk,
  sum(power(p - CASE WHEN pos = gold THEN 1 ELSE 0 END, 2)) AS brier, count(*) AS k, max(CASE WHEN rk = 1 THEN pos END) = any_value(gold) AS ok,
  CASE WHEN row_id % 7 <> 0 THEN 'f' || CAST(row_id % 4 AS VARCHAR) END AS family, CASE WHEN row_id % 3 <> 0 THEN (any_value(gold) + 1) % 10 END AS decoy FROM p GROUP BY row_id)
"""
BINARY = """WITH b AS (SELECT d.doc_id, d.lang, (d.n_chars % 97) / CAST(96 AS DOUBLE) AS p, l.toxic AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""


def bins(source: str, conf: str, ok: str) -> str:
    """DuckDB text of an expected calibration error over a table."""
    return f"(SELECT sum(abs(s - h)) / sum(n) FROM (SELECT least(CAST(floor({conf} * 10) AS BIGINT), 9) AS bin, count(*) AS n, sum({conf}) AS s, CAST(sum(CASE WHEN {ok} THEN 1 ELSE 0 END) AS DOUBLE) AS h FROM {source} GROUP BY bin))"
