"""Queries of the evaluation panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.operators import panel as P
from tallygrid.plans.base import SCORED, rounded, scored
from tallygrid.sources.readers import table


def items(spark, d):
    docs = table(spark, d, "documents")
    classes = docs.select(F.col("lang").alias("name")).distinct().withColumn("class_id", F.crc32(F.col("name").cast("binary")))
    rows = docs.select(F.col("doc_id").alias("row_no"), F.col("source").alias("query"), F.crc32(F.col("lang").cast("binary")).alias("class_id"))
    out = P.items_from_labeled(rows, classes, "corpus", F.lit("Which language is it?"))
    return out.select("set", "id", "k", "state", F.array_join("criteria", ",").alias("criteria"), "gold")


def questions(spark, d):
    """A set by row number's remainder; each third question of a type; every eleventh request failed."""
    s = scored(spark, d)
    kind = F.element_at(F.array(F.lit("choice"), F.lit("noul"), F.lit("score")), (F.col("row_id") % 3 + 1).cast("int"))
    s = s.withColumn("type", kind)
    noul = F.col("type") == "noul"
    yes = F.get("q", F.lit(0)) + F.get("q", F.lit(1)) + F.get("q", F.lit(2))
    probs = F.when(noul, F.array(1 - yes, yes)).otherwise(F.transform("q", lambda p: 2 * p))
    gold = F.when(noul, (F.col("label") < 3).cast("int")).otherwise(F.col("gold"))
    score_probs = F.when(F.col("type") == "score", F.col("q")).otherwise(probs)
    return s.select(F.concat(F.lit("set"), (F.col("row_id") % 4).cast("string")).alias("set"), F.col("row_id").alias("id"), "type", F.size(score_probs).alias("k"), score_probs.alias("probs"), gold.alias("gold_pos"), F.when(F.col("row_id") % 11 == 0, "timeout").alias("error"))


def scored_questions(spark, d):
    return P.score_or_fail(questions(spark, d))


def panel_score(spark, d):
    return rounded(scored_questions(spark, d).select("id", "type", "top1", "metric", "chance", "conf", "nll", "brier", "p_yes"))


def panel_summary(spark, d):
    return rounded(P.summarize(scored_questions(spark, d)))


def answers(spark, d):
    q = questions(spark, d).withColumn("names", F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.concat(F.lit("o"), i.cast("string"))))
    a = P.answers(q)
    return rounded(a.select("id", "answer.choice", "answer.noul", "answer.score", "answer.confidence"))


def bad_distributions(spark, d):
    return P.bad_distributions(questions(spark, d)).select("id")


def manifest(spark, d):
    """Items and an order-free checksum of each set."""
    q = questions(spark, d).select("set", "id", "type")
    return q.groupBy("set").agg(F.count(F.lit(1)).alias("items"), F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "id", "type"))), ",")).alias("digest"))


_Q = SCORED + """, t AS (SELECT row_id AS id, any_value(gold) AS label, 'set' || CAST(row_id % 4 AS VARCHAR) AS set, CASE row_id % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'noul' ELSE 'score' END AS type, CASE WHEN row_id % 11 = 0 THEN 'timeout' END AS error, sum(CASE WHEN pos < 3 THEN p ELSE 0 END) AS yes, sum(p * pos) AS e FROM p GROUP BY row_id),
s AS (SELECT t.id, t.set, t.type, t.error, CASE WHEN t.error IS NOT NULL THEN FALSE WHEN type = 'noul' THEN (yes >= 0.5) = (label < 3) ELSE f.ok END AS top1,
CASE WHEN t.error IS NOT NULL THEN 0 WHEN type = 'noul' THEN CASE WHEN (yes >= 0.8::DOUBLE AND label < 3) OR (yes <= 0.2::DOUBLE AND label >= 3) THEN 1 ELSE 0 END WHEN type = 'score' THEN 1 - abs(e - label) / 9 ELSE CASE WHEN f.ok THEN 1 ELSE 0 END END AS metric,
CASE WHEN type = 'choice' THEN 0.1::DOUBLE WHEN type = 'noul' AND t.error IS NULL THEN 0.5::DOUBLE END AS chance,
CASE WHEN t.error IS NULL THEN CASE WHEN type = 'noul' THEN greatest(yes, 1 - yes) ELSE conf END END AS conf,
CASE WHEN t.error IS NULL THEN -ln(greatest(CASE WHEN type = 'noul' THEN CASE WHEN label < 3 THEN yes ELSE 1 - yes END ELSE pg END, 1e-12)) END AS nll,
CASE WHEN t.error IS NULL THEN CASE WHEN type = 'noul' THEN 2 * power(CASE WHEN label < 3 THEN 1 - yes ELSE yes END, 2) ELSE brier END END AS brier,
CASE WHEN t.error IS NULL AND type = 'noul' THEN yes END AS p_yes FROM t JOIN f ON t.id = f.row_id)
"""
TABLE = {
    "panel_items": (items, "SELECT 'corpus' AS set, 'corpus-' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(5, length(CAST(doc_id AS VARCHAR))) AS INT), '0') AS id, CAST((SELECT count(DISTINCT lang) FROM documents) AS INT) AS k, source AS state, (SELECT string_agg(lang, ',' ORDER BY lang) FROM (SELECT DISTINCT lang FROM documents)) AS criteria, lang AS gold FROM documents"),
    "panel_score": (panel_score, _Q + "SELECT id, type, top1, round(CAST(metric AS DOUBLE), 6) AS metric, chance, round(conf, 6) AS conf, round(nll, 6) AS nll, round(brier, 6) AS brier, round(p_yes, 6) AS p_yes FROM s"),
    "panel_summary": (panel_summary, _Q + f""", g AS (SELECT set, avg(CASE WHEN type = 'choice' THEN metric END) AS a, avg(CASE WHEN type = 'choice' THEN chance END) AS c FROM s GROUP BY set),
h AS (SELECT set, sum(abs(s1 - h1)) / sum(n1) AS ece FROM (SELECT set, least(CAST(floor(conf * 10) AS BIGINT), 9) AS bin, count(*) AS n1, sum(conf) AS s1, CAST(sum(CASE WHEN top1 THEN 1 ELSE 0 END) AS DOUBLE) AS h1 FROM s WHERE conf IS NOT NULL GROUP BY set, bin) GROUP BY set)
SELECT s.set, count(*) AS n, count(*) FILTER (error IS NOT NULL) AS errors, round(avg(CASE WHEN top1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS top1, round((any_value(a) - any_value(c)) / (1 - any_value(c)), 6) AS choice, round(avg(CASE WHEN type = 'noul' THEN metric END), 6) AS noul, round(avg(CASE WHEN type = 'score' THEN metric END), 6) AS score,
count(*) FILTER (type = 'choice') AS n_choice, count(*) FILTER (type = 'noul') AS n_noul, count(*) FILTER (type = 'score') AS n_score, round(avg(conf), 6) AS conf, round(avg(nll), 6) AS nll, round(avg(brier), 6) AS brier,
round(count(*) FILTER (p_yes <= 0.2::DOUBLE OR p_yes >= 0.8::DOUBLE) / CAST(count(p_yes) AS DOUBLE), 6) AS noul_decisive, round(avg(CASE WHEN p_yes <= 0.2::DOUBLE OR p_yes >= 0.8::DOUBLE THEN metric END), 6) AS noul_decisive_acc, round(any_value(ece), 6) AS ece FROM s JOIN g ON s.set = g.set JOIN h ON s.set = h.set GROUP BY s.set"""),
    "panel_answers": (answers, _Q + "SELECT t.id, CASE WHEN t.type = 'choice' THEN 'o' || CAST(f.pred AS VARCHAR) END AS choice, round(CASE WHEN t.type = 'noul' THEN yes END, 6) AS noul, round(CASE WHEN t.type = 'score' THEN e END, 6) AS score, round(CASE t.type WHEN 'score' THEN (10 * conf - 1) / 9 WHEN 'choice' THEN least(1, greatest(0, (20 * conf - 1) / 9)) END, 6) AS confidence FROM t JOIN f ON t.id = f.row_id"),
    "output_sanity": (bad_distributions, "SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 = 0"),
    "manifest_checksums": (manifest, "SELECT 'set' || CAST(vec_id % 4 AS VARCHAR) AS set, count(*) AS items, md5(string_agg(x, ',' ORDER BY x)) AS digest FROM (SELECT vec_id, CAST(vec_id AS VARCHAR) || ':' || CASE vec_id % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'noul' ELSE 'score' END AS x FROM embeddings) GROUP BY vec_id % 4"),
}
