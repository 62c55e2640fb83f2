"""Queries of vocabulary scores, log-likelihood baselines, samplers and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.functions import menus as M
from tallygrid.operators import baseline as B
from tallygrid.plans.base import SCORED, passes, rounded, scored
from tallygrid.plans.scoring import _PASS
from tallygrid.sources.readers import table

def _slots():
    """The ten scores of a question are the vocabulary, codes are its first seven ids, a menu has three of them."""
    return F.array(F.col("row_id") % 3, F.lit(3).cast("bigint"), F.lit(5).cast("bigint"))


def _codes():
    return F.array(*[F.lit(k).cast("bigint") for k in range(7)])


def slot_gather(spark, d):
    slots = F.array(F.col("row_id") % 10, F.lit(-1).cast("bigint"), F.lit(3).cast("bigint"), F.lit(12).cast("bigint"))
    s = scored(spark, d).select("row_id", F.posexplode(B.gathered(F.col("z"), slots)).alias("no", "score"))
    return rounded(s)


def slot_log_probs(spark, d):
    s = scored(spark, d)
    each = [B.menu_log_probs(F.col("z"), _slots(), _codes(), kind) for kind in B.DENOMINATORS]
    zipped = F.arrays_zip(*[x.alias(n) for x, n in zip(each, ("menu", "codes", "vocab"), strict=True)])
    return rounded(s.select("row_id", F.posexplode(zipped).alias("no", "l")).select("row_id", "no", *[F.col("l")[n].alias(n) for n in ("menu", "codes", "vocab")]))


def slot_mass(spark, d):
    s = scored(spark, d)
    return rounded(s.select("row_id", *[c.alias(n) for n, c in B.answer_mass(F.col("z"), _slots(), _codes()).items()]))


def token_scores(spark, d):
    """A question's first 1 + row_id % 10 probabilities as a continuation, nulls behind."""
    lp = F.transform("q", lambda p, i: F.when(i <= F.col("row_id") % 10, F.ln(p)))
    s = scored(spark, d).withColumn("lp", lp)
    kinds = {f"{how}{'' if t else '_name'}": B.token_score(F.col("lp"), how, t) for how in ("sum", "avg") for t in (True, False)}
    return rounded(s.select("row_id", *[c.alias(f"s_{n}") for n, c in kinds.items()]))


def rank_summary(spark, d):
    """Scores without their fraction, so that some tie."""
    s = scored(spark, d).withColumn("z", F.transform("z", lambda x: F.floor(x).cast("double")))
    return rounded(B.rank_summary(s))


def against_prior(spark, d):
    s = scored(spark, d)
    mean = s.select(F.posexplode("z").alias("pos", "z")).groupBy("pos").agg(F.avg("z").alias("m"))
    prior = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("prior"))
    out = B.against_prior(s.select("row_id", "z"), prior)
    return rounded(out.select("row_id", F.posexplode(M.softmax(F.col("z"))).alias("pos", "p")))


def across_orders(spark, d):
    out = B.across_orders(passes(spark, d))
    return rounded(out.select(F.col("question").alias("row_id"), F.explode(F.arrays_zip("options", "log_q")).alias("o")).select("row_id", F.col("o.options").alias("option"), F.col("o.log_q").alias("log_q")))


def _draws(spark):
    return spark.range(400).withColumnRenamed("id", "draw_id")


def with_replacement(spark, d):
    return B.with_replacement(table(spark, d, "documents").select("doc_id"), "doc_id", _draws(spark), "seed")


def domain_balanced(spark, d):
    return B.balanced(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", _draws(spark), "seed")


def domain_menus(spark, d):
    classes = table(spark, d, "nation").select(F.col("n_nationkey").alias("class_id"), F.col("n_regionkey").alias("domain"))
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("class_id"))
    out = B.domain_menus(rows, classes, F.lit(3), F.col("c_custkey"))
    return out.select("c_custkey", "domain", F.array_join("options", ",").alias("menu"), "gold_idx")


def class_split(spark, d):
    classes = table(spark, d, "nation").select(F.col("n_nationkey").alias("class_id"))
    return B.class_split(classes, 7, "seed")


def of_classes(spark, d):
    classes = table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("class_id"))
    return B.of_classes(table(spark, d, "customer").select("c_custkey", "c_nationkey"), classes, "c_nationkey")


def paired(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 2 + F.col("turn") % 2).alias("no"), "role", F.length("text").alias("n")).filter("n is not null")
    one = rows.groupBy("no").agg(F.max("role").alias("role"), F.max("n").alias("n"))
    whole = one.groupBy(F.floor(F.col("no") / 2).alias("c")).agg(F.count(F.lit(1)).alias("sides")).filter("sides = 2")
    one = one.join(whole, F.floor(F.col("no") / 2) == F.col("c"), "left_semi")
    return B.paired(one, "no").select("pair_no", F.col("a.n").alias("a"), F.col("b.n").alias("b"), (F.col("a.role") == F.col("b.role")).alias("same_role"))


def costs(spark, d):
    docs = table(spark, d, "documents").filter("n_chars is not null")
    trace = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 50)
    prefix, suffix, branches = F.col("n_chars"), F.col("doc_id") % 40 + 5, F.col("doc_id") % 7 + 2
    levels = B.score_levels(F.when(F.col("doc_id") % 2 == 0, "score").otherwise("choice"), F.array(F.lit(2), F.lit(0), F.lit(1)))
    return docs.select("doc_id", B.batch_cost(prefix, suffix, branches, 8, 2, trace).alias("cost"), B.batch_cost(prefix, suffix, branches, 128).alias("plain_cost"), B.branch_limit(prefix, suffix, F.lit(4000)).alias("limit"), F.array_join(levels, ",").alias("levels"))


def shared_prefix(spark, d):
    """Prefixes of six tokens; branches go on from one to seven of them."""
    docs = table(spark, d, "documents").select("doc_id")
    prefix = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: i.cast("bigint"))
    branch = lambda k: F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 7 + 1 + k).cast("int")), lambda i: F.when(i > F.col("doc_id") % (4 + k), -i.cast("bigint")).otherwise(i.cast("bigint")))
    out = B.shared_prefix(prefix, F.array(branch(0), branch(1), branch(3)))
    return docs.withColumn("s", out).select("doc_id", F.col("s.length").alias("length"), F.array_join(F.transform("s.suffixes", lambda x: F.array_join(x.cast("array<string>"), " ")), "|").alias("suffixes"))


_HEX = "CAST('0x' || substring(sha256({}), 1, 15) AS BIGINT)"
_SLOT = SCORED + ", slot AS (SELECT DISTINCT row_id, unnest([0, 1, 2]) AS no, unnest([row_id % 3, 3, 5]) AS s FROM z)"

TABLE = {
    "slot_gather": (slot_gather, SCORED + ", s AS (SELECT DISTINCT row_id, unnest([0, 1, 2, 3]) AS no, unnest([row_id % 10, -1, 3, 12]) AS s FROM z) SELECT s.row_id, s.no, round(z.z, 6) AS score FROM s LEFT JOIN z ON s.row_id = z.row_id AND s.s = z.pos"),
    "slot_log_probs": (slot_log_probs, _SLOT + ", x AS (SELECT z.row_id, z.pos, z.z, s.no FROM z LEFT JOIN slot s ON z.row_id = s.row_id AND z.pos = s.s), b AS (SELECT row_id, ln(sum(exp(z)) FILTER (no IS NOT NULL)) AS menu, ln(sum(exp(z)) FILTER (pos < 7)) AS codes, ln(sum(exp(z))) AS vocab FROM x GROUP BY row_id) SELECT x.row_id, x.no, round(z - menu, 6) AS menu, round(z - codes, 6) AS codes, round(z - vocab, 6) AS vocab FROM x JOIN b ON x.row_id = b.row_id WHERE no IS NOT NULL"),
    "slot_mass": (slot_mass, _SLOT + " SELECT p.row_id, round(sum(p) FILTER (s.no IS NOT NULL), 6) AS m_answer, round(sum(p) FILTER (p.pos < 7) - sum(p) FILTER (s.no IS NOT NULL), 6) AS m_offmenu, bool_or(rk = 1 AND s.no IS NOT NULL) AS top1_in FROM p LEFT JOIN slot s ON p.row_id = s.row_id AND p.pos = s.s GROUP BY p.row_id"),
    "token_scores": (token_scores, SCORED + ", t AS (SELECT row_id, pos, ln(p) AS l, row_id % 10 AS n FROM p WHERE pos <= row_id % 10) SELECT row_id, round(sum(l), 6) AS s_sum, round(coalesce(sum(l) FILTER (pos < n), 0), 6) AS s_sum_name, round(avg(l), 6) AS s_avg, round(avg(l) FILTER (pos < n), 6) AS s_avg_name FROM t GROUP BY row_id"),
    "rank_summary": (rank_summary, SCORED + ", w AS (SELECT row_id, gold, pos, floor(z) AS z FROM z), g AS (SELECT row_id, max(CASE WHEN pos = gold THEN z END) AS gz, max(z) AS mz FROM w GROUP BY row_id), r AS (SELECT w.row_id, count(*) FILTER (z > gz) AS rank, count(*) FILTER (z = mz) > 1 AS tie, min(CASE WHEN z = mz THEN pos END) AS pred FROM w JOIN g ON w.row_id = g.row_id GROUP BY w.row_id) SELECT CAST(median(rank) AS DOUBLE) AS gold_rank_median, count(*) FILTER (tie) AS n_ties_at_top, round((SELECT max(c) FROM (SELECT count(*) AS c FROM r GROUP BY pred)) / CAST(count(*) AS DOUBLE), 6) AS pred_max_class_frac FROM r"),
    "against_prior": (against_prior, SCORED + ", m AS (SELECT pos, avg(z) AS m FROM z GROUP BY pos), w AS (SELECT row_id, z.pos, exp(z - m) AS e FROM z JOIN m ON z.pos = m.pos) SELECT row_id, CAST(pos AS INT) AS pos, round(e / sum(e) OVER (PARTITION BY row_id), 6) AS p FROM w"),
    "across_orders": (across_orders, _PASS.replace("{n}", "3") + " SELECT row_id, CAST(pos AS INT) AS option, round(avg(ln(p)), 6) AS log_q FROM pp GROUP BY row_id, pos"),
    "with_replacement": (with_replacement, f"WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR))) - 1 AS no FROM documents), c AS (SELECT count(*) AS n FROM documents) SELECT draw_id, doc_id FROM (SELECT range AS draw_id, {_HEX.format(chr(39) + 'seed|' + chr(39) + ' || CAST(range AS VARCHAR)')} % n AS no FROM range(400), c) x JOIN n ON x.no = n.no"),
    "domain_balanced": (domain_balanced, f"WITH n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) - 1 AS no FROM documents WHERE lang IS NOT NULL), g AS (SELECT lang, count(*) AS c, row_number() OVER (ORDER BY lang) - 1 AS k, count(*) OVER () AS ks FROM documents WHERE lang IS NOT NULL GROUP BY lang), x AS (SELECT range AS draw_id, {_HEX.format(chr(39) + 'seed|domain|' + chr(39) + ' || CAST(range AS VARCHAR)')} AS a, {_HEX.format(chr(39) + 'seed|item|' + chr(39) + ' || CAST(range AS VARCHAR)')} AS b FROM range(400)) SELECT draw_id, n.lang, n.doc_id FROM x JOIN g ON x.a % ks = g.k JOIN n ON n.lang = g.lang AND n.no = x.b % c"),
    "domain_menus": (domain_menus, "WITH r AS (SELECT c_custkey, c_nationkey, n_regionkey AS domain FROM customer JOIN nation ON c_nationkey = n_nationkey), a AS (SELECT r.*, n_nationkey AS k, row_number() OVER (PARTITION BY c_custkey ORDER BY sha256(CAST(c_custkey AS VARCHAR) || '|pick|' || CAST(n_nationkey AS VARCHAR))) AS no FROM r JOIN nation ON n_regionkey = domain AND n_nationkey <> c_nationkey), m AS (SELECT c_custkey, domain, c_nationkey, k FROM a WHERE no <= 2 UNION ALL SELECT c_custkey, domain, c_nationkey, c_nationkey FROM r), s AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY sha256(CAST(c_custkey AS VARCHAR) || '|order|' || CAST(k AS VARCHAR))) - 1 AS i FROM m) SELECT c_custkey, domain, string_agg(CAST(k AS VARCHAR), ',' ORDER BY i) AS menu, CAST(max(CASE WHEN k = c_nationkey THEN i END) AS INT) AS gold_idx FROM s GROUP BY c_custkey, domain"),
    "class_split": (class_split, "SELECT n_nationkey AS class_id, row_number() OVER (ORDER BY sha256('seed|' || CAST(n_nationkey AS VARCHAR))) <= 7 AS held FROM nation"),
    "of_classes": (of_classes, "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    "paired": (paired, "WITH o AS (SELECT conv_id, turn % 2 AS s, max(role) AS role, max(length(text)) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2) SELECT a.conv_id AS pair_no, CAST(a.n AS INT) AS a, CAST(b.n AS INT) AS b, a.role = b.role AS same_role FROM o a JOIN o b ON a.conv_id = b.conv_id AND a.s = 0 AND b.s = 1"),
    "costs": (costs, "WITH t AS (SELECT doc_id, n_chars AS p, doc_id % 40 + 5 AS s, doc_id % 7 + 2 AS b, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 50 END AS t FROM documents WHERE n_chars IS NOT NULL), f AS (SELECT *, greatest(1, CAST(floor((4000 - p) / CAST(s AS DOUBLE)) AS BIGINT)) AS fits FROM t) SELECT doc_id, CAST(p + s + b * 8 + 2 * 9 + CASE WHEN t > 0 THEN t + s + b * 8 ELSE 0 END AS BIGINT) AS cost, CAST(p + s + b * 128 AS BIGINT) AS plain_cost, CAST(CASE WHEN p > 0 AND fits > 1 THEN least(fits, greatest(1, 4000 // p - 2)) ELSE fits END AS BIGINT) AS \"limit\", CASE WHEN doc_id % 2 = 0 THEN '2,0,1' END AS levels FROM f"),
    "shared_prefix": (shared_prefix, "WITH b AS (SELECT doc_id, unnest([0, 1, 2]) AS j, unnest([0, 1, 3]) AS k FROM documents), t AS (SELECT doc_id, j, doc_id % 7 + 1 + k AS n, least(doc_id % (4 + k), doc_id % 7 + 1 + k) AS own FROM b), l AS (SELECT doc_id, min(least(own, 6, n - 1)) AS length FROM t GROUP BY doc_id) SELECT t.doc_id, CAST(any_value(length) AS INT) AS length, string_agg(list_aggregate([CASE WHEN i <= own THEN i ELSE -i END FOR i IN range(length + 1, n + 1)], 'string_agg', ' '), '|' ORDER BY j) AS suffixes FROM t JOIN l ON t.doc_id = l.doc_id GROUP BY t.doc_id"),
}
