"""Queries of menu scoring and of its metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.functions import menus as M
from tallygrid.operators import metrics as E
from tallygrid.plans.base import BINARY, SCORED, binary, bins, features, passes, rounded, scored

_NLL = "-ln(greatest(pg, 1e-12))"
_RATE = "avg(CASE WHEN {} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
_ACC, _TOP5 = _RATE.format("grk <= 1"), _RATE.format("grk <= 5")


def _conf(source: str, conf: str, ok: str) -> str:
    return f"""round(avg({conf}), 6) AS conf_mean, round({_RATE.format(ok)} - avg({conf}), 6) AS accuracy_minus_confidence,
round(avg(CASE WHEN {ok} THEN {conf} END), 6) AS conf_correct_mean, round(avg(CASE WHEN NOT ({ok}) THEN {conf} END), 6) AS conf_wrong_mean"""


def menu_softmax(spark, d):
    s = scored(spark, d).select("row_id", F.posexplode("q").alias("pos", "p"))
    return rounded(s)


def topk(spark, d):
    f = features(spark, d)
    return rounded(f.agg(*[E.share(F.col("gold_rank") <= k).alias(f"top{k}") for k in (1, 2, 3, 5)]))


def nll(spark, d):
    return rounded(features(spark, d).agg(F.avg("nll_row").alias("nll")))


def saturated(spark, d):
    return features(spark, d).agg(F.count_if(F.col("p_gold") < M.EPSILON).alias("n_saturated"), F.count_if(F.col("p_gold") < 0.05).alias("n_below_5"))


def brier(spark, d):
    return rounded(features(spark, d).agg(F.avg("brier_row").alias("brier")))


def ece(spark, d):
    return rounded(E.ece(features(spark, d), F.col("conf"), F.col("correct")))


def confidence_summary(spark, d):
    return rounded(E.confidence_summary(features(spark, d)))


def choice_calibration(spark, d):
    return rounded(E.choice_calibration(features(spark, d)))


def summarize(spark, d):
    return rounded(E.summarize(features(spark, d)))


def by_gold_slot(spark, d):
    return rounded(E.by_gold_slot(features(spark, d), width=3))


def by_family(spark, d):
    return rounded(E.by_family(features(spark, d)))


def pass_by_family(spark, d):
    return rounded(E.pass_by_family(E.features(passes(spark, d))))


def first_two_slots(spark, d):
    return rounded(E.first_two_slots(features(spark, d)))


def menu_size(spark, d):
    return rounded(E.menu_size_summary(features(spark, d)))


def entropy(spark, d):
    return rounded(scored(spark, d).agg(F.avg(M.entropy(F.col("q"))).alias("nats"), F.avg(M.entropy(F.col("q"), "2")).alias("bits")))


def answer_confidence(spark, d):
    f = features(spark, d)
    return rounded(f.select("row_id", F.get("options", F.col("pred")).alias("choice"), M.confidence(F.col("q")).alias("confidence"), M.expectation(F.col("q")).alias("score")))


def auroc(spark, d):
    return rounded(E.auroc(binary(spark, d)))


def binary_summary(spark, d):
    return rounded(E.binary_summary(binary(spark, d)))


def noul_calibration(spark, d):
    return rounded(E.noul_calibration(binary(spark, d)))


def score_calibration(spark, d):
    return rounded(E.score_calibration(features(spark, d)).select("nrps", "interval90_coverage", "interval90_width", "ece"))


def calibration_summary(spark, d):
    """Question types by row number: every fourth row a yes/no question on options 0 and 1 would change the menus, so the type alone changes here."""
    s = scored(spark, d).withColumns({"qtype": F.when(F.col("row_id") % 2 == 0, "choice").otherwise("score"), "option_names": F.transform("options", lambda o: o.cast("string"))})
    parts = E.calibration_summary(s)
    out = parts["choice"].select(F.lit("choice").alias("qtype"), "conf_mean", "ece", "calibration_score", F.lit(None).cast("double").alias("nrps"))
    return rounded(out.unionByName(parts["score"].select(F.lit("score").alias("qtype"), "conf_mean", "ece", F.lit(None).cast("double").alias("calibration_score"), "nrps")))


def decoy_summary(spark, d):
    return rounded(E.decoy_summary(features(spark, d)))


def consistency_variant(spark, d):
    s = scored(spark, d)
    rows = F.filter(F.sequence(F.lit(0), F.size("options") - 1), lambda i: ((i + F.col("row_id")) % 2 == 0) | (i == F.col("gold")))
    s = s.withColumn("_rows", rows)
    pairs = s.select(F.col("options").alias("base_options"), F.col("q").alias("base_q"), M.taken(F.col("options"), F.col("_rows")).alias("var_options"), M.softmax(F.transform(M.taken(F.col("z"), F.col("_rows")), lambda x: x * 1.25)).alias("var_q"), "label")
    return rounded(E.consistency(pairs))


def pass_consistency_js(spark, d):
    return rounded(E.pass_consistency(passes(spark, d)))


def pairwise_agreement(spark, d):
    return rounded(E.pairwise_agreement(passes(spark, d)))


def percentile_mass(spark, d):
    f = features(spark, d)
    rows = f.select(M.total(F.slice("q", 1, 5)).alias("m_answer"), M.total(F.slice("q", 6, 250)).alias("m_offmenu"), (F.col("pred") < 5).alias("top1_in"))
    return rounded(E.answer_mass_summary(rows))


def position_mass(spark, d):
    return rounded(E.position_mass(scored(spark, d)))


def length_profile(spark, d):
    f = features(spark, d)
    lengths = spark.range(10).select(F.col("id").cast("int").alias("option"), F.length(F.expr("element_at(array('zero','one','two','three','four','five','six','seven','eight','nine'), cast(id as int) + 1)")).alias("length"))
    return rounded(E.length_profile(f, lengths))


def prior_calibration(spark, d):
    return rounded(E.summarize(E.features(E.prior_calibrated(scored(spark, d)))).select("n", "accuracy", "nll", "brier"))


def label_smoothing_ce(spark, d):
    s = scored(spark, d).withColumn("target", M.one_hot(F.size("options"), F.col("gold")))
    a, b = E.target_cross_entropy(s).withColumnRenamed("loss", "hard"), E.target_cross_entropy(s, 0.1).withColumnRenamed("loss", "smoothed")
    return rounded(a.join(b))


def contrast_margin(spark, d):
    s = scored(spark, d).select((F.floor(F.col("row_id") / 2)).alias("group_id"), "gold", "z")
    return rounded(E.contrast_margin(s, 1.0))


def ordinal_emd(spark, d):
    s = scored(spark, d).withColumns({"target": M.one_hot(F.size("options"), F.col("gold")), "qtype": F.when(F.col("row_id") % 3 == 0, "score").otherwise("choice")})
    return rounded(E.ordinal_emd(s))


def pair_js(spark, d):
    p = passes(spark, d, 2)
    a, b = (p.filter(F.col("pass") == k).select("question", F.col("options").alias(f"{n}_options"), F.col("q").alias(f"{n}_q")) for k, n in ((0, "a"), (1, "b")))
    return rounded(E.pair_js(a.join(b, "question")))


def menu_hits(spark, d):
    s = scored(spark, d)
    k = F.size("options")
    even = F.transform("options", lambda _: F.lit(1.0) / k)
    return E.menu_hits(s.withColumn("target", F.when(F.col("row_id") % 5 == 0, even).otherwise(M.one_hot(k, F.col("gold")))))


def branch_ce(spark, d):
    f = features(spark, d).select(F.explode(F.arrays_zip("options", "q")).alias("o"), "label")
    rows = f.select(F.ln(1 - F.col("o.q") * 0.99).alias("lp1"), F.ln(0.001 + F.col("o.q") * 0.99).alias("lp2"), (F.col("o.options") == F.col("label")).cast("int").alias("target"), F.lit(True).alias("valid"))
    return rounded(E.branch_ce(rows))


def fit_temperature(spark, d):
    """The grid's best point and its loss; the refinement is tested against brute force."""
    s = scored(spark, d)
    t = E.fit_temperature(s.select("z", "gold"))
    return spark.createDataFrame([(round(t, 2),)], "temperature double")


def restricted_softmax(spark, d):
    s = scored(spark, d)
    return rounded(s.select("row_id", F.posexplode(M.softmax(F.slice("z", 1, 4), 2.0)).alias("pos", "p")))


_PASS = SCORED.replace("\nf AS (", """
pz AS (SELECT z.row_id, z.gold, z.pos, g.pass, z.z * (1 + 0.25 * g.pass) AS z FROM z CROSS JOIN (SELECT unnest(range(0, {n})) AS pass) g),
pe AS (SELECT *, exp(z - max(z) OVER (PARTITION BY row_id, pass)) AS e FROM pz),
pp AS (SELECT *, row_number() OVER (PARTITION BY row_id, pass ORDER BY p DESC, pos) AS rk FROM (SELECT row_id, pass, gold, pos, e / sum(e) OVER (PARTITION BY row_id, pass) AS p FROM pe)),
pf AS (SELECT row_id, pass, any_value(gold) AS gold, max(p) AS conf, max(CASE WHEN rk = 1 THEN pos END) AS pred, max(CASE WHEN pos = gold THEN p END) AS pg, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS h,
  CASE WHEN row_id % 7 <> 0 THEN 'f' || CAST(row_id % 4 AS VARCHAR) END AS family, CASE WHEN row_id % 3 <> 0 THEN (any_value(gold) + 1) % 10 END AS decoy FROM pp GROUP BY row_id, pass),
f AS (""")
_DECOY = """count(*) FILTER (decoy IS NOT NULL) AS n_decoy, {r}(count(*) FILTER (pred = decoy) / CAST(nullif(count(*) FILTER (decoy IS NOT NULL), 0) AS DOUBLE){e} AS decoy_rate,
{r}(count(*) FILTER (pred = decoy) / CAST(nullif(count(*) FILTER (decoy IS NOT NULL AND pred <> gold), 0) AS DOUBLE){e} AS decoy_of_errors, {r}(avg(CASE WHEN decoy IS NOT NULL AND pred <> gold THEN 1.0::DOUBLE / 9 END){e} AS decoy_chance"""
_R6 = {"r": "round", "e": ", 6)"}
_RAW = {"r": "", "e": ")"}

TABLE = {
    "menu_softmax": (menu_softmax, SCORED + "SELECT row_id, pos, round(p, 6) AS p FROM p"),
    "topk_accuracy": (topk, SCORED + "SELECT " + ", ".join(f"round({_RATE.format(f'grk <= {k}')}, 6) AS top{k}" for k in (1, 2, 3, 5)) + " FROM f"),
    "nll": (nll, SCORED + f"SELECT round(avg({_NLL}), 6) AS nll FROM f"),
    "saturated": (saturated, SCORED + "SELECT count(*) FILTER (pg < 1e-12) AS n_saturated, count(*) FILTER (pg < 0.05::DOUBLE) AS n_below_5 FROM f"),
    "brier": (brier, SCORED + "SELECT round(avg(brier), 6) AS brier FROM f"),
    "ece": (ece, SCORED + f"SELECT round({bins('f', 'conf', 'ok')}, 6) AS ece"),
    "confidence_summary": (confidence_summary, SCORED + f"SELECT {_conf('f', 'conf', 'ok')} FROM f"),
    "choice_calibration": (choice_calibration, SCORED + f"SELECT {_conf('f', 'conf', 'ok')}, round(any_value(x.ece), 6) AS ece, round(greatest(0, least(100, 100 * (1 - 2 * any_value(x.ece)))), 6) AS calibration_score FROM f, (SELECT {bins('f', 'conf', 'ok')} AS ece) x"),
    "summarize": (summarize, SCORED + f"SELECT count(*) AS n, round({_ACC}, 6) AS accuracy, round({_TOP5}, 6) AS top5_accuracy, round(avg({_NLL}), 6) AS nll, count(*) FILTER (pg < 1e-12) AS n_saturated, round(avg(brier), 6) AS brier, round(avg(conf), 6) AS conf_mean, round({bins('f', 'conf', 'ok')}, 6) AS ece FROM f"),
    "by_gold_slot": (by_gold_slot, SCORED + f"SELECT count(*) AS n, round({_ACC}, 6) AS accuracy, round({_TOP5}, 6) AS top5_accuracy, round(avg({_NLL}), 6) AS nll, round(avg(conf), 6) AS conf_mean, CAST(gold // 3 * 3 AS VARCHAR) || '-' || CAST(gold // 3 * 3 + 2 AS VARCHAR) AS slots FROM f GROUP BY gold // 3"),
    "by_family": (by_family, SCORED + f"SELECT family, min(row_id) AS first_row, count(*) AS n, round({_RATE.format('ok')}, 6) AS accuracy, round(avg({_NLL}), 6) AS nll, round(avg(conf), 6) AS conf_mean, {_DECOY.format(**_R6)} FROM f WHERE family IS NOT NULL GROUP BY family"),
    "pass_by_family": (pass_by_family, _PASS.format(n=3) + f", t AS (SELECT family, pass, count(*) AS n, {_RATE.format('pred = gold')} AS accuracy, avg({_NLL}) AS nll, avg(conf) AS conf_mean, {_DECOY.format(**_RAW)} FROM pf WHERE family IS NOT NULL GROUP BY family, pass) SELECT family, max(CASE WHEN pass = 0 THEN n END) AS n, max(CASE WHEN pass = 0 THEN n_decoy END) AS n_decoy, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("accuracy", "nll", "conf_mean", "decoy_rate", "decoy_of_errors", "decoy_chance")) + " FROM t GROUP BY family"),
    "first_two_slots": (first_two_slots, SCORED + f"SELECT round({_RATE.format('pred < 2')}, 6) AS pred_d01_rate, round({_RATE.format('gold < 2')}, 6) AS gold_d01_rate, round(avg(m), 6) AS q_d01_mean FROM f JOIN (SELECT row_id, sum(p) AS m FROM p WHERE pos < 2 GROUP BY row_id) m ON f.row_id = m.row_id"),
    "menu_size": (menu_size, SCORED + "SELECT CAST(min(k) AS INT) AS k_min, CAST(max(k) AS INT) AS k_max, round(avg(k), 6) AS k_mean FROM f"),
    "entropy": (entropy, SCORED + "SELECT round(avg(h), 6) AS nats, round(avg(b), 6) AS bits FROM (SELECT -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS h, -sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) AS b FROM p GROUP BY row_id)"),
    "answer_confidence": (answer_confidence, SCORED + "SELECT f.row_id, pred AS choice, round(greatest(0, least(1, (k * conf - 1) / (k - 1))), 6) AS confidence, round(s, 6) AS score FROM f JOIN (SELECT row_id, sum(p * pos) AS s FROM p GROUP BY row_id) x ON f.row_id = x.row_id"),
    "auroc": (auroc, BINARY + "SELECT round((sum(CASE WHEN y = 1 THEN r END) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auroc FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM b)"),
    "binary_summary": (binary_summary, BINARY + f"SELECT round(avg(p), 6) AS p_pos_mean, round({_RATE.format('p >= 0.5')}, 6) AS pos_rate, round(avg(y), 6) AS label_pos_rate, round(avg(power(p - y, 2)), 6) AS brier_binary, round((sum(CASE WHEN y = 1 THEN r END) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auroc FROM (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM b)"),
    "noul_calibration": (noul_calibration, BINARY + f""", n AS (SELECT *, greatest(p, 1 - p) AS conf, (p >= 0.5) = (y = 1) AS ok, p >= 0.8::DOUBLE OR p <= 0.2::DOUBLE AS dec FROM b), x AS (SELECT {bins('n', 'conf', 'ok')} AS ece, (SELECT count(*) FILTER (ok AND dec) / CAST(count(*) AS DOUBLE) FROM n) AS acc)
SELECT {_conf('n', 'conf', 'ok')}, round({_RATE.format('dec')}, 6) AS decisive_rate, round(count(*) FILTER (ok AND dec) / CAST(count(*) FILTER (dec) AS DOUBLE), 6) AS decisive_accuracy, round(any_value(acc), 6) AS accuracy_with_abstentions_wrong, round(avg(power(p - y, 2)), 6) AS brier,
round(any_value(x.ece), 6) AS ece, round(100 * greatest(0, least(1, (any_value(acc) - 0.5) / 0.5)), 6) AS competence, round(100 * (1 - 2 * any_value(x.ece)), 6) AS calibration_score FROM n, x"""),
    "score_calibration": (score_calibration, SCORED + f""", u AS (SELECT *, sum(p) OVER (PARTITION BY row_id ORDER BY pos) AS cdf FROM p),
o AS (SELECT row_id, any_value(gold) AS gold, sum(CASE WHEN pos < 9 THEN power(cdf - CASE WHEN pos >= gold THEN 1 ELSE 0 END, 2) ELSE 0 END) / 9 AS nrps, coalesce(min(CASE WHEN cdf >= 0.05::DOUBLE THEN pos END), 9) AS lo, coalesce(min(CASE WHEN cdf >= 0.95::DOUBLE THEN pos END), 9) AS hi FROM u GROUP BY row_id)
SELECT round(avg(nrps), 6) AS nrps, round({_RATE.format('lo <= gold AND gold <= hi')}, 6) AS interval90_coverage, round(avg((hi - lo) / 9.0::DOUBLE), 6) AS interval90_width, round({bins('f', 'conf', 'ok')}, 6) AS ece FROM o"""),
    "calibration_summary": (calibration_summary, SCORED + f""", fc AS (SELECT * FROM f WHERE row_id % 2 = 0), fs AS (SELECT * FROM f WHERE row_id % 2 <> 0), u AS (SELECT *, sum(p) OVER (PARTITION BY row_id ORDER BY pos) AS cdf FROM p WHERE row_id % 2 <> 0),
o AS (SELECT row_id, sum(CASE WHEN pos < 9 THEN power(cdf - CASE WHEN pos >= gold THEN 1 ELSE 0 END, 2) ELSE 0 END) / 9 AS nrps FROM u GROUP BY row_id)
SELECT 'choice' AS qtype, round(avg(conf), 6) AS conf_mean, round({bins('fc', 'conf', 'ok')}, 6) AS ece, round(greatest(0, least(100, 100 * (1 - 2 * {bins('fc', 'conf', 'ok')}))), 6) AS calibration_score, CAST(NULL AS DOUBLE) AS nrps FROM fc
UNION ALL SELECT 'score', round(avg(conf), 6), round({bins('fs', 'conf', 'ok')}, 6), NULL, (SELECT round(avg(nrps), 6) FROM o) FROM fs"""),
    "decoy_summary": (decoy_summary, SCORED + f"SELECT {_DECOY.format(**_R6)} FROM f"),
    "consistency_variant": (consistency_variant, SCORED + """, v AS (SELECT p.*, sum(p) OVER (PARTITION BY row_id) AS s, exp(z * 1.25 - max(z * 1.25) OVER (PARTITION BY row_id)) AS ve FROM p WHERE (pos + row_id) % 2 = 0 OR pos = gold),
w AS (SELECT row_id, gold, pos, rk, p / s AS r, ve / sum(ve) OVER (PARTITION BY row_id) AS vp FROM v), x AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY vp DESC, pos) AS vk FROM w),
y AS (SELECT row_id, bool_or(rk = 1) AS cmp, bool_or(rk = 1 AND vk = 1) AS same, sum(abs(vp - r)) / 2 AS tv, abs(ln(greatest(max(CASE WHEN pos = gold THEN vp END), 1e-12)) - ln(greatest(max(CASE WHEN pos = gold THEN r END), 1e-12))) AS dr FROM x GROUP BY row_id)
SELECT count(*) AS n, count(*) FILTER (cmp) AS n_comparable, round(count(*) FILTER (cmp AND NOT same) / CAST(count(*) FILTER (cmp) AS DOUBLE), 6) AS flip_rate, round(avg(tv), 6) AS tv_mean, round(avg(dr), 6) AS gold_logp_drift FROM y"""),
    "pass_consistency_js": (pass_consistency_js, _PASS.format(n=3) + f""", m AS (SELECT row_id, -sum(CASE WHEN mp > 0 THEN mp * ln(mp) ELSE 0 END) AS hm FROM (SELECT row_id, pos, avg(p) AS mp FROM pp GROUP BY row_id, pos) GROUP BY row_id),
q AS (SELECT row_id, count(*) AS np, sum(CASE WHEN pred = gold THEN 1 ELSE 0 END) AS hits, min(pred) = max(pred) AS agree, avg(h) AS h FROM pf GROUP BY row_id)
SELECT count(*) AS n, max(np) AS passes, round(sum(hits) / CAST(sum(np) AS DOUBLE), 6) AS accuracy, round({_RATE.format('agree')}, 6) AS agree, round(avg(hm - h), 6) AS js FROM q JOIN m ON q.row_id = m.row_id"""),
    "pairwise_agreement": (pairwise_agreement, _PASS.format(n=3) + f", t AS (SELECT a.row_id, a.pass AS pa, b.pass AS pb, sum(abs(a.p - b.p)) / 2 AS tv, max(CASE WHEN a.rk = 1 THEN a.pos END) = max(CASE WHEN b.rk = 1 THEN b.pos END) AS same FROM pp a JOIN pp b ON a.row_id = b.row_id AND a.pos = b.pos AND a.pass < b.pass GROUP BY a.row_id, a.pass, b.pass) SELECT round({_RATE.format('same')}, 6) AS agreement, round(avg(tv), 6) AS tv FROM t"),
    "percentile_mass": (percentile_mass, SCORED + f", m AS (SELECT p.row_id, sum(CASE WHEN pos < 5 THEN p ELSE 0 END) AS a, sum(CASE WHEN pos >= 5 THEN p ELSE 0 END) AS o, any_value(f.pred) < 5 AS t FROM p JOIN f ON p.row_id = f.row_id GROUP BY p.row_id) SELECT round(avg(a), 6) AS m_answer_mean, round(quantile_cont(a, 0.05), 6) AS m_answer_p05, round(quantile_cont(a, 0.95), 6) AS m_answer_p95, round(avg(o), 6) AS m_offmenu_mean, round({_RATE.format('t')}, 6) AS top1_in_menu_rate FROM m"),
    "position_mass": (position_mass, SCORED + "SELECT pos, round(avg(p), 6) AS mass FROM p GROUP BY pos"),
    "length_profile": (length_profile, SCORED + """, l AS (SELECT unnest(range(0, 10)) AS pos, length(unnest(['zero','one','two','three','four','five','six','seven','eight','nine'])) AS length), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM f)
SELECT CAST(length AS INT) AS length, count(*) AS classes, round(sum(coalesce(g, 0)) / any_value(n.n), 6) AS label_share, round(sum(m) / any_value(n.n), 6) AS mass_share, round(sum(coalesce(r, 0)) / any_value(n.n), 6) AS pred_share FROM l CROSS JOIN n
LEFT JOIN (SELECT pos, sum(p) AS m FROM p GROUP BY pos) a ON l.pos = a.pos LEFT JOIN (SELECT gold, count(*) AS g FROM f GROUP BY gold) b ON l.pos = b.gold LEFT JOIN (SELECT pred, count(*) AS r FROM f GROUP BY pred) c ON l.pos = c.pred GROUP BY length"""),
    "prior_calibration": (prior_calibration, SCORED + f""", pr AS (SELECT pos, avg(p) AS m FROM p GROUP BY pos), w AS (SELECT row_id, gold, p.pos, p / m AS u FROM p JOIN pr ON p.pos = pr.pos), x AS (SELECT row_id, gold, pos, u / sum(u) OVER (PARTITION BY row_id) AS p FROM w),
y AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, pos) AS rk FROM x), g AS (SELECT row_id, max(CASE WHEN pos = gold THEN rk END) AS grk, max(CASE WHEN pos = gold THEN p END) AS pg, sum(power(p - CASE WHEN pos = gold THEN 1 ELSE 0 END, 2)) AS brier FROM y GROUP BY row_id)
SELECT count(*) AS n, round({_ACC}, 6) AS accuracy, round(avg({_NLL}), 6) AS nll, round(avg(brier), 6) AS brier FROM g"""),
    "label_smoothing_ce": (label_smoothing_ce, SCORED + "SELECT round(avg(a), 6) AS hard, round(avg(b), 6) AS smoothed FROM (SELECT -sum(CASE WHEN pos = gold THEN ln(p) ELSE 0 END) AS a, -sum((0.9 * CASE WHEN pos = gold THEN 1 ELSE 0 END + 0.01) * ln(p)) AS b FROM p GROUP BY row_id)"),
    "contrast_margin": (contrast_margin, SCORED + """, g AS (SELECT row_id // 2 AS g, min(gold) AS a, max(gold) AS b FROM f GROUP BY row_id // 2 HAVING count(DISTINCT gold) = 2),
t AS (SELECT g.g, z.row_id, any_value(z.gold) = any_value(g.b) AS isb, sum(CASE WHEN z.pos = g.b THEN z.z WHEN z.pos = g.a THEN -z.z ELSE 0 END) AS d FROM z JOIN g ON z.row_id // 2 = g.g GROUP BY g.g, z.row_id),
u AS (SELECT g, 1 - (avg(CASE WHEN isb THEN d END) - avg(CASE WHEN NOT isb THEN d END)) AS x FROM t GROUP BY g) SELECT count(*) AS groups, round(avg(greatest(x, 0) + ln(1 + exp(-abs(x)))), 6) AS loss FROM u"""),
    "ordinal_emd": (ordinal_emd, SCORED + ", u AS (SELECT *, sum(p) OVER (PARTITION BY row_id ORDER BY pos) AS cdf FROM p), o AS (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN sum(CASE WHEN pos < 9 THEN power(cdf - CASE WHEN pos >= gold THEN 1 ELSE 0 END, 2) ELSE 0 END) ELSE 0 END AS e FROM u GROUP BY row_id) SELECT round(sum(e) / count(*), 6) AS loss, round(sum(e) / count(*) FILTER (row_id % 3 = 0), 6) AS per_score_row FROM o"),
    "pair_js": (pair_js, _PASS.format(n=2) + ", t AS (SELECT a.row_id, sum(-(a.p + b.p) / 2 * ln((a.p + b.p) / 2) + (a.p * ln(a.p) + b.p * ln(b.p)) / 2) AS js FROM pp a JOIN pp b ON a.row_id = b.row_id AND a.pos = b.pos AND a.pass = 0 AND b.pass = 1 GROUP BY a.row_id) SELECT round(avg(js), 6) AS js FROM t"),
    "menu_hits": (menu_hits, SCORED + "SELECT count(*) FILTER (row_id % 5 <> 0) AS questions, count(*) FILTER (row_id % 5 <> 0 AND ok) AS hits FROM f"),
    "branch_ce": (branch_ce, SCORED + ", t AS (SELECT avg(CASE WHEN pos = gold THEN -ln(0.001 + p * 0.99) END) AS pos, avg(CASE WHEN pos <> gold THEN -ln(1 - p * 0.99) END) AS neg FROM p) SELECT round(pos, 6) AS pos, round(neg, 6) AS neg, round((pos + neg) / 2, 6) AS loss FROM t"),
    "restricted_softmax": (restricted_softmax, SCORED + "SELECT row_id, pos, round(e / sum(e) OVER (PARTITION BY row_id), 6) AS p FROM (SELECT row_id, pos, exp((z - max(z) OVER (PARTITION BY row_id)) / 2) AS e FROM z WHERE pos < 4)"),
    "fit_temperature": (fit_temperature, None),
}
