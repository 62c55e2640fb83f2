"""Queries of whole evaluations: every metric family of a set from one scan.

The questions of embeddings, every third one as it is (choice), as levels (score), or made a yes/no question (is the class below five?), with an answer mass of the first five options.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.functions import menus as M
from tallygrid.operators import evaluation as V
from tallygrid.plans.base import BINARY, SCORED, binary, bins, passes, rounded, scored


def _mixed(s):
    low, high, kind = M.total(F.slice("q", 1, 5)), M.total(F.slice("q", 6, 250)), F.col("row_id") % 3
    known = F.col("row_id") % 11 != 0  # some questions come without readings of the vocabulary
    s = s.withColumns({
        "qtype": F.when(kind == 0, "choice").when(kind == 1, "score").otherwise("bool"),
        "m_answer": F.when(known, low), "m_offmenu": F.when(known, high), "top1_in": F.when(known, M.top(F.col("q")) < 5),
        "vocab_ce": F.when(known, -F.ln(F.greatest(F.get("q", F.col("gold")) * low, F.lit(M.EPSILON)))),
    })
    two, below = kind == 2, F.col("label") < 5
    swapped = {
        "_q": F.when(two, F.array(low, high)).otherwise(F.col("q")), "_options": F.when(two, F.array(F.lit(1), F.lit(0))).otherwise(F.col("options")), "option_names": F.when(two, F.array(F.lit(" Yes : below five"), F.lit("no"))),
        "_gold": F.when(two, F.when(below, 0).otherwise(1)).otherwise(F.col("gold")), "_label": F.when(two, below.cast("int")).otherwise(F.col("label")), "_decoy": F.when(~two, F.col("decoy")),
    }
    names = ["q", "options", "gold", "label", "decoy"]
    return s.withColumns(swapped).drop(*names, "z").withColumnsRenamed({f"_{c}": c for c in names})


def evaluate(spark, d):
    return rounded(V.evaluate(_mixed(scored(spark, d)), slots=3))


def evaluate_binary(spark, d):
    rows = binary(spark, d).select(F.col("doc_id").alias("row_id"), F.array(1 - F.col("p"), F.col("p")).alias("q"), F.array(F.lit(0), F.lit(1)).alias("options"), F.lit(None).cast("array<string>").alias("option_names"), F.col("y").cast("int").alias("gold"), F.col("y").cast("int").alias("label"), F.lit("bool").alias("qtype"), F.col("lang").alias("family"))
    none = F.lit(None).cast("double")
    rows = rows.withColumns({"decoy": F.lit(None).cast("int"), "vocab_ce": none, "m_answer": none, "m_offmenu": none, "top1_in": F.lit(None).cast("boolean")})
    return rounded(V.evaluate(rows, pos_class=1))


def consistency_evaluate(spark, d):
    # levels have no order to shuffle into, so every question here is a choice
    s = passes(spark, d).withColumns({"qtype": F.lit("choice"), "option_names": F.lit(None).cast("array<string>"), **{c: F.lit(None).cast("double") for c in ("vocab_ce", "m_answer", "m_offmenu")}, "top1_in": F.lit(None).cast("boolean")})
    return rounded(V.consistency_evaluate(s))


def _long(prefix: str, values: dict[str, str], source: str, by: str = "") -> str:
    names, numbers = ", ".join(f"'{n}'" for n in values), ", ".join(f"CAST({v} AS DOUBLE)" for v in values.values())
    return f"SELECT pre || n AS name, v AS value FROM (SELECT pre, unnest(ns) AS n, unnest(vs) AS v FROM (SELECT {prefix} AS pre, [{names}] AS ns, [{numbers}] AS vs FROM {source}{f' GROUP BY {by}' if by else ''}))"


def _all(with_: str, parts: list[str]) -> str:
    return f"{with_} SELECT name, round(value, 6) AS value FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL"


_R = lambda c: f"avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
_NLL = "avg(-ln(greatest(pg, 1e-12)))"
_DECOY = {
    "n_decoy": "count(*) FILTER (decoy IS NOT NULL)", "decoy_rate": "count(*) FILTER (pred = decoy) / CAST(nullif(count(*) FILTER (decoy IS NOT NULL), 0) AS DOUBLE)",
    "decoy_of_errors": "count(*) FILTER (pred = decoy) / CAST(nullif(count(*) FILTER (decoy IS NOT NULL AND NOT ok), 0) AS DOUBLE)", "decoy_chance": "avg(CASE WHEN decoy IS NOT NULL AND NOT ok THEN 1.0::DOUBLE / (k - 1) END)",
}
_SLOT = {"n": "count(*)", "accuracy": _R("grk <= 1"), "top5_accuracy": _R("grk <= 5"), "nll": _NLL, "conf_mean": "avg(conf)"}
_FAMILY = {"n": "count(*)", "accuracy": _R("ok"), "nll": _NLL, "conf_mean": "avg(conf)", **_DECOY}


def _conf(conf: str, ok: str) -> dict[str, str]:
    return {"conf_mean": f"avg({conf})", "accuracy_minus_confidence": f"{_R(ok)} - avg({conf})", "conf_correct_mean": f"avg(CASE WHEN {ok} THEN {conf} END)", "conf_wrong_mean": f"avg(CASE WHEN NOT {ok} THEN {conf} END)"}


_TYPE = {
    "choice": {"calibration_score": "greatest(0, least(100, 100 * (1 - 2 * any_value(ece))))"},
    "bool": {
        "calibration_score": "100 * (1 - 2 * any_value(ece))", "decisive_rate": _R("dec"), "decisive_accuracy": "count(*) FILTER (dec AND tok) / CAST(nullif(count(*) FILTER (dec), 0) AS DOUBLE)",
        "accuracy_with_abstentions_wrong": "count(*) FILTER (dec AND tok) / CAST(count(*) AS DOUBLE)", "brier": "avg(power(py - y, 2))", "competence": "100 * greatest(0, least(1, (count(*) FILTER (dec AND tok) / CAST(count(*) AS DOUBLE) - 0.5) / 0.5))",
    },
    "score": {"nrps": "avg(nrps)", "interval90_coverage": _R("lo <= gold AND gold <= hi"), "interval90_width": "avg((hi - lo) / 9.0::DOUBLE)"},
}


def _types(source: str, kinds: list[str]) -> list[str]:
    out = []
    for kind in kinds:
        rows = f"(SELECT *, (SELECT {bins(f'(SELECT * FROM {source} WHERE qtype = {kind!r})', 'tconf', 'tok')}) AS ece FROM {source} WHERE qtype = '{kind}')"
        out.append(_long(f"'calib/{'noul' if kind == 'bool' else kind}/'", _conf("tconf", "tok") | {"ece": "any_value(ece)"} | _TYPE[kind], rows, "qtype"))
    return out


_SET = {
    "n": "count(*)", "accuracy": _R("grk <= 1"), "top5_accuracy": _R("grk <= 5"), "nll": _NLL, "n_saturated": "count(*) FILTER (pg < 1e-12)", "brier": "avg(brier)", "conf_mean": "avg(conf)", "k_min": "min(k)", "k_max": "max(k)", "k_mean": "avg(k)",
    "pred_d01_rate": _R("pred < 2"), "gold_d01_rate": _R("gold < 2"), "q_d01_mean": "avg(q2)",
}
_MASS = {"vocab_ce": "avg(ce)", "m_answer_mean": "avg(a)", "m_offmenu_mean": "avg(o)", "top1_in_menu_rate": "avg(CASE WHEN a IS NOT NULL THEN CASE WHEN t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END)", "m_answer_p05": "quantile_cont(a, 0.05)", "m_answer_p95": "quantile_cont(a, 0.95)"}
_MIXED = (
    SCORED
    + """, m AS (SELECT row_id, sum(CASE WHEN pos < 5 THEN p ELSE 0 END) AS lo5, sum(CASE WHEN pos >= 5 THEN p ELSE 0 END) AS hi5, sum(CASE WHEN pos < 2 THEN p ELSE 0 END) AS two FROM p GROUP BY row_id),
u AS (SELECT *, sum(p) OVER (PARTITION BY row_id ORDER BY pos) AS cdf FROM p),
l AS (SELECT row_id, sum(CASE WHEN pos < 9 THEN power(cdf - CASE WHEN pos >= gold THEN 1 ELSE 0 END, 2) ELSE 0 END) / 9 AS nrps, coalesce(min(CASE WHEN cdf >= 0.05::DOUBLE THEN pos END), 9) AS lo, coalesce(min(CASE WHEN cdf >= 0.95::DOUBLE THEN pos END), 9) AS hi FROM u GROUP BY row_id),
w AS (SELECT f.*, m.lo5, m.hi5, m.two, l.nrps, l.lo, l.hi, f.gold < 5 AS yes FROM f JOIN m ON f.row_id = m.row_id JOIN l ON f.row_id = l.row_id),
x0 AS (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 'choice' ELSE 'score' END AS qtype, k, conf, pred, ok, pg, grk, brier, gold, family, decoy, two AS q2, CAST(NULL AS DOUBLE) AS py, CAST(NULL AS INT) AS y, nrps, lo, hi, lo5, hi5, pred AS pred0, pg AS pg0 FROM w WHERE row_id % 3 <> 2
UNION ALL SELECT row_id, 'bool', 2, greatest(lo5, hi5), CASE WHEN lo5 >= hi5 THEN 0 ELSE 1 END, (lo5 >= hi5) = yes, CASE WHEN yes THEN lo5 ELSE hi5 END, CASE WHEN (lo5 >= hi5) = yes THEN 1 ELSE 2 END, 2 * power(CASE WHEN yes THEN hi5 ELSE lo5 END, 2), CASE WHEN yes THEN 0 ELSE 1 END, family, NULL, lo5 + hi5,
lo5, CASE WHEN yes THEN 1 ELSE 0 END, NULL, NULL, NULL, lo5, hi5, pred, pg FROM w WHERE row_id % 3 = 2),
x AS (SELECT *, CASE WHEN qtype = 'bool' THEN greatest(py, 1 - py) ELSE conf END AS tconf, CASE WHEN qtype = 'bool' THEN (py >= 0.5) = (y = 1) ELSE ok END AS tok, py >= 0.8::DOUBLE OR py <= 0.2::DOUBLE AS dec,
CASE WHEN row_id % 11 <> 0 THEN lo5 END AS a, CASE WHEN row_id % 11 <> 0 THEN hi5 END AS o, pred0 < 5 AS t, CASE WHEN row_id % 11 <> 0 THEN -ln(greatest(pg0 * lo5, 1e-12)) END AS ce FROM x0)"""
)
_EVALUATE = _all(_MIXED, [
    _long("''", _SET | _MASS | _DECOY | {"ece": bins("x", "conf", "ok")}, "x"),
    _long("'by_gold_slot/' || CAST(gold // 3 * 3 AS VARCHAR) || '-' || CAST(gold // 3 * 3 + 2 AS VARCHAR) || '/'", _SLOT, "x", "gold // 3"),
    _long("'by_family/' || family || '/'", _FAMILY, "(SELECT * FROM x WHERE family IS NOT NULL)", "family"),
    _long("'calib/'", _conf("conf", "ok"), "x"),
    *_types("x", ["choice", "bool", "score"]),
])
_PAIRS = BINARY + """, x AS (SELECT doc_id AS row_id, 'bool' AS qtype, 2 AS k, greatest(1 - p, p) AS conf, CASE WHEN 1 - p >= p THEN 0 ELSE 1 END AS pred, CASE WHEN 1 - p >= p THEN 0 ELSE 1 END = y AS ok, CASE WHEN y = 1 THEN p ELSE 1 - p END AS pg, y AS gold, lang AS family, CAST(NULL AS INT) AS decoy,
CASE WHEN CASE WHEN 1 - p >= p THEN 0 ELSE 1 END = y THEN 1 ELSE 2 END AS grk, power(1 - p - (1 - y), 2) + power(p - y, 2) AS brier, 1 - p + p AS q2, p AS py, y, greatest(p, 1 - p) AS tconf, (p >= 0.5) = (y = 1) AS tok, p >= 0.8::DOUBLE OR p <= 0.2::DOUBLE AS dec FROM b),
r AS (SELECT y, rank() OVER (ORDER BY py) + (count(*) OVER (PARTITION BY py) - 1) / 2.0::DOUBLE AS r FROM x)"""
_BINARY = _all(_PAIRS, [
    _long("''", _SET | {"p_pos_mean": "avg(py)", "pos_rate": _R("py >= 0.5"), "label_pos_rate": "avg(y)", "brier_binary": "avg(power(py - y, 2))", "ece": bins("x", "conf", "ok")}, "x"),
    _long("''", {"auroc": "(sum(CASE WHEN y = 1 THEN r END) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))"}, "r"),
    _long("'by_gold_slot/0-9/'", _SLOT, "x"),
    _long("'by_family/' || family || '/'", _FAMILY, "(SELECT * FROM x WHERE family IS NOT NULL)", "family"),
    _long("'calib/'", _conf("conf", "ok"), "x"),
    *_types("x", ["bool"]),
])


def _runs() -> str:
    from tallygrid.plans.scoring import _PASS

    mean = {c: f"avg({c})" for c in ("accuracy", "nll", "conf_mean", "decoy_rate", "decoy_of_errors", "decoy_chance")}
    first = {c: f"max(CASE WHEN pass = 0 THEN {c} END)" for c in ("n", "n_decoy")}
    per = lambda by: f"SELECT pass, {by} AS g, " + ", ".join(f"{v} AS {n}" for n, v in _FAMILY.items()) + f" FROM y GROUP BY pass, {by}"
    return _all(
        _PASS.format(n=3)
        + f""", y AS (SELECT *, 10 AS k, 'choice' AS qtype, conf AS tconf, pred = gold AS tok, pred = gold AS ok FROM pf),
jm AS (SELECT row_id, -sum(CASE WHEN mp > 0 THEN mp * ln(mp) ELSE 0 END) AS hm FROM (SELECT row_id, pos, avg(p) AS mp FROM pp GROUP BY row_id, pos) GROUP BY row_id),
jq AS (SELECT row_id, count(*) AS np, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS hits, min(pred) = max(pred) AS agree, avg(h) AS h FROM y GROUP BY row_id),
fam AS ({per('family')}), whole AS ({per("''")})""",
        [
            _long("''", {"n": "count(*)", "passes": "max(np)", "accuracy": "sum(hits) / CAST(sum(np) AS DOUBLE)", "agree": _R("agree"), "js": "avg(hm - h)"}, "jq JOIN jm ON jq.row_id = jm.row_id"),
            _long("'by_family/' || g || '/'", first | mean, "(SELECT * FROM fam WHERE g IS NOT NULL)", "g"),
            _long("''", {"n_decoy": first["n_decoy"]} | {c: mean[c] for c in ("decoy_rate", "decoy_of_errors", "decoy_chance")}, "whole"),
            _long("'calib/'", _conf("conf", "ok"), "y"),
            *_types("y", ["choice"]),
        ],
    )


TABLE = {"evaluate": (evaluate, _EVALUATE), "evaluate_binary": (evaluate_binary, _BINARY), "consistency_evaluate": (consistency_evaluate, _runs())}
