import math
import re

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import evaluation as V
from tallygrid.operators import metrics as E

SCHEMA = "row_id long, q array<double>, gold int, options array<int>, label int, qtype string, option_names array<string>, family string, decoy int, vocab_ce double, m_answer double, m_offmenu double, top1_in boolean"
ROWS = [
    (1, [0.7, 0.2, 0.1], 0, [5, 6, 7], 5, "choice", None, "a", 6, 0.5, 0.9, 0.1, True),
    (2, [0.2, 0.5, 0.3], 0, [5, 6, 7], 5, "choice", None, "a", 6, 1.5, 0.7, 0.3, False),
    (3, [0.4, 0.6], 1, [1, 0], 0, "bool", ["Yes: it is", "no"], "b", None, None, None, None, None),
    (4, [0.9, 0.1], 0, [1, 0], 1, "bool", ["yes", "no"], None, None, 0.1, 0.8, 0.2, True),
    (5, [0.1, 0.6, 0.3], 1, [2, 0, 1], 0, "score", None, "b", 2, 0.3, 0.95, 0.05, True),
]


def record(df):
    got = df.collect()
    assert len({r.name for r in got}) == len(got)
    return {r.name: r.value for r in got}


def close(got, want):
    return all(math.isclose(got[k], v, abs_tol=1e-12) for k, v in want.items())


def test_record(spark):
    got = record(V.evaluate(spark.createDataFrame(ROWS, SCHEMA).repartition(3)))
    # five questions, of which the second goes to its decoy
    assert close(got, {"n": 5, "accuracy": 0.8, "top5_accuracy": 1, "nll": -sum(map(math.log, (0.7, 0.2, 0.6, 0.9, 0.6))) / 5, "k_min": 2, "k_max": 3, "k_mean": 2.6, "n_saturated": 0, "conf_mean": 0.66})
    assert close(got, {"vocab_ce": 0.6, "m_answer_mean": 0.8375, "top1_in_menu_rate": 0.75, "m_answer_p05": 0.7 + 0.15 * 0.1, "m_answer_p95": 0.9 + 0.85 * 0.05})
    assert close(got, {"n_decoy": 3, "decoy_rate": 1 / 3, "decoy_of_errors": 1, "decoy_chance": 0.5, "by_family/a/accuracy": 0.5, "by_family/b/n": 2, "by_family/b/n_decoy": 1, "by_family/b/decoy_rate": 0})
    assert "by_family/b/decoy_of_errors" not in got and "calib/noul/nrps" not in got and "auroc" not in got
    # yes at 0.4 and 0.9: both right, only the second decisive
    assert close(got, {"calib/noul/decisive_rate": 0.5, "calib/noul/decisive_accuracy": 1, "calib/noul/accuracy_with_abstentions_wrong": 0.5, "calib/noul/competence": 0, "calib/noul/brier": (0.16 + 0.01) / 2})
    # levels 0, 1, 2 at 0.6, 0.3, 0.1 with gold 0
    assert close(got, {"calib/score/nrps": (0.4**2 + 0.1**2) / 2, "calib/score/interval90_coverage": 1, "calib/score/interval90_width": 1, "calib/score/accuracy_minus_confidence": 0.4})
    assert close(got, {"by_gold_slot/0-9/n": 5, "by_gold_slot/0-9/accuracy": 0.8})


def test_record_agrees_with_the_single_metrics(spark):
    rows = [(k, [((k * 7 + j * 3) % 11 + 1) / 40 for j in range(4)], k % 4, [9, 8, 3, 1], [9, 8, 3, 1][k % 4], "choice", None, f"f{k % 3}" if k % 5 else None, 8 if k % 2 else None, k / 10, (k * k % 17) / 17, 0.1, k % 3 == 0) for k in range(200)]
    examples = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got, f = record(V.evaluate(examples, pos_class=3)), E.features(examples)
    for one in (E.summarize(f), E.decoy_summary(f), E.first_two_slots(f), E.menu_size_summary(f), E.answer_mass_summary(f.filter("m_answer is not null"))):
        assert close(got, one.first().asDict())
    pairs = f.select(F.get("q", F.lit(2)).alias("p"), (F.col("label") == 3).cast("int").alias("y"))
    assert close(got, E.binary_summary(pairs).first().asDict())
    for r in E.by_family(f).collect():
        assert close(got, {f"by_family/{r.family}/{c}": v for c, v in r.asDict().items() if c not in ("family", "first_row")})
    for r in E.by_gold_slot(f).collect():
        assert close(got, {f"by_gold_slot/{r.slots}/{c}": v for c, v in r.asDict().items() if c != "slots"})
    assert close(got, {f"calib/choice/{k}": v for k, v in E.choice_calibration(f).first().asDict().items()})


def test_one_scan(spark, tmp_path, monkeypatch):
    """The examples are read once, by the plan that writes the cells; the record reads cells alone."""
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "examples"))
    plans, real = [], V.written
    monkeypatch.setattr(V, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    out = V.evaluate(spark.read.parquet(str(tmp_path / "examples")), pos_class=1)
    assert len(plans) == 1 and plans[0].count("FileScan") == 1
    assert "/examples" not in out._jdf.queryExecution().executedPlan().toString()
    passes = spark.read.parquet(str(tmp_path / "examples")).selectExpr("*", "row_id as question", "0 as pass")
    out = V.consistency_evaluate(passes)
    assert len(plans) == 2 and plans[1].count("FileScan") == 1 and len(re.findall(r"Exchange hashpartitioning\(question", plans[1])) == 1
    assert "/examples" not in out._jdf.queryExecution().executedPlan().toString()


def test_consistency(spark):
    flip = lambda r, k: (*r[:1], r[1][::-1], len(r[1]) - 1 - r[2], r[3][::-1], *r[4:6], r[6][::-1] if r[6] else None, *r[7:], k)
    same = [(*r, 0) for r in ROWS] + [flip(r, 1) for r in ROWS]
    rows = spark.createDataFrame([(r[0], *r) for r in same], f"question long, {SCHEMA}, pass int").repartition(4)
    got = record(V.consistency_evaluate(rows))
    assert close(got, {"n": 5, "passes": 2, "accuracy": 0.8, "agree": 1, "js": 0, "n_decoy": 3, "decoy_rate": 1 / 3, "by_family/a/n": 2, "by_family/a/accuracy": 0.5, "calib/noul/decisive_rate": 0.5})
    other = [(*ROWS[0], 0), (*ROWS[0][:1], [0.1, 0.2, 0.7], *ROWS[0][2:], 1)]
    got = record(V.consistency_evaluate(spark.createDataFrame([(r[0], *r) for r in other], f"question long, {SCHEMA}, pass int")))
    h = lambda *p: -sum(x * math.log(x) for x in p)
    assert close(got, {"n": 1, "agree": 0, "accuracy": 0.5, "js": h(0.4, 0.2, 0.4) - h(0.7, 0.2, 0.1)})


@pytest.mark.parametrize("make", [V.evaluate, lambda df: V.consistency_evaluate(df.selectExpr("*", "row_id as question", "0 as pass"))])
def test_empty_set(spark, make):
    assert record(make(spark.createDataFrame([], SCHEMA))) == {"n": 0}


def test_percentiles_by_ranges(spark):
    import numpy as np

    values = [((k * 7919) % 1009) / 7 for k in range(3000)] + [3.5] * 1000
    counts = spark.createDataFrame([(v,) for v in values] + [(None,)], "s double").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    got = E.percentiles(counts, {"a": 0.05, "b": 0.5, "c": 0.95, "d": 1.0, "e": 0.0}).first()
    assert np.allclose(list(got), [np.percentile(values, 100 * p) for p in (0.05, 0.5, 0.95, 1.0, 0.0)])
    assert list(E.percentiles(counts.filter("s is null"), {"a": 0.5}).first()) == [None]
