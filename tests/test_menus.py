import math

import pytest
from pyspark.sql import functions as F

from tallygrid.functions import menus as M


def one(spark, column, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).select(column.alias("x")).first().x


def arr(*xs):
    return F.array(*map(F.lit, xs))


def test_softmax_is_shift_free_and_takes_a_temperature(spark):
    got = one(spark, M.softmax(arr(1000.0, 1001.0), 2.0))
    assert got == pytest.approx([1 / (1 + math.exp(0.5)), 1 / (1 + math.exp(-0.5))])


def test_ties_go_to_the_first(spark):
    assert one(spark, M.top(arr(0.2, 0.4, 0.4))) == 1
    assert [one(spark, M.rank_of(arr(0.2, 0.4, 0.4), F.lit(k))) for k in range(3)] == [3, 1, 2]


def test_reorder_carries_everything(spark):
    menu = {"options": arr(10, 11, 12), "names": arr("a", "b", "c"), "gold_idx": F.lit(2), "target": arr(0.5, 0.25, 0.25), "decoy": F.lit(10)}
    out = M.reorder(menu, arr(2, 1))
    assert one(spark, F.struct(*[c.alias(n) for n, c in out.items()])).asDict() == {"options": [12, 11], "names": ["c", "b"], "gold_idx": 0, "target": [0.5, 0.5], "decoy": None}


def test_partner_order_differs(spark):
    for k in range(2, 6):
        rows = spark.range(40).select(M.partner_rows(F.lit(k), F.col("id")).alias("r")).collect()
        assert all(sorted(r.r) == list(range(k)) and r.r != list(range(k)) for r in rows)


def test_compose_menu_keeps_gold_and_cuts_to_the_pool(spark):
    rows = spark.range(60).select(M.compose_menu(F.lit(3), arr(1, 2, 3, 4, 5), F.when(F.col("id") < 30, 3).otherwise(9), F.col("id")).alias("m")).collect()
    assert all(3 in r.m and len(set(r.m)) == len(r.m) for r in rows)
    assert {len(r.m) for r in rows[:30]} == {3} and {len(r.m) for r in rows[30:]} == {5}
    assert len({tuple(r.m) for r in rows}) > 20


def test_top_and_random_rows_keep_order_and_gold(spark):
    assert one(spark, M.top_rows(arr(0.1, 0.5, 0.3, 0.1), F.lit(3), 3)) == [1, 2, 3]
    got = one(spark, M.random_rows(F.lit(6), F.lit(4), 3, F.lit("k")))
    assert len(got) == 3 and 4 in got and got == sorted(got)


def test_draw_k_stays_in_range(spark):
    for log in (False, True):
        ks = [r.k for r in spark.range(300).select(M.draw_k(2, 256, M.uniform(F.col("id")), log).alias("k")).collect()]
        assert min(ks) >= 2 and max(ks) <= 256
    assert sorted(ks)[150] < 60  # half of a log-uniform draw is short


def test_violations(spark):
    bad = M.violations(arr(1, 2), F.lit(0), F.lit(2), arr(0.7, 0.7), F.lit(1), arr(3, 3))
    assert one(spark, bad) == ["label_not_gold", "bad_target", "bad_decoy", "bad_codes"]
    assert one(spark, M.violations(arr(1, 2), F.lit(0), F.lit(1), arr(0.5, 0.5), F.lit(2), arr(3, 255))) == []


def test_codes_are_distinct(spark):
    got = one(spark, M.codes(F.lit(20), F.lit("x")))
    assert len(set(got)) == 20 and 0 <= min(got) and max(got) < 256


def test_schedule(spark):
    got = [r.x for r in spark.range(5).select(M.lr_scale(F.col("id") * 25, 50, 100, "cosine").alias("x")).collect()]
    assert got == pytest.approx([0, 0.5, 1, 0.5, 0], abs=1e-9)
