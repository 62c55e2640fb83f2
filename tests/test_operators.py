import math
import random
from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallygrid.operators import corpus as C
from tallygrid.operators import panel as P
from tallygrid.operators import selection as S


def test_dedupe(spark):
    df = spark.createDataFrame(list(zip(range(6), "abacbd", [0, 1, 0, 1, 0, 0], strict=True)), "row_id long, text string, label int")
    assert [(r.text, r.label) for r in C.conflict_dedupe(df).orderBy("row_id").collect()] == [("a", 0), ("c", 1), ("d", 0)]


def test_merge_copies(spark):
    posts = [(0, 5, "b", 21, 0), (1, 3, "a", 4, -1), (2, 9, "b", 19, 0), (3, 7, "b", 21, 1), (4, 8, "", 1, 0), (5, 6, "c", 2, 7)]
    got = {r.text: (r.ids, r.tags, r.sentiments) for r in C.merge_copies(spark.createDataFrame(posts, "row_id long, id long, text string, tag int, sentiment int")).collect()}
    assert got == {"b": ([5, 9, 7], {21: 2, 19: 1}, {0: 2, 1: 1}), "a": ([3], {4: 1}, {-1: 1}), "c": ([6], {2: 1}, {})}


def test_missing_description_and_key_fail(spark):
    classes = C.class_ids(spark.createDataFrame([("b",), ("a",), (None,)], "name string"))
    assert [(r.class_id, r.name) for r in classes.orderBy("class_id").collect()] == [(0, "a"), (1, "b")]
    with pytest.raises(Exception, match="no description for b"):
        C.label_names(classes, spark.createDataFrame([("a", "x")], "name string, description string")).collect()
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    assert C.select_keys(rows, spark.createDataFrame([(2,)], "k int"), ["k"]).count() == 1
    with pytest.raises(Exception, match="selected keys"):
        C.select_keys(rows, spark.createDataFrame([(3,)], "k int"), ["k"]).collect()


def test_traces_attach_and_strays_are_ignored(spark):
    items = spark.createDataFrame([("c", "q"), ("c", "r")], "context_id string, question_id string")
    traces = spark.createDataFrame([("c", "q", 0, 1, "t"), ("x", "q", 0, 0, "u")], "context_id string, question_id string, text_no int, ask_no int, trace string")
    assert {r.question_id: r.traces for r in C.attach_traces(items, traces).collect()} == {"q": {"0/1": "t"}, "r": None}


def test_roots_and_cycles(spark):
    rows = [(k, k - 1 if k % 50 else None) for k in range(100)] + [(201, 202), (202, 203), (203, 201), (204, 201)]
    got = {r.key: r.root for r in S.roots(spark.createDataFrame(rows, "key long, parent long")).collect()}
    assert all(got[k] == k // 50 * 50 for k in range(100)) and {got[k] for k in (201, 202, 203)} == {201}


def test_roots_of_long_chains(spark):
    rows = [(k, k - 1 if k > 1000 else None) for k in range(1000, 1300)] + [(k, k + 1) for k in range(200)] + [(200, 50)]
    got = {r.key: r.root for r in S.roots(spark.createDataFrame(rows, "key long, parent long")).collect()}
    assert {got[k] for k in range(1000, 1300)} == {1000}
    assert all(got[k] == min(k, 50) for k in range(201))


def test_running_before_equals_a_plain_sum(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), k, rnd.randint(1, 5)) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, n int").withColumn("h", F.sha2(F.col("k").cast("string"), 256))
    got = {r.k: r.before for r in S.running_before(df, "g", F.col("h"), F.col("n"), parts=7).collect()}
    order = {r.k: r.h for r in df.collect()}
    for g in "ab":
        total = 0
        for _, k, n in sorted((r for r in rows if r[0] == g), key=lambda r: order[r[1]]):
            assert got[k] == total
            total += n


def test_ladder_is_nested_and_disjoint(spark):
    groups = spark.createDataFrame([(c, f"{c}{k}", 1 + k % 3) for c in "xy" for k in range(60)], "class string, group_key string, size int")
    split = S.ladder_split(groups, 20, "s:").cache()
    held = {(r["class"]): r.n for r in split.filter("held_out").groupBy("class").agg(F.sum("size").alias("n")).collect()}
    assert all(20 <= n <= 22 for n in held.values())
    pools = []
    for n in (10, 40, 500):
        wanted = spark.createDataFrame([("x", n), ("y", n)], "class string, n int")
        pool = S.ladder_pool(split, wanted)
        pools.append({r.group_key for r in pool.collect()})
        assert all(r.exhausted == (n == 500) for r in S.pool_summary(pool, wanted).collect())
    assert pools[0] < pools[1] < pools[2] and not pools[2] & {r.group_key for r in split.filter("held_out").collect()}


def test_quotas():
    assert S.batch_quota({"a": 98, "b": 1, "c": 1}, 10) == {"a": 8, "b": 1, "c": 1}
    with pytest.raises(ValueError):
        S.batch_quota({"a": 1, "b": 1}, 1)
    assert S.dataset_parts(10, ["a", "b", "c"]) == [4, 3, 3]
    assert S.dataset_parts(10, ["a", "b", "a"], {"a": Fraction(2), "b": Fraction(1)}) == [4, 3, 3]
    assert sum(S.dataset_parts(7, ["a", "b", "c"], {k: Fraction(1, 3) for k in "abc"})) == 7


def test_specs():
    assert S.parse_mix(None, {"b", "a"}) == [(0, {"a": 1.0, "b": 1.0})]
    assert S.parse_mix("a=1,b=2; 5: a=2,b=1", {"a", "b"}) == [(0, {"a": 1, "b": 2}), (5, {"a": 2, "b": 1})]
    for bad in ("a=1", "a=1,b=0", "1: a=1,b=1", "a=1,b=1,c=1", "a=1,b=1; 0: a=1,b=1"):
        with pytest.raises(ValueError):
            S.parse_mix(bad, {"a", "b"})


def brute_groups(lengths, budget):
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    best = (math.inf, math.inf)
    for cuts in range(1 << max(0, len(order) - 1)):
        parts, now = [], [order[0]]
        for k in range(1, len(order)):
            if cuts >> (k - 1) & 1:
                parts.append(now)
                now = []
            now.append(order[k])
        parts.append(now)
        padded = [len(p) * lengths[p[0]] for p in parts]
        if all(c <= budget or len(p) == 1 for c, p in zip(padded, parts, strict=True)):
            best = min(best, (len(parts), sum(padded)))
    return best


def test_token_groups_are_optimal():
    rnd = random.Random(6)
    for _ in range(60):
        lengths = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 9))]
        budget = rnd.randint(5, 90)
        groups = S.token_groups(lengths, budget)
        assert sorted(r for g in groups for r in g) == list(range(len(lengths)))
        assert (len(groups), sum(len(g) * max(lengths[r] for r in g) for g in groups)) == brute_groups(lengths, budget)
    assert S.token_groups([5, 9, 2, 2], 18, [2, 2]) == [[0, 1], [2, 3]]


def test_first_fit_and_units():
    assert S.first_fit({"a": 5, "b": 1, "c": 2}, 10, 26) == [["b", "c"], ["a"]]
    assert S.contrast_units([1, 1, 1, 1, None, None, 2, 2], 2) == [4, 2, 2]


def test_epoch_rounds(spark):
    items = spark.createDataFrame([(k, k // 2 if k < 20 else None, "a" if k < 20 else "b") for k in range(40)], "key long, pair_key long, goal string")
    passes = spark.createDataFrame([("a", 2), ("b", 1)], "goal string, n int")
    rows = S.epoch_rounds(items, passes, 8, "s").collect()
    assert len(rows) == 60
    pairs = {}
    for r in rows:
        pairs.setdefault((r["pass"], r.pair_key), set()).add(r.batch_no) if r.pair_key is not None else None
    assert all(len(b) == 1 for b in pairs.values())


def test_draws_follow_weights(spark):
    items = spark.createDataFrame([(g, f"d{k % 2}", "k", k // 2, k) for k, g in enumerate("aabbbbbbbb")], "goal string, domain string, kind string, context_id int, key int")
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "goal string, weight double")
    rows = S.hierarchical_draws(spark.range(2000).withColumnRenamed("id", "draw_id"), items, weights, "s").collect()
    assert len(rows) == 2000 and abs(sum(r.goal == "a" for r in rows) / 2000 - 0.75) < 0.04
    again = S.hierarchical_draws(spark.range(2000).withColumnRenamed("id", "draw_id").repartition(7), items, weights, "s").collect()
    assert {r.draw_id: r.key for r in rows} == {r.draw_id: r.key for r in again}


def test_companions(spark):
    items = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, None)], "key long, contrast long")
    draws = spark.createDataFrame([(0, 1), (1, 3), (2, 4)], "draw_id long, key long")
    long = lambda b: sorted((r.draw_id, r.unit_no, r.key) for r in S.companions(draws, items, b).collect())
    assert long(False) == [(0, 0, 1), (1, 0, 3), (1, 1, 1), (2, 0, 4)] and long(True) == [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 1), (2, 0, 4)]


def test_balanced_runs(spark):
    rows = spark.createDataFrame([(k, 3 + k % 2) for k in range(250)], "row_no long, k int").repartition(3)
    got = {r.row_no: r.codes for r in S.balanced_runs(rows, 0.5, "s", 100).collect()}
    assert got.keys() == set(range(250))
    for lo in (0, 100, 200):
        pdf = pd.DataFrame({"row_no": range(lo, min(lo + 100, 250))})
        want = S.balanced_codes(0.5, "s")(pdf.assign(k=3 + pdf["row_no"] % 2))
        assert {r: got[r] for r in pdf["row_no"]} == dict(zip(want["row_no"], want["codes"], strict=True))
    with pytest.raises(Exception, match="more than 100"):
        S.balanced_runs(rows.unionByName(rows), 0.5, "s", 100).collect()


def test_balanced_codes_even_out():
    import pandas as pd

    out = S.balanced_codes(1.0, "s", slots=16)(pd.DataFrame({"row_no": range(64), "k": 4}))
    used = pd.Series([c for codes in out["codes"] for c in codes]).value_counts()
    assert len(used) == 16 and used.max() - used.min() <= 1 and all(len(set(c)) == 4 for c in out["codes"])


def test_sampled_turns(spark):
    rows = spark.createDataFrame([(k, [f"{k}.{j}" for j in range(3)]) for k in range(10)], "k int, turns array<string>")
    got = S.uniform_turns(rows, "k", "turns", 7, "s").collect()
    assert sum(len(r.turns) for r in got) == 7 and all(r.turns == sorted(r.turns) for r in got)


def test_contrast_rows(spark):
    rows = [(0, 1, 5, [5, 6], "bool"), (1, 1, 6, [6, 5], "bool"), (2, 2, 5, [5, 6], "bool"), (3, 2, 7, [7, 8], "bool"), (4, 3, 5, [5, 6], "choice"), (5, 3, 5, [5, 6], "choice")]
    df = spark.createDataFrame([(*r, None) for r in rows], "row_no int, contrast_group int, label int, options array<int>, qtype string, target array<double>")
    assert sorted(tuple(r) for r in S.contrast_rows(df).collect()) == [(0, 1, False, 0, 1), (1, 1, True, 1, 0)]
    assert S.contrast_rows(df, ["score"]).count() == 0


def test_panel_noul_and_score(spark):
    rows = [(0, "noul", 2, [1 - p, p], g) for p, g in ((0.9, 1), (0.6, 1), (0.1, 0), (0.3, 0), (0.95, 0))] + [(5, "score", 3, [0.1, 0.3, 0.6], 2)]
    got = P.score_questions(spark.createDataFrame(rows, "id int, type string, k int, probs array<double>, gold_pos int")).collect()
    assert [(r.metric, r.top1) for r in got[:5]] == [(1, True), (0, True), (1, True), (0, True), (0, False)]
    assert got[5].metric == pytest.approx(1 - 0.5 / 2) and got[5].top1


def test_panel_summary(spark):
    rows = [("s", 0, "choice", 4, [0.7, 0.1, 0.1, 0.1], 0, None), ("s", 1, "choice", 4, [0.7, 0.1, 0.1, 0.1], 1, None), ("s", 2, "noul", 2, [0.1, 0.9], 1, None), ("s", 3, "score", 3, [0.1, 0.3, 0.6], 2, None), ("s", 4, "choice", 4, [0.25] * 4, 0, "timeout")]
    got = P.summarize(P.score_or_fail(spark.createDataFrame(rows, "set string, id int, type string, k int, probs array<double>, gold_pos int, error string"))).first()
    assert (got.n, got.errors, got.n_choice) == (5, 1, 3)
    assert got.choice == pytest.approx((1 / 3 - 0.25) / 0.75) and got.score == pytest.approx(0.75)
    assert got.top1 == pytest.approx(3 / 5)
