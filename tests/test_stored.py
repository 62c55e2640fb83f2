import json

import pytest
from pyspark.sql import functions as F

from tallygrid import written
from tallygrid.operators import stored as S

KEY, CONTENT = ["domain", "id"], ["text", "n"]


def items(spark, rows):
    return spark.createDataFrame(rows, "domain string, id long, text string, n int").repartition(3)


ROWS = [("a", k, f"text {k}", k % 3 or None) for k in range(50)] + [("b", k, None, k) for k in range(5)]


def test_drift_in_one_row_is_named(spark):
    selection = S.build_selection(items(spark, ROWS), KEY, CONTENT)
    assert S.check_selection(selection, items(spark, [*ROWS, ("c", 1, "not chosen", 1)]), KEY, CONTENT).count() == 0
    later = [r for r in ROWS if r[:2] != ("a", 7)]
    later = [(d, i, "other" if (d, i) == ("a", 9) else t, 0 if (d, i) == ("a", 12) else n) for d, i, t, n in later] + [("b", 3, None, 3)]
    got = {(r.domain, r.id): r.problem for r in S.check_selection(selection, items(spark, later), KEY, CONTENT).collect()}
    assert got == {("a", 7): "missing", ("a", 9): "changed", ("a", 12): "changed", ("b", 3): "repeated"}
    new = S.build_selection(items(spark, [r for r in later[:-1] if r[0] == "a"] + [("c", 1, "x", 1)]), KEY, CONTENT)
    drift = {(r.domain, r.id): r.drift for r in S.selection_drift(selection, new, KEY).collect()}
    assert drift == {("a", 7): "gone", ("a", 9): "changed", ("a", 12): "changed", ("c", 1): "added"} | {("b", k): "gone" for k in range(5)}
    with pytest.raises(Exception, match="chosen twice: b/3"):
        S.build_selection(items(spark, later), KEY, CONTENT).collect()


def test_fingerprint_has_no_order(spark):
    one = S.fingerprint(S.build_selection(items(spark, ROWS), KEY, CONTENT), KEY).first()
    assert one == S.fingerprint(S.build_selection(items(spark, ROWS[::-1]).coalesce(1), KEY, CONTENT), KEY).first() and one["items"] == 55
    assert one != S.fingerprint(S.build_selection(items(spark, [*ROWS[:-1], ("b", 4, "", 4)]), KEY, CONTENT), KEY).first()
    assert S.fingerprint(S.build_selection(items(spark, []), KEY, CONTENT), KEY).first()["items"] == 0


OLD = {"steps": 10, "lr": 0.5, "mix": {"a": 1, "b": [1, {"c": None}]}, "name": "x", "tags": [], "same": {"deep": {"er": True}}, "log": {"dir": "/a"}}
NEW = {"steps": "10", "lr": 0.25, "mix": {"a": 1, "b": [1, {"c": 2}, 3]}, "tags": {}, "same": {"deep": {"er": True}}, "log": {"dir": "/b", "x": 1}, "logs": 1}


def test_config_diff(spark):
    frame = lambda *cs: spark.createDataFrame([(k, json.dumps(c)) for k, c in enumerate(cs)], "run long, config string")
    got = {(r.run, r.path): (r.difference, r.old, r.new) for r in S.config_diff(frame(OLD, OLD), frame(NEW, OLD), "run", "config", ("$.log",)).collect()}
    assert got == {
        (0, "$.steps"): ("retyped", "10", '"10"'), (0, "$.lr"): ("changed", "0.5", "0.25"), (0, "$.mix.b[1].c"): ("retyped", "null", "2"), (0, "$.mix.b[2]"): ("added", None, "3"),
        (0, "$.name"): ("missing", '"x"', None), (0, "$.tags"): ("retyped", "[]", "{}"), (0, "$.logs"): ("added", None, "1"),
    }
    assert S.config_diff(frame(OLD), frame(OLD), "run", "config").count() == 0
    assert [tuple(r) for r in S.config_diff(frame(), frame(7), "run", "config").collect()] == [(0, "$", "added", None, "7")]


def nested(levels, inner):
    for k in range(levels):
        inner = [inner] if k % 2 else {"a": inner}
    return inner


def leaves(value, path="$"):
    steps = [(f".{k}", v) for k, v in value.items()] if isinstance(value, dict) else [(f"[{k}]", v) for k, v in enumerate(value)] if isinstance(value, list) else []
    return [leaf for step, v in steps for leaf in leaves(v, path + step)] if steps else [(path, json.dumps(value))]


def test_configurations_are_read_once_and_not_written(spark):
    """A table was written and read again for each level, and the text parsed for each use of it."""
    few = [OLD, NEW, 7, None, [], {"a.b": [], "c": {"d": ["}]", "\\", '\\"{']}}]
    many = [nested(20, 1), nested(32, None), {"s": ["[{" * 40, "\\", '"' * 9, '\\"[']}, [[k, {}] for k in range(100)], [nested(k, k) for k in range(12)]]
    tables = list(written._tables)
    for configs, levels in ((few, 3), (many[2:3], 2), (many, 32)):
        texts = [(k, json.dumps(c)) for k, c in enumerate(configs)] + [(99, None)]
        df = S.paths(spark.createDataFrame(texts, "run long, config string").repartition(3), "run", "config")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("parseJson") == 1 and levels <= plan.count("variant_explode(") <= max(levels, S.FEW_LEVELS)
        assert sorted((r.key, r.path, r.value) for r in df.collect()) == sorted((k, *leaf) for k, c in enumerate(configs) for leaf in leaves(c))
    assert written._tables == tables
    with pytest.raises(ValueError, match="more than 32 levels"):
        S.paths(spark.createDataFrame([(0, json.dumps(nested(33, 1)))], "run long, config string"), "run", "config")
    with pytest.raises(Exception, match="MALFORMED"):
        S.paths(spark.createDataFrame([(0, "{")], "run long, config string"), "run", "config").collect()


def test_pairs_point_at_each_other(spark):
    rows = [("c", "q1", None), ("c", "q2", "q1"), ("d", "q1", "q2"), ("d", "q2", "q1"), ("c", "q3", None), (None, "x", None), (None, "y", "x")]
    frame = lambda rs: spark.createDataFrame([(*r, 1) for r in rs], "context string, key string, other_of string, pair_no int").repartition(3)
    got = {(r.context, r.key): r.pair for r in S.link_pairs(frame(rows), ["context"]).collect()}
    assert got == {("c", "q1"): "q2", ("c", "q2"): "q1", ("d", "q1"): "q2", ("d", "q2"): "q1", ("c", "q3"): None, (None, "x"): "y", (None, "y"): "x"}
    for bad, said in (([*rows, ("c", "q4", "q1")], "a third half: c/q1"), ([*rows, ("c", "q4", "q9")], "no such half: c/q9"), ([*rows, ("c", "q4", "q4")], "its own half: c/q4")):
        with pytest.raises(Exception, match=said):
            S.link_pairs(frame(bad), ["context"]).collect()


def test_a_hot_pair_key_is_counted_before_it_is_sent(spark):
    rows = spark.range(20_000, numPartitions=8).select(F.lit("c").alias("context"), F.col("id").cast("string").alias("key"), F.when(F.col("id") > 0, "0").alias("other_of"))
    with pytest.raises(Exception, match="a third half: c/0"):
        S.link_pairs(rows, ["context"]).collect()
