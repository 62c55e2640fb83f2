import sys
import uuid
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tallygrid.operators import scoring as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test
SCHEMA = "row_id long, prefix string, ask string, options array<string>"


class Counting:
    """Scores an option by its letters in the prefix; writes a file for each prefix that it reads and each part that it serves."""

    state = "struct<text:string,length:bigint>"

    def __init__(self, log, wrong=None):
        self.log, self.wrong = str(log), wrong

    def note(self, kind, text):
        (Path(self.log) / f"{kind}-{uuid.uuid4().hex}").write_text(repr(text))

    def read(self, prefixes):
        for p in prefixes.to_pylist():
            self.note("read", p)
        return pa.array([{"text": p or "", "length": len(p or "")} for p in prefixes.to_pylist()], pa.struct([("text", pa.string()), ("length", pa.int64())]))

    def score(self, state, questions):
        self.note("score", state["text"])
        out = [[sum(state["text"].count(c) for c in o) + state["length"] / 100 + len(a or "") for o in options] for a, options in zip(questions.column("ask").to_pylist(), questions.column("options").to_pylist(), strict=True)]
        return pa.array(self.wrong(out) if self.wrong else out)


def reads(log, kind):
    return Counter(f.read_text() for f in Path(log).glob(f"{kind}-*"))


def rows(n):
    """A third shares one prefix; others share by tens; some have none."""
    return [(k, "hot " * 50 if k % 3 == 0 else None if k % 31 == 0 else f"prefix {k // 10}", "?" * (k % 4) if k % 5 else None, ["ho", "pre", f"x{k}"][: 1 + k % 3]) for k in range(n)]


def want(row):
    k, p, a, options = row
    return [sum((p or "").count(c) for c in o) + len(p or "") / 100 + len(a or "") for o in options]


@pytest.mark.parametrize("part", [50_000, 40])
def test_a_prefix_is_read_once(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(S, "PART_ROWS", part)
    monkeypatch.setattr(S, "MOST_HOT", 100)
    data = rows(1000)
    questions = spark.createDataFrame(data, SCHEMA).withColumn("_other", F.lit(1)).repartition(5)
    got = S.score_shared(questions, Counting(tmp_path), "prefix", "row_id", "options").collect()
    assert {r.row_id: r.z for r in got} == {r[0]: want(r) for r in data} and len(got) == len(data)
    assert [c for c in got[0].asDict()] == [*questions.columns, "z"]
    seen = reads(tmp_path, "read")
    assert set(seen.values()) == {1} and len(seen) == len({r[1] for r in data})
    hot = reads(tmp_path, "score")[repr("hot " * 50)]
    assert hot >= 8 if part == 40 else hot == 1  # split where it is hot, each part with the state once


def test_a_hot_prefix_is_in_no_task_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "PART_ROWS", 40)
    questions = spark.createDataFrame(rows(1000), SCHEMA)
    scored = S.score_shared(questions, Counting(tmp_path), "prefix", "row_id").withColumn("task", F.spark_partition_id()).filter("prefix like 'hot%'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # parts this small would be put together again
    sizes = [r["count"] for r in scored.groupBy("task").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 0.8 * sum(sizes)


@pytest.mark.parametrize(("wrong", "said"), [(lambda z: z[:-1], "lists for"), (lambda z: [[float("nan")] * len(x) for x in z], "not finite"), (lambda z: [[*x, 1.0] for x in z], "more or fewer"), (lambda z: [[None] * len(x) for x in z], "not finite")])
def test_wrong_scores_fail(spark, tmp_path, wrong, said):
    questions = spark.createDataFrame(rows(20), SCHEMA)
    with pytest.raises(Exception, match=said):
        S.score_shared(questions, Counting(tmp_path, wrong), "prefix", "row_id", "options").collect()


def test_empty(spark, tmp_path):
    assert S.score_shared(spark.createDataFrame([], SCHEMA), Counting(tmp_path), "prefix", "row_id", "options").count() == 0


def test_plain_function_and_answers(spark):
    questions = spark.createDataFrame(rows(50), SCHEMA)
    got = S.answered(S.score(questions, lambda b: pa.array([[float(len(o)) for o in options] for options in b.column("options").to_pylist()]), "options")).collect()
    assert len(got) == 50 and all(r.z == [float(len(o)) for o in r.options] and abs(sum(r.q) - 1) < 1e-12 and r.options[r.pred] == max(r.options, key=len) for r in got)
