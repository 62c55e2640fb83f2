import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import exactdedup as E
from tallygrid.llm import staging

CASES = {
    "mixed": [(k, random.Random(k % 13).choice(["Same", "same", "SAME ", "É", "é", "x" * 5000, None, ""])) for k in range(200)],
    "only history": [(2, "a"), (4, "A"), (6, None)],
    "only batch": [(1, "a"), (3, "A"), (5, "")],
    "repeated row": [(1, "a"), (1, "a"), (2, "b")],
    "null ids": [(None, "a"), (None, "A"), (None, "b"), (2, "b"), (3, "b"), (None, "c"), (None, None), (4, "d"), (None, "d")],
    "very long": [(k, "Word " * 700_000 + str(k % 2)) for k in range(4)],
    "empty": [],
}


def brute(rows):
    groups = {}
    for d, t in rows:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        groups.setdefault(key, []).append(d)
    largest = lambda g: max((d for d in g if d is not None), default=None)
    return sorted(((d, largest(g), len(g), d == largest(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for d in g), key=str)


@pytest.mark.parametrize("limit", [48 << 20, 0])
@pytest.mark.parametrize("case", CASES)
def test_equals_definition(spark, monkeypatch, case, limit):
    monkeypatch.setattr(staging, "BROADCAST_BYTES", limit)
    docs = spark.createDataFrame([(d, t, "z", "z", 1) for d, t in CASES[case]], "doc_id long, text string, digest string, text_key string, bucket int")
    got = sorted(map(tuple, E.dedup(docs, E.even()).collect()), key=str)
    assert got == brute(CASES[case])
    kept = E.keep_one(docs, E.even())
    assert kept.schema == docs.schema
    assert sorted((str(r.doc_id), sha(r.text)) for r in kept.collect()) == sorted((str(d), h) for d, _, _, k, h in got if k)


def sha(text):
    return hashlib.sha256("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()).hexdigest()


def test_index_is_stored_and_loaded(spark, tmp_path):
    rows = E.digests(spark.createDataFrame([(k, f"text {k % 40}") for k in range(100)], "doc_id long, text string"))
    folder = str(tmp_path / "index")
    E.Index.build(rows.filter("doc_id < 50"), folder, 3)
    later = E.Index(spark, f"{folder}-3")
    for lo, hi in ((50, 70), (50, 100)):  # two batches against one index
        got = {(r.keep_id, r.group_size) for r in later.resolve(rows.filter(f"doc_id >= {lo} and doc_id < {hi}")).collect()}
        want = {}
        for k in [*range(50), *range(lo, hi)]:
            want.setdefault(k % 40, []).append(k)
        assert got == {(max(g), len(g)) for g in want.values()}


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 1 << 63, (5000, 4)).astype(np.uint64)
    h = E.PerfectHash(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(5000))
    assert (E.PerfectHash.load(*h.dump()).slots(keys) == h.slots(keys)).all()
    assert E.PerfectHash(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]


def test_history_may_be_any_condition(spark):
    docs = spark.createDataFrame(CASES["only batch"], "doc_id long, text string")
    assert sorted(map(tuple, E.dedup(docs, F.lit(True)).collect()), key=str) == brute(CASES["only batch"])
