import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import exchange as X
from tallygrid.llm import staging
from tallygrid.llm import suffixdedup as S
from tallygrid.llm.staging import BATCH_BYTES, BATCH_SIZE


def run(spark, texts, **kw):
    rows = spark.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, text string, data string").repartition(3)
    out = {}
    for r in S.repeats(rows, **kw).collect():
        import hashlib

        out.setdefault(r.doc_id, (r.n_bytes, r.n_bytes - len(r.kept), len(r.starts), hashlib.sha256(r.kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,period,cover", [(12, 3, (1, 2)), (20, 13, (0, 1, 3, 9)), (200, 133, S.COVER)])
def test_equals_definition(spark, length, period, cover):
    rnd = random.Random(length)
    passages = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(length // 2, 3 * length))) for _ in range(12)]
    texts = {}
    for d in range(60):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else "".join(rnd.choice("uvwxyz") for _ in range(rnd.randint(0, 2 * length))) for _ in range(rnd.randint(0, 5))]
        texts[d] = "".join(parts)
    texts |= {100: None, 101: "", 102: "a" * (3 * length), 103: texts[5], 104: texts[5], 105: texts[6][: length + 3]}
    assert run(spark, list(texts.items()), length=length, period=period, cover=cover, limit=700) == S.brute_force(texts, length)


def test_repeated_ids_and_a_very_long_text(spark):
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcdefghij \n") for _ in range(3_000_000))
    texts = {1: long, 2: "x" + long[1_000_000:1_000_500] + "y", 3: "short"}
    got = run(spark, list(texts.items()), limit=1 << 20)
    assert got == S.brute_force(texts)
    rows = spark.createDataFrame([(7, "q" * 250), (7, "w" + "q" * 230), (7, "clean"), (8, "e" * 199)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("offsets", "doc_ids", "kept")})
    assert sorted((r.doc_id, r.n_bytes, len(r.kept)) for r in S.repeats(rows).collect()) == [(7, 5, 5), (7, 231, 1), (7, 250, 0), (8, 199, 199)]


def test_null_ids_beside_large_ones(spark):
    far = (1 << 53) + 1
    rows = spark.createDataFrame([(None, "q" * 250), (far, "w" + "q" * 230), (None, None), (far + 1, "clean")], "doc_id long, text string").withColumn("absent", F.lit(1)).coalesce(1)
    got = sorted(((r.doc_id, r.n_bytes, len(r.kept)) for r in S.repeats(rows).collect()), key=str)
    assert got == sorted([(None, 250, 0), (far, 231, 1), (None, 0, 0), (far + 1, 5, 5)], key=str)


def test_blocks_are_read_and_handed_over_a_few_at_a_time(spark):
    """One task writes many blocks: no row group holds more than eight of them, and batches are bounded by their bytes."""
    rnd = random.Random(4)
    docs = spark.createDataFrame([(k, "".join(rnd.choices("abcdefgh", k=40_000))) for k in range(60)], "doc_id long, text string").coalesce(1)
    blocks = S.text_blocks(docs, limit=40_000)
    (file,) = Path(blocks._stage_path.removeprefix("file:")).glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_rows == 60 and max(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) <= 8
    assert int(spark.conf.get(BATCH_SIZE).removesuffix("b")) <= BATCH_BYTES


def test_large_replies_are_hashed_rather_than_blocks_sorted(spark, monkeypatch):
    monkeypatch.setattr(staging, "BROADCAST_BYTES", -1)
    replies = spark.createDataFrame([(1, [(0, b"x", None)])], "block_id long, replies array<struct<bucket:int,shared:binary,first:binary>>")
    plan = X.attach(spark.range(3).withColumnRenamed("id", "block_id"), replies, "r")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    texts = {d: "repeated " * 40 + str(d) for d in range(30)}
    assert run(spark, list(texts.items()), limit=700) == S.brute_force(texts)


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_cover_is_checked(spark):
    with pytest.raises(ValueError):
        S.repeats(spark.createDataFrame([], "doc_id long, text string"), period=7, cover=(0, 1))
