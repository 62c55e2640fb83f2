"""Every registered query of the engine's own operators against its DuckDB text on the smallest tables."""

import math
import os

import pytest

from tallygrid import plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", plans.QUERIES)
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name not in plans.ORACLES:
        return
    q = duck.execute(plans.ORACLES[name])
    names = [x[0] for x in q.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([plain(r[names.index(c)]) for c in df.columns]) for r in q.fetchall())
    assert sorted(str([plain(x) for x in r]) for r in rows) == want


def test_token_groups_keep_whole_lengths(spark, tmp_path):
    lengths = [3000, 128657, 5000, 4001, 25000, 9000]
    rows = [(i, "x", "en", "web", n) for i, n in enumerate(lengths)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.row_no: (r.length, r.group_no) for r in plans.QUERIES["token_groups"](spark, str(tmp_path)).collect()}
    assert [got[i][0] for i in range(len(lengths))] == lengths
    groups = [{i for i in got if got[i][1] == g} for g in sorted({g for _, g in got.values()})]
    assert groups == [{1}, {4}, {5}, {0, 2, 3}]


def test_asset_resolve_covers_the_whole_text(spark, tmp_path):
    long = "x" * 40
    rows = [(0, 0, "user", f"{long} img:1 end"), (1, 0, "user", long), (2, 0, "user", f"{long}y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: (r.used, r.problem, r.digest) for r in plans.QUERIES["asset_resolve"](spark, str(tmp_path)).collect()}
    assert [got[i][:2] for i in range(3)] == [("img:1,img:1", None), ("img:1", None), ("img:1", None)]
    assert got[1][2] != got[2][2]


ODD_TEXTS = [("en", None), ("en", "caf"), ("de", ""), ("de", "ab"), ("fr", "lost \uFFFD"), ("es", "x\uE000\uF8FFé"), ("yy", None), (None, "ñ"), (None, None)]


@pytest.mark.parametrize("rows", [*([r] for r in ODD_TEXTS), ODD_TEXTS, [("it", "é" * 41 + "x" * 599)]])
def test_garbled_filter_on_odd_texts(spark, tmp_path, rows):
    duckdb = pytest.importorskip("duckdb")
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, t, k, "web", 0) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{path}/*.parquet')")
    want = c.execute(f"select lang, n, kept, garbled from ({plans.ORACLES['garbled_filter']})").fetchall()
    got = plans.QUERIES["garbled_filter"](spark, str(tmp_path)).select("lang", "n", "kept", "garbled").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))
