import pytest
from pyspark.sql import functions as F

from tallygrid.sources import dumps as D

DDL = {"posts": "id bigint, body string, views double", "adv_tags": "post_id bigint, label int", "tags": "id int, name string, group_id int"}


def quoted(s):
    return "NULL" if s is None else "'" + s.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n") + "'"


def dump(folder, n):
    """Statements of several rows, tables mixed, annotations in an order of their own; lines of very different lengths."""
    lines, order = ["-- a dump", "DROP TABLE IF EXISTS `posts`;"], [(k * 37) % n for k in range(n)]
    for k in range(0, n, 3):
        rows = ",".join(f"({i},{quoted(body(i))},{i / 4})" for i in range(k, min(k + 3, n)))
        lines.append(f"INSERT INTO `posts` VALUES {rows};")
        lines.append("INSERT INTO `adv_tags` VALUES " + ",".join(f"({i},{i % 2})" for i in order[k : k + 3]) + ";")
        lines.append(f"INSERT INTO `users` VALUES ({k},'+1 555');")
    lines.append("INSERT INTO `tags` VALUES (1,'a',10),(2,'it''s',20);")
    (folder / "dump.sql").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return order


def body(i):
    return None if i % 17 == 0 else f"post {i}\nsays 'hello' \\ " + "wörd " * (i * 13 % 200)


@pytest.fixture
def split(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tables_in_file_order_over_several_splits(spark, tmp_path, split):
    order = dump(tmp_path, 200)
    lines = D.file_lines(spark, str(tmp_path))
    assert lines.select("block").distinct().count() > 5
    got = D.tables(lines, DDL)
    posts = D.numbered(got["posts"]).orderBy("order_no").collect()
    assert [(r.order_no, r.id, r.body, r.views) for r in posts] == [(i, i, body(i), i / 4) for i in range(200)]
    adv = D.numbered(got["adv_tags"].repartition(7)).orderBy("order_no").collect()
    assert [(r.order_no, r.post_id, r.label) for r in adv] == [(k, i, i % 2) for k, i in enumerate(order)]
    assert [tuple(r)[4:] for r in got["tags"].orderBy("row").collect()] == [(1, "a", 10), (2, "it's", 20)]
    texts = D.annotated_posts(got["adv_tags"], got["posts"], 60).orderBy("order_no").collect()
    assert [(r.id, r.label) for r in texts] == [(str(i), i % 2) for i in order]
    assert texts[order.index(17)].text == "" and texts[order.index(4)].text.startswith("post 4\nsays 'hello' \\ wörd") and max(len(r.text) for r in texts) <= 60


def test_one_scan(spark, tmp_path, monkeypatch):
    dump(tmp_path, 20)
    plans, real = [], D.written
    monkeypatch.setattr(D, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    got = D.tables(D.file_lines(spark, str(tmp_path)), DDL)
    assert len(plans) == 1 and plans[0].count("FileScan") == 1
    assert not any("dump.sql" in t._jdf.queryExecution().executedPlan().toString() for t in got.values())


def test_bad_rows_fail(spark, tmp_path):
    (tmp_path / "d.sql").write_text("INSERT INTO `tags` VALUES (1,'a');\n")
    with pytest.raises(Exception, match="a row of tags has 2 values, not 3"):
        D.tables(D.file_lines(spark, str(tmp_path)), DDL)
    posts = spark.createDataFrame([(1, "x")], "id long, body string")
    notes = spark.createDataFrame([("f", 0, 0, 0, 2, 1)], "file string, block long, place long, row int, post_id long, label int")
    with pytest.raises(Exception, match="no post 2"):
        D.annotated_posts(notes, posts).collect()


def test_corpus_and_its_cache(spark):
    posts = spark.createDataFrame([("f", k // 2, k, 0, 100 - k, m, c, t, s) for k, (m, c, t, s) in enumerate([("a", None, 3, 1), (None, "b\\nb", 4, 0), ("a", "z", 3, -1), ("a", "", 5, 7), ("", None, 3, 0)])], "file string, block long, place long, row int, id long, message string, caption string, tag int, sentiment int")
    tags = spark.createDataFrame([(3, "x", 1), (4, "y", 2), (5, "z", 9)], "id int, name string, group_id int")
    merged, named = D.tagged_corpus(posts, tags, spark.createDataFrame([(1, "one"), (2, "two")], "id int, name string"))
    want = {"a": ([100, 98, 97], {3: 2, 5: 1}, {1: 1, -1: 1}), "b\nb": ([99], {4: 1}, {0: 1})}
    assert {r.text: (r.ids, r.tags, r.sentiments) for r in merged.collect()} == want
    again = D.corpus_from_json(D.corpus_json(merged))
    assert {r.text: (r.ids, r.tags, r.sentiments) for r in again.collect()} == want and dict(again.dtypes)["tags"] == "map<int,bigint>"
    assert sorted(map(tuple, named.collect())) == [(3, "x", 1, "one"), (4, "y", 2, "two"), (5, "z", 9, None)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([({"x": 1},)], "m map<string,int>").select(D.int_keys(F.col("m"))).collect()


def test_texts_are_tidied_once(spark):
    """What is merged are written rows: neither the texts nor their numbers are worked out anew for each count."""
    place = "file string, block bigint, place bigint, row int, "
    posts = spark.createDataFrame([("f", 0, k, 0, k, f"text  {k % 3}", None, k % 2, 1) for k in range(9)], place + "id bigint, message string, caption string, tag int, sentiment int")
    tags = spark.createDataFrame([(0, "a", 0), (1, "b", 0)], "id int, name string, group_id int")
    merged, _ = D.tagged_corpus(posts, tags, spark.createDataFrame([(0, "g")], "id int, name string"))
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "Window" not in plan
    assert {r.text: (r.ids, r.tags, r.sentiments) for r in merged.collect()} == {f"text {k}": ([k, k + 3, k + 6], {k % 2: 2, 1 - k % 2: 1}, {1: 3}) for k in range(3)}
