import gzip
import hashlib
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tallygrid import streaming
from tallygrid.sources import readers as R


def test_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfk,v\n1,"x, y"\n')
    (tmp_path / "a.tsv").write_text("k\tv\n1\tx, y\n")
    (tmp_path / "a.json").write_text('[{"k": 1, "v": "x, y"}]')
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"k": 1, "v": "x, y"}\n')
    for name in ("a.csv", "a.tsv", "a.json", "a.jsonl.gz"):
        assert [tuple(r) for r in R.records(spark, str(tmp_path / name), "k int, v string").collect()] == [(1, "x, y")], name
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception):
        R.records(spark, str(tmp_path / "bad.jsonl"), "k int").collect()
    rows = R.records(spark, str(tmp_path / "a.csv"), "k int, v string")
    assert R.checked(rows, 1).count() == 1
    with pytest.raises(Exception, match="expected 2 rows"):
        R.checked(rows, 2).collect()


def test_manifest(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"k": 1}\n')
    entry = {"dataset": "d", "path": "d.jsonl", "split": "train", "sha256": hashlib.sha256(b'{"k": 1}\n').hexdigest(), "provenance": "p", "licence": "l"}
    spec = {"version": 1, "sources": [entry, {"dataset": "e", "path": "missing", "split": "test"}]}
    (tmp_path / "m.json").write_text(json.dumps(spec))
    entries = R.manifest(spark, str(tmp_path / "m.json"))
    assert len(entries) == 1 and R.verified(spark, entries[0]).endswith("d.jsonl")
    with pytest.raises(ValueError):
        R.verified(spark, {**entries[0], "sha256": "0"})
    for bad in ({**spec, "version": 2}, {**spec, "sources": [entry, entry]}, {**spec, "sources": [{**entry, "licence": ""}]}):
        (tmp_path / "m.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            R.manifest(spark, str(tmp_path / "m.json"))


def test_folders_are_verified_by_their_paths(spark, tmp_path):
    """Equal names in subfolders are files of their own."""
    folder, want = tmp_path / "t", {}
    for k, name in enumerate(("x", "one/x", "two/x")):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(bytes([k]))
        want[name] = hashlib.sha256(bytes([k])).hexdigest()
    assert R.verified(spark, {"path": str(folder), "sha256": want})
    for wrong in (want | {"two/x": want["x"]}, want | {"three/x": want["x"]}, {k: v for k, v in want.items() if k != "x"}, want["x"]):
        with pytest.raises(ValueError, match="sha256 is"):
            R.verified(spark, {"path": str(folder), "sha256": wrong})


def test_checksums(spark, tmp_path):
    (tmp_path / "t" / "sub").mkdir(parents=True)
    (tmp_path / "t" / "a").write_bytes(b"1")
    (tmp_path / "t" / "sub" / "b").write_bytes(b"2")
    sums = R.file_sums(spark, str(tmp_path / "t"))
    assert {(r.path, r.sha256) for r in sums.collect()} == {("a", hashlib.sha256(b"1").hexdigest()), ("sub/b", hashlib.sha256(b"2").hexdigest())}
    before = R.fingerprint(sums).first().fingerprint
    (tmp_path / "t" / "a").write_bytes(b"3")
    assert R.fingerprint(R.file_sums(spark, str(tmp_path / "t"))).first().fingerprint != before


def test_corpora(spark, tmp_path):
    (tmp_path / "sms").write_text("ham\tHi &amp; bye\tx\nspam\tWIN\n")
    assert [tuple(r) for r in R.sms(spark, str(tmp_path / "sms")).collect()] == [("1", 0, "Hi & bye\tx"), ("2", 1, "WIN")]
    with tarfile.open(tmp_path / "m.tgz", "w:gz") as t:
        for name in ("data/inmail.10", "data/inmail.2"):
            raw = f"Subject: {name}\n\nbody".encode()
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("u/spam/1", "Subject: s\n\nb")
        z.writestr("u/ham/1", "Subject: h\n\nb")
    members = R.archive_members(R.files(spark, str(tmp_path), "*.tgz"))
    index = spark.createDataFrame([("spam ../data/inmail.10",), ("Ham ../data/inmail.2",)], "value string")
    got = R.indexed_mail(index, members).orderBy("sort_key").collect()
    assert [(r.id, r.label) for r in got] == [("data/inmail.2", 0), ("data/inmail.10", 1)] and got[0].text.startswith("Subject: data/inmail.2")
    with pytest.raises(Exception, match="no body"):
        R.indexed_mail(spark.createDataFrame([("spam data/none",)], "value string"), members).collect()
    assert {(r.id, r.label) for r in R.labelled_mail(R.archive_members(R.files(spark, str(tmp_path), "*.zip"))).collect()} == {("u/spam/1", 1), ("u/ham/1", 0)}


def test_dump(spark):
    lines = spark.createDataFrame([("-- comment",), ("INSERT INTO `t` VALUES (1,'a',2.5),(2,NULL,1);",), ("INSERT INTO `other` VALUES (broken",), ("INSERT INTO `t` VALUES (3,'c',0);",)], "value string")
    got = R.dump_table(lines, "t", "id bigint, s string, x double")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 2.5), (2, None, 1.0), (3, "c", 0.0)]


def test_spam_corpus(spark):
    rows = [(0, "1", 0, "ok text"), (1, "2", 0, "ok text"), (2, "3", 1, ""), (3, "4", 1, "���"), (4, "5", 0, "both"), (5, "6", 1, "both")]
    got = R.spam_corpus(spark.createDataFrame(rows, "row_id long, id string, label int, text string"))
    assert [r.id for r in got.collect()] == ["1"]


def test_logs(spark, tmp_path):
    lines = spark.createDataFrame([(0, '{"step": 1}'), (1, '{"step": 2}'), (2, '{"st')], "line_no int, value string")
    assert [r.line_no for r in R.without_torn_line(lines, "step int", 1).collect()] == [0]
    with pytest.raises(Exception, match="unreadable line"):
        R.without_torn_line(lines.withColumn("line_no", 2 - F.col("line_no")), "step int", 9).collect()
    req = spark.createDataFrame([({"a": ("png", "QUJD")},)], "assets map<string,struct<format:string,data_base64:string>>").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = R.logged_request(req).first()
    assert got.ts == "2024-01-01T00:00:00.000Z" and got.assets["a"].bytes == 3 and got.assets["a"].sha256 == hashlib.sha256(b"ABC").hexdigest()
    items = spark.createDataFrame([("s", "1", "x"), ("s", "2", "y"), ("t", "1", "z")], "set string, id string, state string")
    assert {(r["set"], r["items"]) for r in R.export_panel(items, str(tmp_path / "out")).collect()} == {("s", 2), ("t", 1)}
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    with pytest.raises(Exception, match="repeated"):
        R.export_panel(items.union(items), str(tmp_path / "again")).collect()


def test_cache_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert R.cached(spark, str(tmp_path), "c", 1, build).count() == 3
    assert len(calls) == 1 and R.cached(spark, str(tmp_path), "c", 2, build).count() == 3 and len(calls) == 2


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.range(200).select((F.timestamp_seconds(F.col("id") * 977)).alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"), (F.col("id") % 7).alias("user_id"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming.windowed_values(stream).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from w").collect())) == sorted(map(tuple, streaming.windowed_values(rows).collect()))
    sink = streaming.append_results(stream.select("event_type", "value"), str(tmp_path / "log"), str(tmp_path / "ck")).start()
    sink.processAllAvailable()
    sink.stop()
    assert spark.read.json(str(tmp_path / "log")).count() == 200
    log = spark.createDataFrame([(s, "loss", float(s)) for s in range(1, 8)], "step int, name string, value double")
    assert {r.block: r["mean"] for r in streaming.running_means(log, 3).collect()} == {1: 2.0, 2: 5.0, 3: 7.0}
