import hashlib
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallygrid.sources import readers as R
from tallygrid.sources import shards as S


def test_entries_name_what_is_there(spark, tmp_path):
    df = spark.range(1000, numPartitions=3).withColumns({"text": F.concat(F.lit("t"), F.col("id").cast("string")), "left_out": F.lit(1)})
    folder = str(tmp_path / "out")
    made = S.rewrite(df, ["id", F.upper("text").alias("text")], folder, 200)
    entry = S.write_entry(made, folder, "d", "train", "made here", "CC0-1.0")
    there = [f for f in os.listdir(folder) if f.endswith(".parquet")]
    assert entry == S.read_entry(spark, folder) and entry["rows"] == 1000 and len(there) >= 5 and max(r.rows for r in made.collect()) == 200
    assert entry["sha256"] == {f: hashlib.sha256(open(f"{folder}/{f}", "rb").read()).hexdigest() for f in there}  # noqa: SIM115
    assert entry["bytes"] == sum(os.path.getsize(f"{folder}/{f}") for f in there)
    assert pq.read_schema(f"{folder}/{there[0]}").names == ["id", "text"]
    assert S.check_entry(spark, folder).count() == 0
    kept = {k: v for k, v in entry["sha256"].items()}
    assert R.verified(spark, {"path": f"{folder}", "sha256": kept}) == folder
    os.remove(f"{folder}/{there[0]}")
    os.replace(f"{folder}/{there[1]}", f"{folder}/other.parquet")
    for hidden in (f for f in os.listdir(folder) if f.startswith(".")):
        os.remove(f"{folder}/{hidden}")
    assert {(r.path, r.problem) for r in S.check_entry(spark, folder).collect()} == {(there[0], "missing"), (there[1], "missing"), ("other.parquet", "unlisted")}
    with pytest.raises(Exception, match="already exists"):
        S.rewrite(df, ["id"], folder)


def test_a_failed_task_leaves_no_entry(spark, tmp_path):
    df = spark.range(100, numPartitions=4).withColumn("v", F.when(F.col("id") == 77, F.raise_error(F.lit("broken row")).cast("bigint")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken row"):
        S.write_entry(S.rewrite(df, ["v"], str(tmp_path / "out")), str(tmp_path / "out"), "d", "train", "p", "l")
    assert not os.path.exists(tmp_path / "out.entry") and not [f for f in os.listdir(tmp_path / "out") if f.endswith(".parquet")] if os.path.exists(tmp_path / "out") else True


def test_empty(spark, tmp_path):
    made = S.rewrite(spark.range(0), ["id"], str(tmp_path / "out"))
    assert S.write_entry(made, str(tmp_path / "out"), "d", "train", "p", "l")["rows"] == 0
