"""Shards rewritten with a projection, and the manifest entries that name their bytes.

Spark's writer commits a job's files together, so what is listed afterwards is what the job wrote: a task that failed, or ran twice, leaves no file of its own. The entry is made from the committed files, read back: rows by file, bytes,
sha256. It is written last, and by name; without it the shards do not count.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.sources.readers import files

SHARD = "path string, rows bigint, bytes bigint, sha256 string"


def rewrite(df: DataFrame, columns: Sequence[str | Column], folder: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """df's columns as Parquet files of at most so many rows in a folder that is not there yet; the files as (path, rows, bytes, sha256)."""
    df.select(*columns).write.mode("error").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(folder)
    return shards(df.sparkSession, folder)


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """The Parquet files of a folder: (path below it, rows, bytes, sha256). Rows are counted by the files' footers' readers, bytes file by file."""
    name = F.element_at(F.split("path", "/"), -1)
    whole = files(spark, folder, "*.parquet").select(name.alias("path"), F.octet_length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    counted = spark.read.parquet(folder).groupBy(F.col("_metadata.file_name").alias("_name")).agg(F.count(F.lit(1)).alias("rows"))
    joined = whole.join(counted, F.col("path") == F.col("_name"), "left")
    return joined.select("path", F.coalesce("rows", F.lit(0)).alias("rows"), "bytes", "sha256")


def write_entry(made: DataFrame, folder: str, dataset: str, split: str, provenance: str, licence: str) -> dict:
    """The manifest entry of rewritten shards, written beside them as FOLDER.entry; a folder that has one is an error. One line a file: an entry's size."""
    listed = {r["path"]: r for r in made.orderBy("path").collect()}
    entry = {
        "dataset": dataset, "path": folder.rstrip("/").rpartition("/")[2], "split": split, "provenance": provenance, "licence": licence,
        "rows": sum(r["rows"] for r in listed.values()), "bytes": sum(r["bytes"] for r in listed.values()), "sha256": {p: r["sha256"] for p, r in listed.items()},
    }
    spark = made.sparkSession
    spark.createDataFrame([(json.dumps(entry, ensure_ascii=False),)], "value string").coalesce(1).write.mode("error").text(f"{folder.rstrip('/')}.entry")
    return entry


def read_entry(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder.rstrip('/')}.entry").first()["value"])


def check_entry(spark: SparkSession, folder: str) -> DataFrame:
    """Shards that the entry does not bear out: (path, problem: missing, unlisted or changed)."""
    want = spark.createDataFrame(sorted(read_entry(spark, folder)["sha256"].items()), "path string, _want string")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("_want").isNull(), "unlisted").when(F.col("sha256") != F.col("_want"), "changed")
    return want.join(shards(spark, folder), "path", "full").withColumn("problem", problem).filter("problem is not null").select("path", "problem")
