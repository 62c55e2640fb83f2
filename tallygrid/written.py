"""Intermediate tables, written to the folder that the cluster shares: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_tables: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder; a temporary one only where there is no setting and all of Spark is one process."""
    if folder := spark.conf.get(SETTING, None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SETTING} must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="tables-")
    spark.conf.set(SETTING, folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """`df`, written once and read again. The table goes at exit, or with `remove`."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _tables.append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


#: Rows and bytes that a Python worker is handed at once; a batch is held several times over (vectors, stream, values, result).
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, whose texts may go to Python workers; larger batches of its session are cut down to BATCHES."""
    for name, most in BATCHES.items():
        if not 0 < int(df.sparkSession.conf.get(name).removesuffix("b")) <= most:
            df.sparkSession.conf.set(name, str(most))
    return df


def remove(table: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    _delete(table.sparkSession, table._written_path)
    _tables.remove((table.sparkSession, table._written_path))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def remove_all() -> None:
    """Whatever can't be deleted, as its session is gone, stays for the folder's owner."""
    while _tables:
        with contextlib.suppress(Py4JError, OSError, AttributeError):
            _delete(*_tables.pop())
