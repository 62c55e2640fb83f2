"""Written intermediate tables in the folder that all executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the setting is missing and Spark runs in one process."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SETTING} must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="stages-")
    spark.conf.set(SETTING, folder)
    return folder


#: Rows that are handed to a Python worker at once. A batch of whole texts is held several times over (vectors, stream, worker).
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
BATCH_SIZE, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(docs: DataFrame) -> DataFrame:
    """docs, whose texts will go to Python workers; the session's batches are cut down to BATCH_ROWS and BATCH_BYTES (and a row) if they are larger."""
    for name, most in ((BATCH, BATCH_ROWS), (BATCH_SIZE, BATCH_BYTES)):
        if not 0 < int(docs.sparkSession.conf.get(name).removesuffix("b")) <= most:
            docs.sparkSession.conf.set(name, str(most))
    return docs


#: Parquet looks at a page's and a row group's size after 100 rows only, and a reader holds a page whole.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "8", "parquet.enable.dictionary": "false"}
GROUP_BYTES = 8 << 20


def stage(df: DataFrame, compression: str = "zstd", light: bool = False, group_bytes: int | None = None) -> DataFrame:
    """Write `df` once and read it again. `light`: narrow rows in few files, as each file costs a task and a directory entry;
    they are dealt anew once they are computed, so that the work before keeps all its tasks. `group_bytes`: rows are of some megabytes each;
    tasks that write or read them hold about that much of a file at once."""
    if light:
        df = df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.options(compression=compression, **(LARGE_ROWS | {"parquet.block.size": str(group_bytes)} if group_bytes else {})).parquet(path)
    _written.append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


#: Tables up to this size go to all executors; larger ones are joined by a shuffle.
BROADCAST_BYTES = 48 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """`df`, a written table of rows of at most `row_bytes`, to be sent to all executors if its measured size allows."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def discard(staged: DataFrame) -> None:
    """Delete a stage that no later result reads."""
    spark = staged.sparkSession
    _delete(spark, staged._stage_path)
    _written.remove((spark, staged._stage_path))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release_shuffles(spark: SparkSession) -> None:
    """After a stage is written, the shuffles behind it are garbage; Spark deletes their files once its JVM notices."""
    spark.sparkContext._jvm.System.gc()


def remove_stages() -> None:
    """Delete what `stage` wrote in this process; called at exit, or once all results that read it are stored."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit; then the folder's owner removes it
            return


atexit.register(remove_stages)
