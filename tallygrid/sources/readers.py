"""Readers and writers. Schemas are explicit; bad input fails the query, counted rejections stay data."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.functions import text as X
from tallygrid.written import small_batches

#: Schemas of the tables that the registered queries read.
TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(TABLES[name]) if name in TABLES and name != "events" else spark.read
    return small_batches(reader.parquet(f"{sf_dir}/{name}.parquet"))


def jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines, plain or gzipped; an unreadable line or a wrong type fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header, UTF-8 with or without a mark."""
    return spark.read.schema(schema).options(header=True, sep=sep, mode="FAILFAST", multiLine=True, escape='"').csv(path)


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Any supported format, by its ending: parquet, csv, tsv, jsonl (also .gz), json."""
    kind = path.removesuffix(".gz").rpartition(".")[2]
    if kind == "parquet":
        return spark.read.schema(schema).parquet(path)
    if kind in ("csv", "tsv"):
        return delimited(spark, path, schema, "\t" if kind == "tsv" else ",")
    if kind == "jsonl":
        return jsonl(spark, path, schema)
    if kind == "json":
        return spark.read.schema(schema).options(mode="FAILFAST", multiLine=True).json(path)
    raise ValueError(f"unknown format: {path}")


def checked(rows: DataFrame, expected: int) -> DataFrame:
    """Fails the query if the table has another number of rows."""
    n = rows.agg(F.count(F.lit(1)).alias("_n")).select(F.when(F.col("_n") == expected, True).otherwise(F.raise_error(F.concat(F.lit(f"expected {expected} rows, got "), F.col("_n").cast("string")))).alias("_ok"))
    return rows.join(F.broadcast(n)).filter("_ok").drop("_ok")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, content of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "content")


def file_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Paths below the folder and their sha256."""
    rows = files(spark, folder)
    inside = F.substring_index("path", f"{folder.rstrip('/').rpartition('/')[2]}/", -1)
    return rows.select(inside.alias("path"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def fingerprint(sums: DataFrame) -> DataFrame:
    """One digest of a tree: over its sorted (path, sha256) list, a short row a file."""
    return sums.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda s: F.concat_ws(" ", s["path"], s["sha256"])), "\n"), 256).alias("fingerprint"))


def manifest(spark: SparkSession, path: str, version: int = 1) -> list[dict]:
    """The train entries of a source manifest: checked before any file is opened. An entry names dataset, path, split, sha256, provenance, licence and optionally include_ids."""
    spec = json.loads(spark.read.text(path, wholetext=True).first()["value"].removeprefix("\ufeff"))
    if spec.get("version") != version:
        raise ValueError(f"manifest version {spec.get('version')!r} is not {version}")
    entries = [e for e in spec["sources"] if e.get("split") == "train"]
    seen = set()
    for e in entries:
        missing = [k for k in ("dataset", "path", "sha256", "provenance", "licence") if not e.get(k)]
        if missing:
            raise ValueError(f"{e.get('dataset')}: no {', '.join(missing)}")
        if (e["dataset"], e["path"]) in seen:
            raise ValueError(f"{e['dataset']}: {e['path']} stands twice")
        seen.add((e["dataset"], e["path"]))
        e["path"] = f"{path.rpartition('/')[0] or '.'}/{e['path']}"
    return entries


def verified(spark: SparkSession, entry: dict) -> str:
    """The entry's path, once its bytes have the stated sha256: one for a file, or one for each path below a folder. The list of an entry's files is the driver's, as the entry is."""
    want = entry["sha256"]
    sums = files(spark, entry["path"]).select("path", F.sha2("content", 256).alias("sum"))
    if isinstance(want, dict):
        head = entry["path"].rstrip("/").rpartition("/")[2]
        got = {r["path"].split(f"/{head}/", 1)[1]: r["sum"] for r in sums.toLocalIterator()}
    else:
        got = [r["sum"] for r in sums.limit(2).collect()]
        want = [want]
    if got != want:
        raise ValueError(f"{entry['path']}: sha256 is {got}")
    return entry["path"]


def root(value: str | None = None, names: tuple[str, ...] = ("TALLYGRID_DATA",), default: str = "data") -> Path:
    """Where data sets lie: the argument, else the first variable that is set, else a folder beside the working one."""
    return Path(value or next((os.environ[n] for n in names if os.environ.get(n)), default))


# --- corpora -----------------------------------------------------------------------------------------------------------


def sms(spark: SparkSession, path: str) -> DataFrame:
    """`label<TAB>text` lines -> id (line number from 1), label (spam 1, ham 0), text with entities read."""
    # numbered by block: the lines before a block, and the place within it
    block = F.input_file_block_start()
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), block.alias("block"), F.monotonically_increasing_id().alias("at"))
    count = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    start = count.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("start"))  # a row a block
    place = F.row_number().over(Window.partitionBy("block").orderBy("at")) - 1
    lines = rows.withColumn("place", place).join(start, "block").select((F.col("start") + F.col("place")).alias("i"), "line").filter("line <> ''")
    part = F.split("line", "\t", 2)
    return lines.select((F.col("i") + 1).cast("string").alias("id"), F.when(part[0] == "spam", 1).when(part[0] == "ham", 0).otherwise(F.raise_error(F.concat(F.lit("unknown label "), part[0]))).alias("label"), unescape(part[1]).alias("text"))


@F.pandas_udf(T.StringType())
def unescape(s):
    import html

    return s.map(html.unescape, na_action="ignore")


def archive_members(archives: DataFrame):
    """path, content of tar, tgz or zip files -> (archive, member, data), one row a member."""

    def work(batches):
        import io
        import tarfile
        import zipfile

        import pandas as pd

        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                raw = io.BytesIO(bytes(content))
                if zipfile.is_zipfile(raw):
                    with zipfile.ZipFile(raw) as z:
                        members = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
                else:
                    raw.seek(0)
                    with tarfile.open(fileobj=raw) as t:
                        members = [(m.name, t.extractfile(m).read()) for m in t if m.isfile()]
                for name, data in members:
                    yield pd.DataFrame({"archive": [path], "member": [name], "data": [data]})

    return archives.select("path", "content").mapInPandas(work, "archive string, member string, data binary")


def labelled_mail(members: DataFrame) -> DataFrame:
    """Mail files whose path says spam or ham -> id, label, text."""
    spam = F.contains("member", F.lit("/spam/"))
    return members.select(F.col("member").alias("id"), F.when(spam, 1).otherwise(0).alias("label"), X.email_text()(F.col("data")).alias("text"))


def indexed_mail(index: DataFrame, members: DataFrame, fallback: str | None = None) -> DataFrame:
    """An index of lines `label path` joined to bodies; a line without its body fails the query. Adds the natural sort key."""
    part = F.split(F.trim("value"), r"\s+")
    rows = index.filter(F.length(F.trim("value")) > 0).select(F.lower(part[0]).alias("label"), F.regexp_extract(part[1], r"(data/.*)$", 1).alias("id"))
    joined = rows.join(members.select(F.regexp_extract("member", r"(data/.*)$", 1).alias("id"), "data"), "id", "left")
    body = F.when(F.col("data").isNotNull(), F.col("data")).otherwise(F.raise_error(F.concat(F.lit("no body for "), "id")).cast("binary"))
    return joined.select("id", (F.col("label") == "spam").cast("int").alias("label"), X.email_text(fallback=fallback)(body).alias("text"), natural_key(F.col("id")).alias("sort_key"))


def natural_key(s):
    """A text whose byte order is the natural order of `s`: each number, without zeros in front, follows its length."""
    parts = F.regexp_extract_all(s, F.lit(r"(\d+|\D+)"), 1)
    digits = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    number = lambda p: F.concat(F.lpad(F.length(digits(p)).cast("string"), 10, "0"), digits(p))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), number(p)).otherwise(p)), "")


def spam_corpus(rows: DataFrame, most_garbled: float = 0.01) -> DataFrame:
    """id, label, text, row_id -> without empty and garbled texts, and without copies and conflicts."""
    from tallygrid.operators.corpus import conflict_dedupe

    return conflict_dedupe(rows.filter((F.length("text") > 0) & (X.garbled(F.col("text")) <= most_garbled)))


def dump_table(lines: DataFrame, name: str, columns: str) -> DataFrame:
    """One table of a dump: other lines are dropped by their prefix before any is parsed. Columns come as strings and are cast."""
    mine = small_batches(lines).filter(F.startswith("value", F.lit(f"INSERT INTO `{name}` VALUES ")))
    schema = T.StructType.fromDDL(columns)
    loose = ", ".join(f"{f.name} string" for f in schema.fields)
    rows = mine.select("value").mapInPandas(X.dump_rows(loose), loose)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def cached(spark: SparkSession, folder: str, name: str, version: int, build) -> DataFrame:
    """A parsed corpus kept by name and parse version; built where it is missing."""
    path = f"{folder}/{name}-v{version}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# --- logs and exports --------------------------------------------------------------------------------------------------

EVENT = "event string, set string, id string, family string, type map<string,string>, k map<string,int>, scores map<string,struct<type:string,top1:boolean,metric:double,chance:double,conf:double,nll:double,brier:double,p_yes:double>>, error string, ms double, t double"


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """A panel's result log; blank lines are skipped."""
    return spark.read.schema(EVENT).json(path)


def export_panel(items: DataFrame, folder: str) -> DataFrame:
    """Items as JSON lines by set, and the manifest: set, items and an order-free digest of its lines. A repeated id is an error, raised before anything is written."""
    repeated = items.groupBy("set", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").head(1)
    if repeated:
        raise ValueError(f"item id {repeated[0]['id']} is repeated in {repeated[0]['set']}")
    rows = items.select("set", "id", F.to_json(F.struct(*[c for c in items.columns if c != "set"])).alias("value"))
    rows.select("set", "value").write.mode("overwrite").partitionBy("set").text(folder)
    # sums of line hashes: a partial aggregate, whatever a set's size
    parts = [F.sum(F.conv(F.substring(F.sha2("value", 256), k, 8), 16, 10).cast("decimal(38,0)")).cast("string") for k in (1, 9, 17, 25)]
    return rows.groupBy("set").agg(F.count(F.lit(1)).alias("items"), F.sha2(F.concat_ws("|", *parts), 256).alias("sha256"))


def without_torn_line(lines: DataFrame, schema: str, step: int) -> DataFrame:
    """A training log (line_no, value) rolled back: only its last line may be torn, and steps after `step` go."""
    rows = lines.withColumn("ok", F.get_json_object("value", "$.step").isNotNull() & F.from_json("value", schema, {"mode": "PERMISSIVE"}).isNotNull())
    last = lines.agg(F.max("line_no").alias("_last"))
    early = F.get_json_object("value", "$.step").cast("bigint") <= step
    # one condition: of two, the optimiser may skip the one that raises
    keep = F.when(F.col("ok") | (F.col("line_no") == F.col("_last")), F.col("ok") & early).otherwise(F.raise_error(F.concat(F.lit("unreadable line "), F.col("line_no").cast("string"))).cast("boolean"))
    return rows.join(F.broadcast(last)).filter(keep).select("line_no", "value")


def logged_request(requests: DataFrame) -> DataFrame:
    """Requests (ts, assets map<string,struct<format,data_base64>>, ...) with each asset's bytes replaced by their size and sha256, and the time as ISO-8601 UTC."""
    short = F.transform_values("assets", lambda _, a: F.struct(a["format"].alias("format"), F.octet_length(F.unbase64(a["data_base64"])).alias("bytes"), F.sha2(F.unbase64(a["data_base64"]), 256).alias("sha256")))
    return requests.withColumns({"assets": short, "ts": F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")})
