"""SQL dumps as tables: one pass over the lines types all tables that are wanted, and rows keep the order of the file.

A line's place is (file, block, place): the split that it was read from and its number there, counted by the task that reads the split. Places are ordered as the file is, survive any
join, and become dense numbers by offsets of blocks; no window is longer than a block, or than the list of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.functions import text as X
from tallygrid.written import written

PLACE = ["file", "block", "place"]


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, value): the lines of all files under path. Read in splits, as any text is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place = None, 0
        for b in batches:
            places = []
            for here in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), strict=True):
                block, place = (block, place + 1) if here == block else (here, 0)
                places.append(place)
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array(places, pa.int64()), b.column("value")], [*PLACE, "value"])

    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return rows.mapInArrow(count, "file string, block bigint, place bigint, value string")


def tables(lines: DataFrame, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The wanted tables of a dump, by name, each with its columns and the place of every row (file, block, place, row). Other statements are dropped by their first words; those of wanted tables are parsed in one
    pass and written once. A row with more or fewer values than its table has columns fails the query, and so does a value that its column can't hold."""
    head = {name: f"INSERT INTO `{name}` VALUES " for name in schemas}
    mine = F.lit(False)
    for words in head.values():
        mine = mine | F.startswith("value", F.lit(words))
    kinds = {name: T.StructType.fromDDL(ddl) for name, ddl in schemas.items()}
    widths = {name: len(kind) for name, kind in kinds.items()}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for file, block, place, line in zip(*(b.column(c).to_pylist() for c in (*PLACE, "value")), strict=True):
                name = line[len("INSERT INTO `") : line.index("`", len("INSERT INTO `"))]
                for k, values in enumerate(X.insert_rows(line)):
                    if len(values) != widths[name]:
                        raise ValueError(f"a row of {name} has {len(values)} values, not {widths[name]}")
                    out.append((file, block, place, k, name, [None if v is None else str(v) for v in values]))
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string())), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [*PLACE, "row", "_table", "_values"])

    rows = written(lines.filter(mine).select(*PLACE, "value").mapInArrow(parse, "file string, block bigint, place bigint, row int, _table string, _values array<string>"))
    return {name: rows.filter(F.col("_table") == name).select(*PLACE, "row", *[F.col("_values")[k].cast(f.dataType).alias(f.name) for k, f in enumerate(kind.fields)]) for name, kind in kinds.items()}


def numbered(rows: DataFrame, name: str = "order_no") -> DataFrame:
    """rows of a dump with dense numbers from 0 in the order of the file."""
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy("file", "block")  # a row a block
    starts = blocks.select(F.col("file").alias("_file"), F.col("block").alias("_block"), (F.sum("_n").over(order) - F.col("_n")).alias("_start"))
    inner = F.row_number().over(Window.partitionBy("file", "block").orderBy("place", "row")) - 1
    placed = rows.withColumn("_in", inner).join(starts, F.col("file").eqNullSafe(F.col("_file")) & F.col("block").eqNullSafe(F.col("_block")))
    return placed.withColumn(name, F.col("_start") + F.col("_in")).drop("_in", "_file", "_block", "_start")


def annotated_posts(annotations: DataFrame, posts: DataFrame, limit: int = 2000) -> DataFrame:
    """(order_no, id, label, text) in the annotation table's order. annotations: post_id, label and their place; posts: id, body. A post that is annotated and missing fails the query."""
    body = posts.select(F.col("id").alias("_id"), "body", F.lit(True).alias("_there"))
    joined = numbered(annotations).join(body, F.col("post_id") == F.col("_id"), "left")
    text = F.when(F.col("_there"), X.tidy(X.cut(X.tidy(F.coalesce("body", F.lit(""))), limit))).otherwise(F.raise_error(F.concat(F.lit("no post "), F.col("post_id").cast("string"))).cast("string"))
    return joined.select("order_no", F.col("post_id").cast("string").alias("id"), F.col("label").cast("int").alias("label"), text.alias("text"))


def int_keys(m: Column) -> Column:
    """A map whose keys became strings on their way through JSON, with whole numbers as keys again; another key fails the query."""
    return F.transform_keys(m, lambda k, _: k.cast("int"))


def tagged_corpus(posts: DataFrame, tags: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged posts (text, ids, tags, sentiments; maps by number) and the tags (id, name, group_id, group). posts: id, message, caption, tag, sentiment and their place; tags: id, name, group_id; groups: id, name."""
    from tallygrid.operators.corpus import merge_copies

    short = written(posts.select(*PLACE, "row", "id", X.post_text(F.col("message"), F.col("caption")).alias("text"), "tag", "sentiment"))
    rows = written(numbered(short, "row_id").select("row_id", "id", "text", "tag", "sentiment"))  # read several times: tidied once, cut before it is sorted
    named = tags.select("id", "name", "group_id").join(groups.select(F.col("id").alias("group_id"), F.col("name").alias("group")), "group_id", "left")
    return merge_copies(rows), named.select("id", "name", "group_id", "group")


def corpus_json(merged: DataFrame) -> DataFrame:
    """Merged posts as lines of JSON, as a cache keeps them."""
    return merged.select(F.to_json(F.struct("text", "ids", "tags", "sentiments")).alias("value"))


def corpus_from_json(lines: DataFrame) -> DataFrame:
    """The same posts from their lines, numbers as keys again."""
    kind = "text string, ids array<bigint>, tags map<string,bigint>, sentiments map<string,bigint>"
    read = lines.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("p"))
    return read.select("p.text", "p.ids", int_keys(F.col("p.tags")).alias("tags"), int_keys(F.col("p.sentiments")).alias("sentiments"))
