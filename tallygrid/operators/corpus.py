"""Corpus operators: dedupe, merging, class dimensions, selections and counted rejections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conflict_dedupe(df: DataFrame, text: str = "text", label: str = "label", order: str = "row_id") -> DataFrame:
    """The first copy of each text; none of a text that has more than one label. One aggregate, then a semi join by row."""
    kept = df.groupBy(text).agg(F.min_by(order, order).alias("_first"), F.min(label).alias("_lo"), F.max(label).alias("_hi")).filter("_lo = _hi").select(F.col("_first").alias(order))
    return df.join(kept, order, "left_semi")


def merge_copies(posts: DataFrame) -> DataFrame:
    """(row_id, id, text, tag, sentiment) -> one row a text: ids in first-seen order, how many copies have each tag and each sentiment in -1..1. Empty texts drop out."""
    rows = posts.filter(F.length("text") > 0)
    ids = rows.groupBy("text").agg(F.min("row_id").alias("first_row"), F.transform(F.array_sort(F.collect_list(F.struct("row_id", "id"))), lambda s: s["id"]).alias("ids"))

    def counts(key: str, among: DataFrame) -> DataFrame:
        per = among.groupBy("text", key).agg(F.count(F.lit(1)).alias("n"))
        return per.groupBy("text").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(f"{key}s"))

    out = ids.join(counts("tag", rows), "text").join(counts("sentiment", rows.filter("sentiment between -1 and 1")), "text", "left")
    return out.withColumn("sentiments", F.coalesce("sentiments", F.create_map().cast("map<int,bigint>")))


def class_ids(labels: DataFrame, name: str = "name") -> DataFrame:
    """(class_id, name): ids are ranks of the distinct names in byte order. Names are a dimension; the rank runs over them alone."""
    return labels.select(F.col(name).alias("name")).filter("name is not null").distinct().withColumn("class_id", (F.dense_rank().over(Window.orderBy("name")) - 1).cast("int"))


def with_class(df: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    return df.join(classes.withColumnRenamed("name", name), name, "left")


def label_names(classes: DataFrame, descriptions: DataFrame) -> DataFrame:
    """`name: description` for all classes; a class without one fails the query."""
    joined = classes.join(descriptions, "name", "left")
    text = F.when(F.col("description").isNotNull(), F.concat_ws(": ", "name", "description")).otherwise(F.raise_error(F.concat(F.lit("no description for "), "name")))
    return joined.select("class_id", "name", text.alias("row"))


def drop_conflicting(df: DataFrame, keys: list[str], gold: str) -> tuple[DataFrame, DataFrame]:
    """Rows of groups with one gold, and the rows of groups with several (all of them are rejected). Two windows' worth of information by one aggregate
    and two joins, so a large group is no task's sort."""
    bad = df.groupBy(*keys).agg(F.min(gold).alias("_lo"), F.max(gold).alias("_hi")).filter("_lo <> _hi").drop("_lo", "_hi")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.alias("a").join(bad.alias("b"), on, "left_anti"), df.alias("a").join(bad.alias("b"), on, "left_semi")


def include(df: DataFrame, ids: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """An allow-list: what it names, and what it leaves out."""
    return df.join(ids, key, "left_semi"), df.join(ids, key, "left_anti")


def select_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows by a key list; a key without a row fails the query when it runs."""
    missing = keys.join(df, on, "left_anti").agg(F.count(F.lit(1)).alias("_missing"))
    checked = missing.select(F.when(F.col("_missing") > 0, F.raise_error(F.concat(F.col("_missing").cast("string"), F.lit(" selected keys have no row")))).otherwise(True).alias("_ok"))
    return df.join(keys, on, "left_semi").join(F.broadcast(checked)).filter("_ok").drop("_ok")


def last_done(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last `done` event of each key wins. A max of a struct: a partial aggregate, no window sort."""
    rest = [c for c in events.columns if c not in keys]
    body = F.struct(*order, *[c for c in rest if c not in order])
    last = events.filter("event = 'done'").groupBy(*keys).agg(F.max(F.struct(F.struct(*order).alias("o"), body.alias("b"))).alias("m"))
    return last.select(*keys, *[F.col(f"m.b.{c}").alias(c) for c in [*order, *[c for c in rest if c not in order]]]).select(*events.columns)


def todo(items: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Items without an answer; errors are tried again."""
    return items.join(results.filter("error is null"), keys, "left_anti")


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that fails, null if none does: the order decides which is counted."""
    out = None
    for condition, reason in checks:
        out = F.when(condition, F.lit(reason)) if out is None else out.when(condition, F.lit(reason))
    return out


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter("reason is null").drop("reason")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter("reason is not null").select("uid", "reason")


def skipped(rows: DataFrame) -> DataFrame:
    return rows.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def source_summary(rows: DataFrame) -> DataFrame:
    """Accepted rows by menu size."""
    return accepted(rows).groupBy(F.size("option_names").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def drop_categories(items: DataFrame, excluded: list[str], links: list[str]) -> DataFrame:
    """Items without an excluded category; links (columns that hold another item's key) to what is gone become null."""
    kept = items.filter(~F.arrays_overlap("categories", F.array(*map(F.lit, excluded)))) if excluded else items
    alive = kept.select(F.col("key").alias("_alive"))
    for link in links:
        kept = kept.join(alive, F.col(link) == F.col("_alive"), "left").withColumn(link, F.col("_alive")).drop("_alive")
    return kept


def link_contrasts(items: DataFrame) -> DataFrame:
    """Each edited item with the key of its source's item of the same question in the same domain, null if there is none."""
    source = items.select(F.col("domain").alias("_d"), F.col("context_id").alias("_c"), F.col("question_id").alias("_q"), F.col("key").alias("contrast"))
    return items.join(source, (F.col("domain") == F.col("_d")) & (F.col("contrast_of") == F.col("_c")) & (F.col("question_id") == F.col("_q")), "left").drop("_d", "_c", "_q")


def attach_traces(items: DataFrame, traces: DataFrame) -> DataFrame:
    """Traces (context_id, question_id, text_no, ask_no, trace) as a map by text and wording; unmatched ones are ignored."""
    per = traces.groupBy("context_id", "question_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("/", "text_no", "ask_no").alias("key"), "trace")))).alias("traces"))
    return items.join(per, ["context_id", "question_id"], "left")


def family(domain: Column, context_id: Column, known: list[str]) -> Column:
    """The tag of an id's first part without the domain, if it is a known family or an x-family; else base."""
    head = F.substring_index(context_id, "/", 1)
    tag = F.when(F.startswith(head, domain), F.regexp_replace(F.right(head, F.length(head) - F.length(domain)), "^_+|_+$", "")).otherwise(head)
    return F.when(tag.isin(known) | tag.rlike("^x[a-z]+$"), tag).otherwise("base")


def checksums(files: DataFrame) -> DataFrame:
    """(path, sha256) of a binaryFile table."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def checksum_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files that are missing, extra or changed; empty if all agree."""
    e, a = expected.select("path", F.col("sha256").alias("expected")), actual.select("path", F.col("sha256").alias("actual"))
    return e.join(a, "path", "full_outer").filter(~F.col("expected").eqNullSafe(F.col("actual"))).withColumn("problem", F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("changed"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Symmetric difference of two sets, with the side on which a row stands."""
    return a.subtract(b).withColumn("only_in", F.lit("left")).unionByName(b.subtract(a).withColumn("only_in", F.lit("right")))


def history(turns: DataFrame, by: str, order: str, fields: list[str]) -> DataFrame:
    """Each turn with all earlier turns of its conversation: one sorted array a conversation, sliced, instead of a window that copies a growing list for each row."""
    whole = turns.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("_all"))
    rows = whole.select(by, F.posexplode("_all").alias("_i", "_t"), "_all")
    return rows.select(by, F.col(f"_t.{order}").alias(order), *[F.col(f"_t.{f}").alias(f) for f in fields], F.when(F.col("_i") > 0, F.expr("slice(_all, 1, _i)")).otherwise(F.expr("slice(_all, 1, 0)")).alias("history"))
