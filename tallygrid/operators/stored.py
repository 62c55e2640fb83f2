"""What a run keeps to be held against later: selections with content sums, configurations by path, and links between the halves of a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of a configuration; a deeper one fails.
MOST_LEVELS = 32
#: So many brackets of a configuration are taken for its levels.
FEW_LEVELS = 8


# --- selections ------------------------------------------------------------------------------------------------------------


def content_sum(*columns: str) -> Column:
    """A digest of a row's values; nulls and the types that text shares (1 and '1' apart) count."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def build_selection(chosen: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """chosen as a selection: its keys and a content sum each. A key that is chosen twice fails the query."""
    rows = chosen.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.first(content_sum(*content)).alias("content_sha256"))
    once = F.when(F.col("_n") == 1, F.col("content_sha256")).otherwise(F.raise_error(F.concat(F.lit("chosen twice: "), F.concat_ws("/", *[F.col(k).cast("string") for k in key]))).cast("string"))
    return rows.select(*key, once.alias("content_sha256"))


def fingerprint(selection: DataFrame, key: list[str]) -> DataFrame:
    """items, sha256: one row for the whole selection, whatever the order of its rows. Sums of parts of row digests, so a partial aggregate."""
    row = F.sha2(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in key], "content_sha256"), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(row, k, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in (1, 9, 17, 25, 33, 41, 49, 57)]
    return selection.agg(F.count(F.lit(1)).alias("items"), F.sha2(F.concat_ws("|", *parts), 256).alias("sha256"))


def check_selection(stored: DataFrame, source: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """Each key of the stored selection that a later source doesn't bear out, and why: missing, changed, or repeated in the source. No rows: the selection holds."""
    held = stored.select(*key, F.col("content_sha256").alias("_was"))
    wanted = source.join(held.select(*key), key, "left_semi")
    now = wanted.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.first(content_sum(*content)).alias("_is"))
    joined = held.join(now, key, "left")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated").when(F.col("_is") != F.col("_was"), "changed")
    return joined.withColumn("problem", problem).filter("problem is not null").select(*key, "problem", F.col("_was").alias("stored_sha256"), F.when(F.col("_n") == 1, F.col("_is")).alias("current_sha256"))


def selection_drift(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Two selections key by key: added, gone, changed."""
    a, b = old.withColumnRenamed("content_sha256", "_a"), new.withColumnRenamed("content_sha256", "_b")
    fate = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "gone").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full").withColumn("drift", fate).filter("drift is not null").select(*key, "drift")


# --- configurations --------------------------------------------------------------------------------------------------------


def depth(config: Column) -> Column:
    """Levels of objects and lists in JSON text, from its brackets outside strings."""
    bare = F.regexp_replace(F.regexp_replace(config, r"\\.", ""), r'"[^"]*"|[^"\[\]{}]+', "")
    at = lambda s, c: s["at"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
    return F.aggregate(F.split(bare, ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), lambda s, c: F.struct(at(s, c).alias("at"), F.greatest(s["most"], at(s, c)).alias("most")), lambda s: s["most"])


def levels(configs: DataFrame, config: str) -> int:
    """Levels that hold every configuration. Opening brackets are counted, which costs little; only where they are more than FEW_LEVELS the depth is."""
    text = F.col(config)
    opened = 2 * F.octet_length(text) - F.octet_length(F.replace(text, F.lit("{"))) - F.octet_length(F.replace(text, F.lit("[")))
    most = configs.agg(F.max(F.when(opened <= FEW_LEVELS, opened).otherwise(depth(text)))).first()[0] or 0
    if most > MOST_LEVELS:
        raise ValueError(f"a configuration has more than {MOST_LEVELS} levels")
    return most


def at_or_below(path: str) -> Column:
    return (F.col("path") == path) | F.startswith("path", F.lit(f"{path}.")) | F.startswith("path", F.lit(f"{path}["))


def paths(configs: DataFrame, key: str, config: str) -> DataFrame:
    """(key, path, kind, value): a row a leaf of each configuration (JSON text), read as a variant and taken apart level by level in one pass. A path is $.name[0].name; an empty object or list is a leaf, and so is null.
    Broken JSON fails the query."""
    rows = configs.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.parse_json(config).alias("v"))
    # What has nothing to explode stays as it is, so a leaf may be met on every level.
    step = "CASE WHEN e.pos IS NULL THEN '' WHEN e.key IS NULL THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END"
    for _ in range(levels(configs, config)):
        rows = rows.sparkSession.sql(f"SELECT n.key, concat(n.path, {step}) AS path, CASE WHEN e.pos IS NULL THEN n.v ELSE e.value END AS v FROM {{rows}} n, LATERAL variant_explode_outer(n.v) e", rows=rows)
    kind = F.substring_index(F.substring_index(F.schema_of_variant("v"), "<", 1), "(", 1)
    return rows.filter("v is not null").select("key", "path", kind.alias("kind"), F.to_json("v").alias("value"))


def config_diff(old: DataFrame, new: DataFrame, key: str, config: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Two configurations of each key by path: added, missing, retyped or changed, with both values. What stands at or below an ignored path is left out. Numbers are equal as their JSON is, so 1 and 1.0 differ by kind."""
    a, b = paths(old, key, config), paths(new, key, config)
    for path in ignore:
        a, b = a.filter(~at_or_below(path)), b.filter(~at_or_below(path))
    a, b = a.withColumnsRenamed({"kind": "_ka", "value": "old"}), b.withColumnsRenamed({"kind": "_kb", "value": "new"})
    fate = F.when(F.col("_ka").isNull(), "added").when(F.col("_kb").isNull(), "missing").when(F.col("_ka") != F.col("_kb"), "retyped").when(F.col("old") != F.col("new"), "changed")
    rows = a.join(b, ["key", "path"], "full").withColumn("difference", fate).filter("difference is not null")
    return rows.select(F.col("key").alias(key), "path", "difference", "old", "new")


# --- pairs -----------------------------------------------------------------------------------------------------------------


def link_pairs(items: DataFrame, within: list[str], key: str = "key", other: str = "other_of") -> DataFrame:
    """items with `pair`: an item that names another as its other half and that one point at each other. A link stands under one key for both directions (the smaller name first), and every item may be in one link:
    a third member fails the query, and so does a half that is not there. Counts are partial sums, so an item that very many name is a row a task."""
    ends = F.array(F.struct(F.col(key).alias("_key"), F.col(other).alias("pair")), F.struct(F.col(other).alias("_key"), F.col(key).alias("pair")))
    places = [F.col(w).alias(f"_w{k}") for k, w in enumerate(within)]
    named = [f"_w{k}" for k in range(len(within))]
    links = items.filter(F.col(other).isNotNull()).select(*places, F.least(key, other).alias("_a"), F.greatest(key, other).alias("_b"), F.explode(ends).alias("e")).select(*named, "_a", "_b", "e._key", F.col("e.pair").alias("_pair")).distinct()
    sides = links.groupBy(*named, "_key").agg(F.count(F.lit(1)).alias("_n"), F.first("_pair").alias("_pair"))
    same = F.col(key) == F.col("_key")
    for w, side in zip(within, named, strict=True):
        same = same & F.col(w).eqNullSafe(F.col(side))
    joined = items.join(sides, same, "full")
    name = F.concat_ws("/", *[F.coalesce(w, side).cast("string") for w, side in zip(within, named, strict=True)], F.coalesce(key, "_key").cast("string"))
    wrong = F.when(F.col(key).isNull() & F.col("_key").isNotNull(), F.concat(F.lit("no such half: "), name)).when(F.col("_n") > 1, F.concat(F.lit("a third half: "), name)).when(F.col("_pair") == F.col("_key"), F.concat(F.lit("its own half: "), name))
    return joined.select(*items.columns, F.when(wrong.isNull(), F.col("_pair")).otherwise(F.raise_error(wrong).cast(items.schema[key].dataType)).alias("pair"))
