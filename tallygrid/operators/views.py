"""Views of stored questions: phrasing, masking, fallback rows, languages, row orders; variants of a menu and passes over a probe set; mixed batches."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions import menus as M
from tallygrid.operators.selection import dataset_parts, hash_first


def chance(rate: float, *key: Column) -> Column:
    """True with the given rate, by hash; 0 and 1 are never and always."""
    return F.lit(rate > 0) & (M.uniform(*key) < rate) if rate < 1 else F.lit(True)


def pick(xs: Column, *key: Column) -> Column:
    return F.get(xs, F.floor(M.uniform(*key) * F.size(xs)).cast("int"))


def item_view(items: DataFrame, seed: str, mask_rate: float, fallback_rate: float) -> DataFrame:
    """One view of each item: key, texts, langs (null or one a text), asks, rows, bare, fallback_row, fallback_bare, fallback_correct, gold, target, qtype,
    i18n map<string,struct<asks,rows,bare,fallback_row>>.

    In this order: whether the fallback row is appended, whether descriptions are masked, two phrasings, the phrasing's language, the question's wording, the row order. With
    the fallback row a question is a choice; if the fallback is right it is the hard answer."""
    u = lambda name: (F.lit(seed), F.lit(name), F.col("key"))
    add = F.col("fallback_row").isNotNull() & chance(fallback_rate, *u("fallback"))
    masked = F.col("bare").isNotNull() & chance(mask_rate, *u("mask"))
    order = M.hash_order(F.sequence(F.lit(0), F.size("texts") - 1), *u("text"))
    v = items.withColumns({"_add": add, "_masked": masked, "_order": order})
    lang = F.when(F.col("langs").isNotNull(), F.get("langs", F.get("_order", F.lit(0))))
    other = F.when(lang != "en", F.col("i18n")[lang])
    v = v.withColumn("_t", other)
    of = lambda name: F.coalesce(F.col(f"_t.{name}"), F.col(name))
    shown = F.when(F.col("_masked"), of("bare")).otherwise(of("rows"))
    extra = F.when(F.col("_masked"), F.coalesce(F.col("fallback_bare"), of("fallback_row"))).otherwise(of("fallback_row"))
    right = F.col("_add") & F.col("fallback_correct")
    v = v.withColumns({
        "query": F.get("texts", F.get("_order", F.lit(0))),
        "partner_query": F.when(F.size("texts") > 1, F.get("texts", F.get("_order", F.lit(1)))),
        "question": pick(of("asks"), *u("ask")),
        "names": F.when(F.col("_add"), F.array_append(shown, extra)).otherwise(shown),
        "gold_idx": F.when(right, F.size("rows")).otherwise(F.col("gold")).cast("int"),
        "target": F.when(~F.col("_add"), F.col("target")).when(~right & F.col("target").isNotNull(), F.array_append("target", F.lit(0.0))),
        "qtype": F.when(F.col("_add"), "choice").otherwise(F.col("qtype")),
    })
    v = v.withColumn("_rows", M.shuffled(F.size("names"), *u("rows")))
    menu = M.reorder({"options": F.sequence(F.lit(0), F.size("names") - 1), "names": F.col("names"), "gold_idx": F.col("gold_idx"), "target": F.col("target")}, F.col("_rows"))
    return v.select("key", "query", "partner_query", "question", "qtype", menu["options"].alias("options"), menu["names"].alias("option_names"), menu["gold_idx"].alias("gold_idx"), F.col("gold_idx").alias("label"), F.when(F.col("target").isNotNull(), menu["target"]).alias("target"))


def units(draws: DataFrame, fallback_rate: float, seed: str) -> DataFrame:
    """Of a unit's base and other version one is taken: draw_id, key, other (null without one) -> draw_id, key."""
    take = F.col("other").isNotNull() & chance(fallback_rate, F.lit(seed), F.lit("unit"), F.col("draw_id"))
    return draws.select("draw_id", F.when(take, F.col("other")).otherwise(F.col("key")).alias("key"))


def arranged(menus: DataFrame, rows: Column, codes: Column, variant: str) -> DataFrame:
    """Menus (key, options, gold_idx, q) with rows and codes set."""
    m = M.reorder({"options": F.col("options"), "gold_idx": F.col("gold_idx")}, F.col("_rows"))
    return menus.withColumn("_rows", rows).select("key", F.lit(variant).alias("variant"), m["options"].alias("options"), m["gold_idx"].alias("gold_idx"), codes.alias("codes"))


def variants(menus: DataFrame, seed: str, short: int = 10) -> DataFrame:
    """What an invariance check asks again: the same menu, two shufflings with new numbers, rows or codes alone changed, and short menus of random and of top rows."""
    k = F.size("options")
    plain, keep = F.sequence(F.lit(0), k - 1), lambda name: (F.lit(seed), F.lit(name), F.col("key"))
    few = lambda rows: F.sequence(F.lit(0), F.size(rows) - 1)
    random_, top = M.random_rows(k, F.col("gold_idx"), short, *keep("short")), M.top_rows(F.col("q"), F.col("gold_idx"), short)
    out = [
        arranged(menus, plain, plain, "repeat"),
        arranged(menus, M.shuffled(k, *keep("a")), plain, "renumbered_a"),
        arranged(menus, M.shuffled(k, *keep("b")), plain, "renumbered_b"),
        arranged(menus, M.shuffled(k, *keep("rows")), M.shuffled(k, *keep("rows")), "rows_only"),
        arranged(menus, plain, M.codes(k, *keep("codes")), "codes_only"),
        arranged(menus, random_, few(random_), "short_random"),
        arranged(menus, top, few(top), "short_top"),
    ]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def probe_passes(menus: DataFrame, size: int, passes: int, seed: str) -> DataFrame:
    """A fixed subset by hash, each question in `passes` arrangements of rows and codes. Menus need key, options, gold_idx."""
    some = hash_first(menus, "key", size).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    k, u = F.size("options"), (F.lit(seed), F.col("key"), F.col("pass"))
    some = some.withColumn("_rows", M.shuffled(k, *u, F.lit("rows")))
    m = M.reorder({"options": F.col("options"), "gold_idx": F.col("gold_idx")}, F.col("_rows"))
    return some.select("key", "pass", m["options"].alias("options"), m["gold_idx"].alias("gold_idx"), M.codes(k, *u, F.lit("codes")).alias("codes"))


def mixed_batch(parts: dict[str, DataFrame], n: int, step: int, seed: str, weights: dict[str, Fraction] | None = None) -> DataFrame:
    """One batch of n rows over samplers (key and shared columns): quotas by weight, each sampler's rows by this step's hash order, all shuffled by another."""
    names = list(parts)
    out = None
    for name, quota in zip(names, dataset_parts(n, names, weights), strict=True):
        order = F.sha2(F.concat_ws("|", F.lit(f"{seed}|{step}|{name}"), F.col("key").cast("string")), 256)
        rows = parts[name].orderBy(order).limit(quota).withColumn("sampler", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy(F.sha2(F.concat_ws("|", F.lit(f"{seed}|{step}|all"), "sampler", F.col("key").cast("string")), 256))


def with_partners(menus: DataFrame, seed: str) -> DataFrame:
    """Each question and, right after it, its partner in another row order (and the partner phrasing, where there is one): row_no 2i and 2i + 1."""
    rows = M.partner_rows(F.size("options"), F.lit(seed), F.col("row_no"))
    m = M.reorder({"options": F.col("options"), "gold_idx": F.col("gold_idx")}, F.col("_rows"))
    first = menus.select((F.col("row_no") * 2).alias("row_no"), "query", "options", "gold_idx")
    second = menus.withColumn("_rows", rows).select((F.col("row_no") * 2 + 1).alias("row_no"), F.coalesce("partner_query", "query").alias("query"), m["options"].alias("options"), m["gold_idx"].alias("gold_idx"))
    return first.unionByName(second)
