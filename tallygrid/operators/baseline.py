"""Scores of a whole vocabulary, log-likelihood baselines, and samplers over item tables.

Scores by token id are an array column; a menu names its rows by slots, ids in that array. What is absent is null, and a null score has no
probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.functions import menus as M
from tallygrid.operators.selection import running_before

#: Denominators of a menu's log-probabilities.
DENOMINATORS = ("menu", "all-slots", "vocab")


def gathered(logits: Column, slots: Column) -> Column:
    """The score of each slot; null for a slot that is absent (null, negative or beyond the scores)."""
    return M.let(logits, lambda z: F.transform(slots, lambda s: F.when((s >= 0) & (s < F.size(z)), F.get(z, s.cast("int")))))


def menu_log_probs(logits: Column, slots: Column, codes: Column, denominator: str) -> Column:
    """Log-probability of each slot among the menu's slots, all codes, or the whole vocabulary. A slot that is no code fails the
    query where codes are the denominator."""
    if denominator not in DENOMINATORS:
        raise ValueError(f"unknown denominator {denominator!r}; one of {DENOMINATORS}")
    mine = gathered(logits, slots)
    if denominator == "menu":
        over = F.filter(mine, lambda x: x.isNotNull())
    elif denominator == "all-slots":
        strange = F.exists(slots, lambda s: (s >= 0) & ~F.array_contains(codes, s))
        over = F.when(F.coalesce(strange, F.lit(False)), F.raise_error(F.lit("a slot is not one of the codes")).cast("array<double>")).otherwise(gathered(logits, codes))
    else:
        over = logits
    return M.let(M.log_sum_exp(over), lambda bottom: F.transform(mine, lambda x: x - bottom))


def answer_mass(logits: Column, slots: Column, codes: Column) -> dict[str, Column]:
    """Over the softmax of the whole vocabulary: the mass on the menu's slots, on the other codes, and whether the first
    maximum is a slot."""
    share = lambda ids: M.let(M.softmax(logits), lambda p: M.total(F.filter(gathered(p, ids), lambda x: x.isNotNull())))
    return {"m_answer": share(slots), "m_offmenu": share(codes) - share(slots), "top1_in": F.array_contains(slots, M.top(logits).cast("bigint"))}


def token_score(log_probs: Column, how: str, terminator: bool) -> Column:
    """Sum or mean of a continuation's token log-probabilities up to the first null; without the terminator its last
    token doesn't count. A mean over no token is null."""
    if how not in ("sum", "avg"):
        raise ValueError(f"unknown aggregation {how!r}")

    def over(valid: Column) -> Column:
        counted = valid if terminator else F.slice(valid, 1, F.greatest(F.size(valid) - 1, F.lit(0)))
        return M.let(counted, lambda x: M.total(x) if how == "sum" else F.when(F.size(x) > 0, M.total(x) / F.size(x)))

    return M.let(F.filter(log_probs, lambda x: x.isNotNull()), over)


def rank_summary(scored: DataFrame, score: str = "z") -> DataFrame:
    """gold_rank_median (options with a better score than the gold one), n_ties_at_top, pred_max_class_frac (share of the position
    that is predicted most). Counts by rank and by position are partial sums; menus bound both."""
    s, gold = F.col(score), F.get(F.col(score), F.col("gold"))
    rows = scored.select(M.let(gold, lambda g: F.size(F.filter(s, lambda x: x > g))).alias("rank"), (F.size(F.filter(s, lambda x: x == F.array_max(s))) > 1).alias("tie"), M.top(s).alias("pred"))
    most = rows.groupBy("pred").agg(F.count(F.lit(1)).alias("c")).agg((F.max("c") / F.sum("c")).alias("pred_max_class_frac"))
    return rows.agg(F.median("rank").alias("gold_rank_median"), F.count_if("tie").alias("n_ties_at_top")).join(most)  # one row beside one row


def against_prior(scored: DataFrame, prior: DataFrame, score: str = "z") -> DataFrame:
    """Scores less the scores of an empty message, by position. prior: one row with the array `prior`, as long as a menu."""
    return scored.join(F.broadcast(prior)).withColumn(score, F.zip_with(score, "prior", lambda a, b: a - b)).drop("prior")


def across_orders(passes: DataFrame) -> DataFrame:
    """question, options, q of several row orders -> question, options in id order, log_q: the mean of log q over the orders."""
    each = passes.select("question", F.explode(F.arrays_zip("options", "q")).alias("o")).select("question", F.col("o.options").alias("option"), F.ln("o.q").alias("l"))
    mean = each.groupBy("question", "option").agg(F.avg("l").alias("l")).groupBy("question").agg(F.array_sort(F.collect_list(F.struct("option", "l"))).alias("o"))
    return mean.select("question", F.transform("o", lambda x: x["option"]).alias("options"), F.transform("o", lambda x: x["l"]).alias("log_q"))


# --- samplers ------------------------------------------------------------------------------------------------------------


def uniform(n: Column, *key: Column) -> Column:
    """A number of 0..n-1 from the sha256 of the key."""
    digits = F.substring(F.sha2(F.concat_ws("|", *[k.cast("string") for k in key]), 256), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint") % n


def numbered(items: DataFrame, key: str, by: str) -> DataFrame:
    """Items with `no`, their place from 0 in hash order within a group, and the group's size `of`; no task holds a whole group."""
    order = F.sha2(F.col(key).cast("string"), 256)
    placed = running_before(items, by, order, F.lit(1), "no")
    return placed.join(items.groupBy(by).agg(F.count(F.lit(1)).alias("of")), by)


def with_replacement(items: DataFrame, key: str, draws: DataFrame, seed: str) -> DataFrame:
    """draw_id -> a uniformly drawn item for each draw; items may come several times. No item for any draw if there are none."""
    all_ = numbered(items.withColumn("_all", F.lit("all")), key, "_all")
    size = items.agg(F.count(F.lit(1)).alias("_n")).filter("_n > 0")
    picked = draws.join(F.broadcast(size)).withColumn("no", uniform(F.col("_n"), F.lit(seed), F.col("draw_id"))).drop("_n")
    return picked.join(all_.drop("_all", "of"), "no").drop("no")


def balanced(items: DataFrame, key: str, domain: str, draws: DataFrame, seed: str) -> DataFrame:
    """draw_id -> first a domain, all alike likely whatever their sizes, then an item of it. Domains are a dimension."""
    domains = items.groupBy(domain).agg(F.count(F.lit(1)).alias("_of"))
    named = domains.agg(F.array_sort(F.collect_list(F.struct(F.col(domain).alias("d"), F.col("_of").alias("of")))).alias("_domains"))
    picked = draws.join(F.broadcast(named)).withColumn("_d", F.get("_domains", uniform(F.size("_domains"), F.lit(seed), F.lit("domain"), F.col("draw_id")).cast("int")))
    picked = picked.select("draw_id", F.col("_d.d").alias(domain), uniform(F.col("_d.of"), F.lit(seed), F.lit("item"), F.col("draw_id")).alias("no"))
    return picked.join(numbered(items, key, domain).drop("of"), [domain, "no"]).drop("no")


def domain_menus(rows: DataFrame, classes: DataFrame, k: Column, *key: Column) -> DataFrame:
    """rows (class_id, ...) with a menu of k classes (fewer if there are fewer) of the gold class's own domain. classes: class_id, domain."""
    pool = classes.groupBy("domain").agg(F.array_sort(F.collect_list("class_id")).alias("_pool"))
    joined = rows.join(classes, "class_id").join(pool, "domain")
    menu = joined.withColumn("options", M.compose_menu(F.col("class_id"), F.col("_pool"), k, *key)).drop("_pool")
    return menu.withColumn("gold_idx", M.position_of(F.col("options"), F.col("class_id")))


def class_split(classes: DataFrame, held_out: int, seed: str) -> DataFrame:
    """class_id -> held: the first classes by hash order are held out. Classes are a dimension; the rank runs over them alone."""
    order = Window.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col("class_id").cast("string")), 256))
    return classes.withColumn("held", F.row_number().over(order) <= held_out)


def of_classes(rows: DataFrame, classes: DataFrame, column: str = "class_id") -> DataFrame:
    """The rows of the named classes."""
    return rows.join(classes.select(F.col("class_id").alias(column)).distinct(), column, "left_semi")


def paired(rows: DataFrame, number: str) -> DataFrame:
    """Rows 2i and 2i+1 side by side: pair_no, a, b (structs). A row without its partner fails the query."""
    sides = F.struct(*rows.columns)
    half = F.col(number) % 2
    out = rows.groupBy(F.floor(F.col(number) / 2).alias("pair_no")).agg(F.max(F.when(half == 0, sides)).alias("a"), F.max(F.when(half == 1, sides)).alias("b"))
    return out.withColumn("b", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("b")).otherwise(F.raise_error(F.concat(F.lit("a row without its partner in pair "), F.col("pair_no").cast("string"))).cast(out.schema["b"].dataType)))


# --- costs -----------------------------------------------------------------------------------------------------------------


def score_levels(qtype: Column, options: Column) -> Column:
    """The levels of a score question's rows; null for other questions."""
    return F.when(qtype == "score", options)


def batch_cost(prefix: Column, suffix: Column, branches: Column, state_tokens: int, latent_steps: int = 0, trace: Column | None = None) -> Column:
    """Tokens that a row costs: its prefix, its branches with a state each, latent steps with one each, and with a trace
    (of more than no tokens) the teacher's branches again."""
    fan = suffix + branches * state_tokens
    cost = prefix + fan + latent_steps * (1 + state_tokens)
    return cost if trace is None else cost + F.when(trace > 0, trace + fan).otherwise(0)


def branch_limit(prefix: Column, width: Column, budget: Column) -> Column:
    """How many branches of a batch fit beside its longest prefix; one at least. More than one leave room for two copies of the prefix."""
    fits = F.greatest(F.lit(1), F.floor((budget - prefix) / width))
    copies = F.greatest(F.lit(1), F.floor(budget / F.nullif(prefix, F.lit(0))) - 2)
    return F.when((prefix > 0) & (fits > 1), F.least(fits, copies)).otherwise(fits).cast("bigint")


def shared_prefix(prefix: Column, branches: Column) -> Column:
    """struct(length, suffixes): the longest run of tokens that the prefix and all branches start with, one token at least left to
    each branch. A branch without tokens fails the query. Both arrays are bound once, so the work is in proportion to their tokens."""

    def split(p: Column, every: Column) -> Column:
        differs = lambda seq: F.transform(p, lambda x, i: F.when(~x.eqNullSafe(F.get(seq, i)), i))
        common = lambda seq: F.coalesce(F.array_min(differs(seq)), F.size(p))
        empty = F.exists(every, lambda seq: F.size(seq) == 0)
        length = F.when(empty, F.raise_error(F.lit("a branch without tokens")).cast("int")).otherwise(F.array_min(F.transform(every, lambda seq: F.least(common(seq), F.size(seq) - 1))))
        return M.let(length, lambda n: F.struct(n.alias("length"), F.transform(every, lambda seq: F.slice(seq, n + 1, F.size(seq))).alias("suffixes")))

    return M.let(prefix, lambda p: M.let(branches, lambda every: split(p, every)))
