"""The evaluation panel: items, per-question scores, per-set summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions import menus as M
from tallygrid.operators import metrics


def items_from_labeled(rows: DataFrame, classes: DataFrame, set_name: str, instructions: Column) -> DataFrame:
    """(row_no, query, class_id) and (class_id, name) -> items with all names, in name order, as the menu. The menu is one row of at most 256 names."""
    if classes.limit(M.MOST_OPTIONS + 1).count() > M.MOST_OPTIONS:
        raise ValueError(f"more than {M.MOST_OPTIONS} names")
    menu = classes.agg(F.array_sort(F.collect_list("name")).alias("criteria"))
    named = rows.join(F.broadcast(classes), "class_id").join(F.broadcast(menu))
    return named.select(F.lit(set_name).alias("set"), F.format_string(f"{set_name}-%05d", "row_no").alias("id"), F.lit("choice").alias("type"), F.size("criteria").alias("k"), F.col("query").alias("state"), instructions.alias("instructions"), "criteria", F.col("name").alias("gold"))


def items_from_simple(rows: DataFrame) -> DataFrame:
    """id, qtype, context, question, options, answer -> items; a family is an id without its last part."""
    noul = F.col("qtype") == "bool"
    return rows.select(F.lit("simple").alias("set"), "id", F.regexp_extract("id", "^(.*)-[^-]*$", 1).alias("family"), F.when(noul, "noul").otherwise("choice").alias("type"), F.when(noul, 2).otherwise(F.size("options")).alias("k"), F.col("context").alias("state"), F.col("question").alias("instructions"), F.when(~noul, F.col("options")).alias("criteria"), F.get("options", F.col("answer")).alias("gold"))


def items_from_tasks(rows: DataFrame, set_name: str) -> DataFrame:
    """id, family, state, question struct<type, instructions, criteria array<string>>, expected."""
    k = F.when(F.col("question.type") == "noul", 2).otherwise(F.size("question.criteria"))
    return rows.select(F.lit(set_name).alias("set"), "id", "family", F.col("question.type").alias("type"), k.alias("k"), "state", F.col("question.instructions").alias("instructions"), F.col("question.criteria").alias("criteria"), F.col("expected").alias("gold"))


def score_questions(rows: DataFrame) -> DataFrame:
    """type, k, names, probs, gold_pos (by position; a yes/no question's positions are no, yes) -> top1, metric, chance, conf, nll, brier, p_yes.

    Probabilities are normalised by their sum (1 if it is 0). A choice counts 1 or 0; a yes/no question only outside the band; a score loses its distance."""
    p = M.let(M.total(F.col("probs")), lambda s: F.transform("probs", lambda x: x / F.when(s > 0, s).otherwise(1.0)))
    rows = rows.withColumn("_p", p)
    gold, yes = F.col("gold_pos"), F.get("probs", F.lit(1))
    noul, score = F.col("type") == "noul", F.col("type") == "score"
    decided = ((yes >= metrics.BAND[1]) & (gold == 1)) | ((yes <= metrics.BAND[0]) & (gold == 0))
    top1 = F.when(noul, (yes >= 0.5) == (gold == 1)).otherwise(M.top(F.col("probs")) == gold)
    return rows.withColumns({
        "top1": top1,
        "metric": F.when(noul, decided.cast("double")).when(score, 1 - F.abs(M.expectation(F.col("probs")) - gold) / (F.col("k") - 1)).otherwise(top1.cast("double")),
        "chance": F.when(noul, 0.5).when(~score, F.try_divide(F.lit(1.0), F.col("k"))),
        "conf": F.array_max("_p"),
        "nll": -F.ln(F.greatest(F.coalesce(F.get("_p", gold), F.lit(0.0)), F.lit(M.EPSILON))),
        "brier": M.squared_error(F.col("_p"), gold),
        "p_yes": F.when(noul, yes),
    }).drop("_p")


def score_or_fail(rows: DataFrame) -> DataFrame:
    """score_questions, but every question of a request that failed (error) counts wrong: in the denominators of its type, not in conf, nll and brier."""
    fine = F.col("error").isNull()
    out = score_questions(rows).withColumns({c: F.when(fine, F.col(c)) for c in ("conf", "nll", "brier", "p_yes")})
    chance = F.when(fine | (F.col("type") == "choice"), F.col("chance"))
    return out.withColumns({"top1": F.col("top1") & fine, "metric": F.when(fine, F.col("metric")).otherwise(0.0), "chance": chance})


def summarize(scored: DataFrame) -> DataFrame:
    """set, id, type, error and the columns of score_or_fail, a row a question -> a row a set."""
    kind = lambda t: F.col("type") == t
    a, c = F.avg(F.when(kind("choice"), F.col("metric"))), F.avg(F.when(kind("choice"), F.col("chance")))
    decisive = (F.col("p_yes") <= metrics.BAND[0]) | (F.col("p_yes") >= metrics.BAND[1])
    requests = scored.groupBy("set", "id").agg(F.max(F.col("error").isNotNull().cast("int")).alias("failed")).groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.sum("failed").alias("errors"))
    stats = scored.groupBy("set").agg(
        metrics.share(F.col("top1")).alias("top1"),
        F.try_divide(a - c, 1 - c).alias("choice"),
        F.avg(F.when(kind("noul"), F.col("metric"))).alias("noul"),
        F.avg(F.when(kind("score"), F.col("metric"))).alias("score"),
        *[F.count_if(kind(t)).alias(f"n_{t}") for t in ("choice", "noul", "score")],
        F.avg("conf").alias("conf"),
        F.avg("nll").alias("nll"),
        F.avg("brier").alias("brier"),
        F.try_divide(F.count_if(decisive), F.count("p_yes")).alias("noul_decisive"),
        F.avg(F.when(decisive, F.col("metric"))).alias("noul_decisive_acc"),
    )
    answered = scored.filter("conf is not null")
    return requests.join(stats, "set").join(metrics.ece(answered, F.col("conf"), F.col("top1"), ["set"]), "set", "left")


def answers(rows: DataFrame) -> DataFrame:
    """type, names, probs -> answer struct: a choice's first maximum, a yes/no question's P(yes), a score's expectation, and the confidence."""
    p = F.col("probs")
    return rows.withColumn("answer", F.struct(F.when(F.col("type") == "choice", F.get("names", M.top(p))).alias("choice"), F.when(F.col("type") == "noul", F.get(p, F.lit(1))).alias("noul"), F.when(F.col("type") == "score", M.expectation(p)).alias("score"), F.when(F.col("type") != "noul", M.confidence(p)).alias("confidence"), F.when(F.col("type") != "noul", F.map_from_arrays("names", "probs")).alias("probabilities")))


def bad_distributions(rows: DataFrame) -> DataFrame:
    """Rows whose probabilities aren't finite, in 0..1 and summing to 1 within 1e-4."""
    p = F.col("probs")
    return rows.filter(F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1)) | (F.abs(M.total(p) - 1) > 1e-4))
