"""Evaluation metrics over scored menus.

A scored table has one row a question: `q` (probabilities by menu position) and `gold` (the right position). Per-question features are array expressions in
the projection, so each metric is one partial aggregate: a handful of sums leaves each task, whatever the size. Ratios without a denominator are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.functions import menus as M

#: The decisive band of a yes/no question, both ends inclusive, and the equal-width bins of a calibration error.
BAND, BINS = (0.2, 0.8), 10


def features(scored: DataFrame) -> DataFrame:
    """k, conf, pred, correct, p_gold, gold_rank, nll_row, brier_row beside the scored columns."""
    q, gold = F.col("q"), F.col("gold")
    out = scored.withColumns({"k": F.size(q), "conf": F.array_max(q), "pred": M.top(q), "p_gold": M.at(q, gold), "gold_rank": M.rank_of(q, gold), "brier_row": M.squared_error(q, gold)})
    return out.withColumns({"correct": F.col("pred") == gold, "nll_row": -F.ln(F.greatest(F.col("p_gold"), F.lit(M.EPSILON)))})


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def mean_where(x: Column, condition: Column) -> Column:
    return F.avg(F.when(condition, x))


def grouped(df: DataFrame, by: list[str]):
    return df.groupBy(*by) if by else df.groupBy()


def ece(df: DataFrame, conf: Column, correct: Column, by: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """Expected calibration error over equal-width bins; empty bins don't exist. Two levels: at most `bins` rows a group leave the first."""
    by = by or []
    bin_ = F.least(F.floor(conf * bins).cast("bigint"), F.lit(bins - 1))
    binned = df.withColumns({"_bin": bin_, "_conf": conf, "_hit": correct.cast("double")})
    per = binned.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("n"), F.sum("_conf").alias("s"), F.sum("_hit").alias("h"))
    return grouped(per, by).agg((F.sum(F.abs(F.col("s") - F.col("h"))) / F.sum("n")).alias("ece"))


def with_ece(stats: DataFrame, error: DataFrame, by: list[str]) -> DataFrame:
    return stats.join(error, by) if by else stats.join(error)


def topk_accuracy(f: DataFrame, k: int) -> DataFrame:
    return f.agg(share(F.col("gold_rank") <= k).alias("accuracy"))


def summarize(f: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    stats = grouped(f, by).agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("gold_rank") <= 1).alias("accuracy"),
        share(F.col("gold_rank") <= 5).alias("top5_accuracy"),
        F.avg("nll_row").alias("nll"),
        F.count_if(F.col("p_gold") < M.EPSILON).alias("n_saturated"),
        F.avg("brier_row").alias("brier"),
        F.avg("conf").alias("conf_mean"),
    )
    return with_ece(stats, ece(f, F.col("conf"), F.col("correct"), by), by)


def confidence_summary(f: DataFrame, by: list[str] | None = None) -> DataFrame:
    conf, ok = F.col("conf"), F.col("correct")
    return grouped(f, by or []).agg(F.avg(conf).alias("conf_mean"), (share(ok) - F.avg(conf)).alias("accuracy_minus_confidence"), mean_where(conf, ok).alias("conf_correct_mean"), mean_where(conf, ~ok).alias("conf_wrong_mean"))


def clipped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def choice_calibration(f: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    out = with_ece(confidence_summary(f, by), ece(f, F.col("conf"), F.col("correct"), by), by)
    return out.withColumn("calibration_score", clipped(100 * (1 - 2 * F.col("ece"))))


def noul_calibration(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Yes/no questions: `p` is P(yes), `y` 0 or 1. The calibration score is not cut, unlike a choice's."""
    by = by or []
    p, y = F.col("p"), F.col("y")
    ok = (p >= 0.5) == (y == 1)
    conf, decisive = F.greatest(p, 1 - p), (p >= BAND[1]) | (p <= BAND[0])
    rows = df.withColumns({"_ok": ok, "_conf": conf, "_decisive": decisive})
    hits = F.count_if(F.col("_ok") & F.col("_decisive"))
    stats = grouped(rows, by).agg(
        F.avg("_conf").alias("conf_mean"),
        (share(F.col("_ok")) - F.avg("_conf")).alias("accuracy_minus_confidence"),
        mean_where(F.col("_conf"), F.col("_ok")).alias("conf_correct_mean"),
        mean_where(F.col("_conf"), ~F.col("_ok")).alias("conf_wrong_mean"),
        share(F.col("_decisive")).alias("decisive_rate"),
        F.try_divide(hits, F.count_if("_decisive")).alias("decisive_accuracy"),
        (hits / F.count(F.lit(1))).alias("accuracy_with_abstentions_wrong"),
        F.avg(F.pow(p - y, F.lit(2.0))).alias("brier"),
    )
    out = with_ece(stats, ece(rows, F.col("_conf"), F.col("_ok"), by), by)
    part = (F.col("accuracy_with_abstentions_wrong") - 0.5) / 0.5
    return out.withColumns({"competence": 100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)), "calibration_score": 100 * (1 - 2 * F.col("ece"))})


def ordinal_features(scored: DataFrame) -> DataFrame:
    """nrps_row, covered, width of questions whose positions are levels from low to high."""
    q, gold, k = F.col("q"), F.col("gold"), F.size("q")
    out = scored.withColumn("_cdf", M.cumulative(q))
    scale = F.greatest(F.lit(1), k - 1)
    gap = F.transform(F.slice("_cdf", 1, F.greatest(k - 1, F.lit(0))), lambda p, i: F.pow(p - F.when(i >= gold, 1.0).otherwise(0.0), F.lit(2.0)))
    first = lambda least: F.coalesce(F.get(F.filter(F.transform("_cdf", lambda p, i: F.when(p >= least, i)), lambda i: i.isNotNull()), 0), k - 1)
    out = out.withColumns({"nrps_row": M.total(gap) / scale, "lo": first(0.05), "hi": first(0.95)})
    return out.withColumns({"covered": (F.col("lo") <= gold) & (gold <= F.col("hi")), "width": (F.col("hi") - F.col("lo")) / scale})


def score_calibration(f: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    rows = ordinal_features(f)
    stats = grouped(rows, by).agg(F.avg("nrps_row").alias("nrps"), share(F.col("covered")).alias("interval90_coverage"), F.avg("width").alias("interval90_width"))
    return with_ece(with_ece(confidence_summary(f, by), stats, by), ece(f, F.col("conf"), F.col("correct"), by), by)


def yes_position(pos_class: int | None = None) -> Column:
    """Where a yes/no question's yes stands: the given class, else the option named yes, else option 1."""
    if pos_class is not None:
        return M.position_of(F.col("options"), F.lit(pos_class))
    name = F.transform("option_names", lambda n: F.lower(F.trim(F.split_part(n, F.lit(":"), F.lit(1)))))
    return F.coalesce(M.position_of(name, F.lit("yes")), M.position_of(F.col("options"), F.lit(1)))


def calibration_summary(examples: DataFrame, pos_class: int | None = None) -> dict[str, DataFrame]:
    """Whole-set confidence and each question type's calibration. examples: q, gold, options, option_names, label, qtype."""
    f = features(examples)
    bools = f.filter("qtype = 'bool'").withColumn("_yes", yes_position(pos_class))
    bools = bools.select(F.get("q", F.col("_yes")).alias("p"), (F.col("label") == F.get("options", F.col("_yes"))).cast("int").alias("y"))
    level = F.array_sort(F.arrays_zip("options", "q"))
    scores = f.filter("qtype = 'score'").withColumn("_sorted", level)
    scores = scores.select(F.transform("_sorted", lambda s: s["q"]).alias("q"), M.position_of(F.transform("_sorted", lambda s: s["options"]), F.col("label")).alias("gold"))
    return {"all": confidence_summary(f), "choice": choice_calibration(f.filter("qtype = 'choice'")), "noul": noul_calibration(bools), "score": score_calibration(features(scores))}


def by_gold_slot(f: DataFrame, width: int = 10) -> DataFrame:
    bucket = F.floor(F.col("gold") / width).cast("int")
    out = f.withColumn("_b", bucket).groupBy("_b").agg(F.count(F.lit(1)).alias("n"), share(F.col("gold_rank") <= 1).alias("accuracy"), share(F.col("gold_rank") <= 5).alias("top5_accuracy"), F.avg("nll_row").alias("nll"), F.avg("conf").alias("conf_mean"))
    return out.withColumn("slots", F.concat((F.col("_b") * width).cast("string"), F.lit("-"), (F.col("_b") * width + width - 1).cast("string"))).drop("_b")


def decoy_columns() -> list[Column]:
    """Aggregates of questions with a decoy; `picked` is the option of the first maximum."""
    there, wrong = F.col("decoy").isNotNull(), F.col("decoy").isNotNull() & ~F.col("correct")
    on = F.count_if(there & (F.col("picked") == F.col("decoy")))
    return [
        F.count_if(there).alias("n_decoy"),
        F.try_divide(on, F.count_if(there)).alias("decoy_rate"),
        F.try_divide(on, F.count_if(wrong)).alias("decoy_of_errors"),
        F.avg(F.when(wrong, F.try_divide(F.lit(1.0), F.col("k") - 1))).alias("decoy_chance"),
    ]


def picked(f: DataFrame) -> DataFrame:
    return f.withColumn("picked", F.get("options", F.col("pred")))


def decoy_summary(f: DataFrame) -> DataFrame:
    return picked(f).agg(*decoy_columns())


def by_family(f: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Families in the order in which they first stand (first_row); null family is in none."""
    rows = picked(f.filter(F.col("family").isNotNull()))
    return rows.groupBy(*(by or []), "family").agg(F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("n"), share(F.col("correct")).alias("accuracy"), F.avg("nll_row").alias("nll"), F.avg("conf").alias("conf_mean"), *decoy_columns())


def pass_by_family(f: DataFrame) -> DataFrame:
    """Means over passes of each family's metrics, nulls left out; counts come from pass 0. f has a `pass` column."""
    per = by_family(f, ["pass"])
    means = [F.avg(c).alias(c) for c in ("accuracy", "nll", "conf_mean", "decoy_rate", "decoy_of_errors", "decoy_chance")]
    return per.groupBy("family").agg(F.max(F.when(F.col("pass") == 0, F.col("n"))).alias("n"), F.max(F.when(F.col("pass") == 0, F.col("n_decoy"))).alias("n_decoy"), *means)


def first_two_slots(f: DataFrame) -> DataFrame:
    return f.agg(share(F.col("pred") < 2).alias("pred_d01_rate"), share(F.col("gold") < 2).alias("gold_d01_rate"), F.avg(M.total(F.slice("q", 1, 2))).alias("q_d01_mean"))


def menu_size_summary(f: DataFrame) -> DataFrame:
    return f.agg(F.min("k").alias("k_min"), F.max("k").alias("k_max"), F.avg("k").alias("k_mean"))


def consistency(pairs: DataFrame) -> DataFrame:
    """Variant menus against base menus of the same questions, one row each: base_options, base_q, var_options, var_q, label. The base distribution is
    restricted to the variant's options. A variant that isn't a subset fails the query."""
    at_ = M.alignment(F.col("var_options"), F.col("base_options"))
    rows = pairs.withColumn("_at", at_)
    rows = rows.withColumn("_ok", F.when(~F.exists("_at", lambda i: i.isNull()), True).otherwise(F.raise_error(F.lit("a variant menu is not a subset of its base menu"))))
    rows = rows.filter("_ok").withColumn("_base", M.renormalize(M.taken(F.col("base_q"), F.col("_at"))))
    base_pick, var_pick = F.get("base_options", M.top(F.col("base_q"))), F.get("var_options", M.top(F.col("var_q")))
    where = M.position_of(F.col("var_options"), F.col("label"))
    log = lambda p: F.ln(F.greatest(F.get(p, where), F.lit(M.EPSILON)))
    rows = rows.withColumns({
        "_comparable": F.array_contains("var_options", base_pick),
        "_flip": base_pick != var_pick,
        "_tv": 0.5 * M.total(F.zip_with("var_q", "_base", lambda a, b: F.abs(a - b))),
        "_drift": F.abs(log(F.col("var_q")) - log(F.col("_base"))),
    })
    flips = F.count_if(F.col("_comparable") & F.col("_flip"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("_comparable").alias("n_comparable"), F.try_divide(flips, F.count_if("_comparable")).alias("flip_rate"), F.avg("_tv").alias("tv_mean"), F.avg("_drift").alias("gold_logp_drift"))


def pass_consistency(passes: DataFrame) -> DataFrame:
    """Arrangements of the same questions: question, pass, options, q, gold. Distributions meet by option id in a long form that is grouped by
    question and option; the passes of a question are few."""
    f = features(passes)
    n_pass = F.count(F.lit(1))
    per = f.withColumn("picked", F.get("options", F.col("pred"))).groupBy("question").agg(n_pass.alias("passes"), F.sum(F.col("correct").cast("int")).alias("hits"), (F.min("picked") == F.max("picked")).alias("agree"), F.avg(M.entropy(F.col("q"))).alias("mean_entropy"))
    long = passes.select("question", F.explode(F.arrays_zip("options", "q")).alias("o")).groupBy("question", F.col("o.options").alias("option")).agg(F.avg("o.q").alias("p"))
    mixed = long.groupBy("question").agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(0.0))).alias("entropy_of_mean"))
    rows = per.join(mixed, "question")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max("passes").alias("passes"), (F.sum("hits") / F.sum("passes")).alias("accuracy"), share(F.col("agree")).alias("agree"), F.avg(F.col("entropy_of_mean") - F.col("mean_entropy")).alias("js"))


def answer_mass_summary(df: DataFrame) -> DataFrame:
    """m_answer, m_offmenu, top1_in of each question. Percentiles interpolate linearly and are exact."""
    stats = df.agg(F.avg("m_answer").alias("m_answer_mean"), F.avg("m_offmenu").alias("m_offmenu_mean"), share(F.col("top1_in")).alias("top1_in_menu_rate"))
    counts = df.groupBy(F.col("m_answer").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    cuts = percentiles(counts, {"m_answer_p05": 0.05, "m_answer_p95": 0.95})
    return stats.join(cuts).select("m_answer_mean", "m_answer_p05", "m_answer_p95", "m_offmenu_mean", "top1_in_menu_rate")


def running(counts: DataFrame, amount: str, name: str = "before", parts: int = 32) -> DataFrame:
    """counts, a row a distinct value `s`, with the sum of `amount` over all smaller values.

    Values are dealt by ranges, and each range adds what the ranges below it sum to, so no task holds all values. The bounds are kept by the driver, so that a
    value's range is the same however often a task is run."""
    bounds = counts.agg(F.percentile_approx("s", [k / parts for k in range(1, parts)], 1000).alias("b")).first()["b"] or []
    ranged = counts.withColumn("_part", F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b < F.col("s"))) if bounds else F.lit(0))
    below = ranged.groupBy("_part").agg(F.sum(amount).alias("_n"))
    start = below.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # a row a range
    inner = Window.partitionBy("_part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("_in", F.coalesce(F.sum(amount).over(inner), F.lit(0))).join(start, "_part")
    return rows.withColumn(name, F.col("_start") + F.col("_in")).drop("_part", "_in", "_start")


def percentiles(counts: DataFrame, at_: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles of counted values (s, n), one column each; nulls are left out, and without a value all are null."""
    known = counts.filter(F.col("s").isNotNull())
    every = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_all"))
    rows = running(known, "n").join(F.broadcast(every))  # one row
    value = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col("s")))
    cuts = {}
    for name, p in at_.items():
        place = (F.col("_all") - 1) * F.lit(p)
        low, high, part = value(F.floor(place)), value(F.ceil(place)), F.max(place - F.floor(place))
        cuts[name] = low + (high - low) * part
    return rows.agg(*[c.alias(name) for name, c in cuts.items()])


def auroc(df: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """Mann-Whitney with ties at a half, null for one class. Scores are counted first; then a running sum over the distinct scores, by ranges."""
    return auroc_of(df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))


def auroc_of(counts: DataFrame) -> DataFrame:
    """The same from counted scores: s, pos, neg."""
    wins = F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2))
    return running(counts, "neg").agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auroc"))


def binary_summary(df: DataFrame) -> DataFrame:
    """p is P(pos), y whether the label is positive."""
    stats = df.agg(F.avg("p").alias("p_pos_mean"), share(F.col("p") >= 0.5).alias("pos_rate"), F.avg(F.col("y").cast("double")).alias("label_pos_rate"), F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("brier_binary"))
    return stats.join(auroc(df))


def position_mass(scored: DataFrame) -> DataFrame:
    return scored.select(F.posexplode("q").alias("pos", "p")).groupBy("pos").agg(F.avg("p").alias("mass"))


def pairwise_agreement(passes: DataFrame) -> DataFrame:
    """Unordered pairs of passes: how often they pick the same option, and the total variation. The passes of a question are few by construction."""
    rows = features(passes).select("question", "pass", "options", "q", F.get("options", F.col("pred")).alias("picked"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.question") == F.col("b.question")) & (F.col("a.pass") < F.col("b.pass")))
    other = M.taken(F.col("b.q"), M.alignment(F.col("a.options"), F.col("b.options")))
    tv = 0.5 * M.total(F.zip_with(F.col("a.q"), other, lambda x, y: F.abs(x - y)))
    return pairs.agg(share(F.col("a.picked") == F.col("b.picked")).alias("agreement"), F.avg(tv).alias("tv"))


def length_profile(f: DataFrame, lengths: DataFrame) -> DataFrame:
    """By length of an option's name: number of classes, share of labels, probability mass and share of predictions. lengths: (option, length), a dimension as
    large as a menu."""
    n = f.count()
    mass = f.select(F.posexplode("q").alias("option", "p")).groupBy("option").agg(F.sum("p").alias("m"))
    golds = f.groupBy(F.col("gold").alias("option")).agg(F.count(F.lit(1)).alias("g"))
    preds = f.groupBy(F.col("pred").alias("option")).agg(F.count(F.lit(1)).alias("r"))
    rows = lengths.join(mass, "option", "left").join(golds, "option", "left").join(preds, "option", "left")
    part = lambda c: (F.coalesce(F.sum(c), F.lit(0)) / F.lit(float(max(n, 1))))
    return rows.groupBy("length").agg(F.count(F.lit(1)).alias("classes"), part("g").alias("label_share"), part("m").alias("mass_share"), part("r").alias("pred_share"))


def prior_calibrated(scored: DataFrame) -> DataFrame:
    """Probabilities divided by their mean over the set and normalised again; the prior is one row of menu size."""
    prior = position_mass(scored).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mass"))), lambda s: s["mass"]).alias("prior"))
    rows = scored.join(F.broadcast(prior))  # one row, at most 256 numbers
    return rows.withColumn("q", M.renormalize(F.zip_with("q", "prior", lambda p, m: F.try_divide(p, m)))).drop("prior")


def fit_temperature(scores: DataFrame, lo: float = 0.05, hi: float = 20.0, points: int = 200, rounds: int = 60) -> float:
    """The temperature with the least NLL of (z, gold): a logarithmic grid in one scan, then ever finer grids around its best point, a scan each."""
    import math

    def losses(ts: list[float]) -> list[float]:
        # a narrow row for each temperature, summed before the shuffle to a group each; the logarithms cost more than these rows, and one aggregate of 200 columns was slower
        each = F.transform(F.array(*map(F.lit, ts)), lambda t: M.log_sum_exp(F.transform("z", lambda x: x / t)) - F.get("z", F.col("gold")) / t)
        found = scores.select(F.posexplode(each).alias("k", "l")).groupBy("k").agg(F.avg("l").alias("l")).collect()
        return [r.l for r in sorted(found)]

    grid = [math.exp(math.log(lo) + k * (math.log(hi) - math.log(lo)) / (points - 1)) for k in range(points)]
    found = losses(grid)
    best = min(range(points), key=found.__getitem__)
    a, b = math.log(grid[max(best - 1, 0)]), math.log(grid[min(best + 1, points - 1)])
    for _ in range(max(1, rounds // 12)):  # each scan narrows eightfold, more than four golden sections do
        xs = [a + (b - a) * k / 16 for k in range(17)]
        ls = losses([math.exp(x) for x in xs])
        k = min(range(17), key=ls.__getitem__)
        a, b = xs[max(k - 1, 0)], xs[min(k + 1, 16)]
    return math.exp((a + b) / 2)


def heldout_temperature(scores: DataFrame, folds: int = 2) -> DataFrame:
    """Each fold scaled by the temperature that the others fit: scores with a column `temperature`. Needs row_id."""
    rows = scores.withColumn("_fold", F.pmod("row_id", F.lit(folds)))
    fitted = [fit_temperature(rows.filter(F.col("_fold") != k)) for k in range(folds)]
    return rows.withColumn("temperature", F.element_at(F.array(*[F.lit(t) for t in fitted]), (F.col("_fold") + 1).cast("int"))).drop("_fold")


def menu_hits(rows: DataFrame) -> DataFrame:
    """Questions whose target isn't uniform, and how many picks tie its maximum. rows: q, target."""
    decided = F.array_max("target") - F.array_min("target") > 1e-6
    hit = F.get("target", M.top(F.col("q"))) >= F.array_max("target") - 1e-6
    return rows.agg(F.count_if(decided).alias("questions"), F.count_if(decided & hit).alias("hits"))


def target_cross_entropy(rows: DataFrame, eps: float = 0.0) -> DataFrame:
    """Mean cross entropy of menu log-probabilities (of z) and a smoothed target."""
    target = M.smoothed(F.col("target"), eps) if eps else F.col("target")
    return rows.agg(F.avg(M.cross_entropy(M.log_softmax(F.col("z")), target)).alias("loss"))


def pair_js(pairs: DataFrame) -> DataFrame:
    """Mean Jensen-Shannon divergence of two orders of the same question: a_options, a_q, b_options, b_q."""
    other = M.taken(F.col("b_q"), M.alignment(F.col("a_options"), F.col("b_options")))
    mean = F.zip_with("a_q", other, lambda x, y: (x + y) / 2)
    return pairs.agg(F.avg(M.entropy(mean) - (M.entropy(F.col("a_q")) + M.entropy(other)) / 2).alias("js"))


def contrast_margin(rows: DataFrame, margin: float) -> DataFrame:
    """Groups with exactly two gold options, both on every menu: softplus(margin - (mean over B of d - mean over A of d)), d = z_B - z_A, A the smaller
    gold. rows: group_id, gold, z (by option id)."""
    ends = rows.groupBy("group_id").agg(F.min("gold").alias("a"), F.max("gold").alias("b"), F.size(F.collect_set("gold")).alias("n")).filter("n = 2")
    d = F.get("z", F.col("b")) - F.get("z", F.col("a"))
    gaps = rows.join(ends, "group_id").withColumn("d", d).filter((F.col("gold") == F.col("a")) | (F.col("gold") == F.col("b"))).groupBy("group_id").agg((mean_where(F.col("d"), F.col("gold") == F.col("b")) - mean_where(F.col("d"), F.col("gold") == F.col("a"))).alias("gap"))
    x = F.lit(margin) - F.col("gap")
    return gaps.agg(F.count(F.lit(1)).alias("groups"), F.avg(F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))).alias("loss"))


def ordinal_emd(rows: DataFrame) -> DataFrame:
    """Sum over level questions of squared distribution gaps up to the last but one level, by all rows and by level rows. rows: qtype, q, target."""
    gap = F.zip_with(M.cumulative(F.col("q")), M.cumulative(F.col("target")), lambda a, b: F.pow(a - b, F.lit(2.0)))
    row = F.when(F.col("qtype") == "score", M.total(F.slice(gap, 1, F.size("q") - 1))).otherwise(0.0)
    return rows.agg((F.sum(row) / F.count(F.lit(1))).alias("loss"), F.try_divide(F.sum(row), F.count_if(F.col("qtype") == "score")).alias("per_score_row"))


def branch_ce(rows: DataFrame) -> DataFrame:
    """Two log-probabilities of each branch (lp1, lp2: wrong and right), its target and whether it counts: the mean loss of positive and of negative
    branches, halves of equal weight."""
    positive, valid = F.col("target") == 1, F.col("valid")
    loss = -F.when(positive, F.col("lp2")).otherwise(F.col("lp1"))
    halves = rows.agg(mean_where(loss, valid & positive).alias("pos"), mean_where(loss, valid & ~positive).alias("neg"))
    return halves.select("pos", "neg", ((F.coalesce("pos", F.lit(0.0)) + F.coalesce("neg", F.lit(0.0))) / 2).alias("loss"))


def scalars(df: DataFrame, prefix: str = "") -> DataFrame:
    """A row of nested numbers as (name, value), names joined by slashes, nulls left out."""
    from pyspark.sql import types as T

    def walk(schema: T.StructType, path: list[str]):
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, [*path, f.name])
            elif isinstance(f.dataType, (T.NumericType, T.BooleanType)):
                yield [*path, f.name]

    leaves = [F.struct(F.lit("/".join([prefix, *p] if prefix else p)).alias("name"), F.col(".".join(f"`{x}`" for x in p)).cast("double").alias("value")) for p in walk(df.schema, [])]
    return df.select(F.explode(F.array(*leaves)).alias("s")).select("s.name", "s.value").filter("value is not null")
