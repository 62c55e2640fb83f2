"""Whole evaluations: every family of metrics from one scan of the scored questions.

A question's features are expressions in the scan. One aggregate over grouping sets takes them all in: cells by (pass, family, slot, question type, confidence bins), which add up to
every sum, share and calibration error; distinct scores of the positive class, for the AUROC; distinct answer masses, for percentiles. What leaves a
task is a row a cell and a row a distinct value. These cells are written once, and a record is made from them alone.

Examples have a row a question: q, gold, options, label; and qtype (choice, bool, score), option_names, family, decoy, vocab_ce, m_answer, m_offmenu, top1_in, each of which may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions import menus as M
from tallygrid.operators import metrics as E
from tallygrid.written import written

#: Positions of a slot group.
SLOTS = 10
_KEYS = ["pass", "family", "slot", "qtype", "bin", "type_bin"]


def _bin(conf: Column) -> Column:
    return F.least(F.floor(conf * E.BINS).cast("int"), F.lit(E.BINS - 1))


def questions(examples: DataFrame, pos_class: int | None = None, slots: int = SLOTS) -> DataFrame:
    """Features of each question, those of its type among them (type_conf, type_ok; decisive, p_error; nrps_row, covered, width)."""
    f = E.picked(E.features(examples))
    bool_, score = F.col("qtype") == "bool", F.col("qtype") == "score"
    f = f.withColumn("_yes", F.when(bool_, E.yes_position(pos_class)))
    f = f.withColumns({"_p": F.get("q", F.col("_yes")), "_y": (F.col("label") == F.get("options", F.col("_yes"))).cast("int")})
    # levels from low to high
    f = f.withColumn("_sorted", F.when(score, F.array_sort(F.arrays_zip("options", "q"))))
    levels = {"q": F.transform("_sorted", lambda s: s["q"]), "gold": M.position_of(F.transform("_sorted", lambda s: s["options"]), F.col("label"))}
    f = f.withColumnsRenamed({"q": "_q", "gold": "_gold"}).withColumns(levels)
    f = E.ordinal_features(f).withColumn("_level_ok", M.top(F.col("q")) == F.col("gold")).drop("q", "gold").withColumnsRenamed({"_q": "q", "_gold": "gold"})
    p, conf = F.col("_p"), F.col("conf")
    f = f.withColumns({
        "type_conf": F.when(bool_, F.greatest(p, 1 - p)).otherwise(conf),
        "type_ok": F.when(bool_, (p >= 0.5) == (F.col("_y") == 1)).when(score, F.col("_level_ok")).otherwise(F.col("correct")),
        "decisive": (p >= E.BAND[1]) | (p <= E.BAND[0]),
        "p_error": F.pow(p - F.col("_y"), F.lit(2.0)),
        "first_two": M.total(F.slice("q", 1, 2)),
    })
    if pos_class is not None:
        f = f.withColumns({"p_pos": F.get("q", M.position_of(F.col("options"), F.lit(pos_class))), "is_pos": F.col("label") == pos_class})
    return f.withColumns({"slot": F.floor(F.col("gold") / slots).cast("int"), "bin": _bin(conf), "type_bin": _bin(F.col("type_conf"))})


def _sums(binary: bool) -> list[Column]:
    ok, wrong, decoy = F.col("correct"), ~F.col("correct"), F.col("decoy").isNotNull()
    count, total = lambda c, name: F.count_if(c).alias(name), lambda c, name: F.sum(c).alias(name)
    out = [
        F.count(F.lit(1)).alias("n"), count(F.col("gold_rank") <= 1, "hits"), count(F.col("gold_rank") <= 5, "hits5"), count(F.col("p_gold") < M.EPSILON, "saturated"), total("nll_row", "nll"), total("brier_row", "brier"),
        total("conf", "conf"), count(ok, "ok"), total(F.when(ok, F.col("conf")), "conf_ok"), total(F.when(wrong, F.col("conf")), "conf_wrong"),
        count(F.col("pred") < 2, "pred01"), count(F.col("gold") < 2, "gold01"), total("first_two", "q01"), F.min("k").alias("k_min"), F.max("k").alias("k_max"), total("k", "k"),
        total("vocab_ce", "vocab_ce"), F.count("vocab_ce").alias("vocab_n"), total("m_answer", "m_answer"), total("m_offmenu", "m_offmenu"), F.count("m_answer").alias("mass_n"), count("top1_in", "top1_in"),
        count(decoy, "n_decoy"), count(decoy & (F.col("picked") == F.col("decoy")), "on_decoy"), count(decoy & wrong, "decoy_wrong"), total(F.when(decoy & wrong, F.try_divide(F.lit(1.0), F.col("k") - 1)), "decoy_chance"),
        total("type_conf", "type_conf"), count("type_ok", "type_ok"), total(F.when(F.col("type_ok"), F.col("type_conf")), "type_conf_ok"), total(F.when(~F.col("type_ok"), F.col("type_conf")), "type_conf_wrong"), count(~F.col("type_ok"), "type_wrong"),
        count("decisive", "decisive"), count(F.col("decisive") & F.col("type_ok"), "decisive_ok"), total("p_error", "p_error"), total("nrps_row", "nrps"), count("covered", "covered"), total("width", "width"), F.min("row_id").alias("first_row"),
    ]
    if binary:
        p, y = F.col("p_pos"), F.col("is_pos")
        out += [total(p, "p_pos"), count(p >= 0.5, "pos_rate"), count(y, "is_pos"), total(F.pow(p - y.cast("double"), F.lit(2.0)), "pos_error"), count(~y, "is_neg")]
    return out


def cells(features: DataFrame) -> DataFrame:
    """The written cells of questions(): `kind` 0 with sums by _KEYS, 1 by `mass`, 2 by `score`."""
    binary = "p_pos" in features.columns
    f = features if "pass" in features.columns else features.withColumn("pass", F.lit(0))
    f = f.withColumns({"mass": F.col("m_answer"), "score": F.col("p_pos") if binary else F.lit(None).cast("double")})
    keys = [*_KEYS, "mass", "score"]
    sets = [[F.col(k) for k in s] for s in (_KEYS, ["mass"], *([["score"]] if binary else []))]
    kind = F.when(F.grouping("pass") == 0, 0).when(F.grouping("mass") == 0, 1).otherwise(2)
    return written(f.groupingSets(sets, *keys).agg(kind.alias("kind"), *_sums(binary)))


def _ratio(a: str, b: str) -> Column:
    return F.try_divide(F.col(a), F.col(b))


def _decoy() -> list[Column]:
    return [F.col("n_decoy"), _ratio("on_decoy", "n_decoy").alias("decoy_rate"), _ratio("on_decoy", "decoy_wrong").alias("decoy_of_errors"), _ratio("decoy_chance", "decoy_wrong").alias("decoy_chance")]


def _confidence(conf: str, ok: str, wrong: str, conf_ok: str, conf_wrong: str) -> list[Column]:
    return [_ratio(conf, "n").alias("conf_mean"), ((F.col(ok) - F.col(conf)) / F.col("n")).alias("accuracy_minus_confidence"), _ratio(conf_ok, ok).alias("conf_correct_mean"), _ratio(conf_wrong, wrong).alias("conf_wrong_mean")]


def _totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Cells added up; the names stay."""
    ends = {"k_min": F.min, "k_max": F.max, "first_row": F.min}
    return E.grouped(rows, by).agg(*[ends.get(c, F.sum)(c).alias(c) for c in rows.columns if c not in (*_KEYS, "mass", "score", "kind")])


def _error(rows: DataFrame, by: list[str], bin_: str, conf: str, ok: str) -> DataFrame:
    """Expected calibration errors from bins of cells."""
    per = rows.groupBy(*by, bin_).agg(F.sum("n").alias("n"), F.abs(F.sum(conf) - F.sum(ok)).alias("gap"))
    return E.grouped(per, by).agg((F.sum("gap") / F.sum("n")).alias("ece"))


def _named(rows: DataFrame, prefix: Column | str, columns: list[Column]) -> DataFrame:
    """(name, value), a row a number, nulls left out."""
    at = F.lit(prefix) if isinstance(prefix, str) else prefix
    values = rows.select(at.alias("_at"), *columns)
    pairs = F.array(*[F.struct(F.concat("_at", F.lit(c)).alias("name"), F.col(c).cast("double").alias("value")) for c in values.columns[1:]])
    return values.select(F.explode(pairs).alias("s")).select("s.name", "s.value").filter("value is not null")


def _calibration(main: DataFrame) -> DataFrame:
    """calib/..., and calib/choice/..., calib/noul/..., calib/score/... for the types that there are."""
    every = _totals(main, [])
    every = every.withColumn("wrong", F.col("n") - F.col("ok"))
    out = _named(every.filter("n > 0"), "calib/", _confidence("conf", "ok", "wrong", "conf_ok", "conf_wrong"))
    typed = main.filter(F.col("qtype").isin("choice", "bool", "score"))
    per = _totals(typed, ["qtype"]).join(_error(typed, ["qtype"], "type_bin", "type_conf", "type_ok"), "qtype")
    noul, score = F.col("qtype") == "bool", F.col("qtype") == "score"
    with_abstentions = F.col("decisive_ok") / F.col("n")
    only = lambda cond, c, name: F.when(cond, c).alias(name)
    plain = 100 * (1 - 2 * F.col("ece"))
    columns = [
        *_confidence("type_conf", "type_ok", "type_wrong", "type_conf_ok", "type_conf_wrong"), F.col("ece"), F.when(noul, plain).when(~score, E.clipped(plain)).alias("calibration_score"),
        only(noul, _ratio("decisive", "n"), "decisive_rate"), only(noul, _ratio("decisive_ok", "decisive"), "decisive_accuracy"), only(noul, with_abstentions, "accuracy_with_abstentions_wrong"),
        only(noul, F.col("p_error") / F.col("n"), "brier"), only(noul, 100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (with_abstentions - 0.5) / 0.5)), "competence"),
        only(score, F.col("nrps") / F.col("n"), "nrps"), only(score, F.col("covered") / F.col("n"), "interval90_coverage"), only(score, F.col("width") / F.col("n"), "interval90_width"),
    ]
    return out.unionByName(_named(per, F.concat(F.lit("calib/"), F.when(noul, "noul").otherwise(F.col("qtype")), F.lit("/")), columns))


def evaluate(examples: DataFrame, pos_class: int | None = None, slots: int = SLOTS) -> DataFrame:
    """The record of a set as (name, value), nulls left out: n, accuracy and what summarize() has; vocab_ce; answer mass and its percentiles; menu sizes; first slots; decoys; by_gold_slot/A-B/..., by_family/F/...;
    calib/...; with `pos_class` also auroc, pos_rate, p_pos_mean, label_pos_rate, brier_binary. An empty set has no rows but n."""
    made = cells(questions(examples, pos_class, slots))
    main = made.filter("kind = 0")
    n = lambda a: _ratio(a, "n").alias(a)
    every = _totals(main, []).join(_error(main, [], "bin", "conf", "ok")).withColumn("n", F.coalesce("n", F.lit(0)))
    columns = [
        F.col("n"), _ratio("hits", "n").alias("accuracy"), _ratio("hits5", "n").alias("top5_accuracy"), n("nll"), F.col("saturated").alias("n_saturated"), n("brier"), _ratio("conf", "n").alias("conf_mean"), F.col("ece"),
        _ratio("vocab_ce", "vocab_n").alias("vocab_ce"), _ratio("m_answer", "mass_n").alias("m_answer_mean"), _ratio("m_offmenu", "mass_n").alias("m_offmenu_mean"), _ratio("top1_in", "mass_n").alias("top1_in_menu_rate"),
        F.col("k_min"), F.col("k_max"), _ratio("k", "n").alias("k_mean"), _ratio("pred01", "n").alias("pred_d01_rate"), _ratio("gold01", "n").alias("gold_d01_rate"), _ratio("q01", "n").alias("q_d01_mean"),
        *[F.when(F.col("n_decoy") > 0, c).alias(name) for c, name in zip(_decoy(), ("n_decoy", "decoy_rate", "decoy_of_errors", "decoy_chance"), strict=True)],
    ]
    if pos_class is not None:
        columns += [_ratio("p_pos", "n").alias("p_pos_mean"), n("pos_rate"), _ratio("is_pos", "n").alias("label_pos_rate"), _ratio("pos_error", "n").alias("brier_binary")]
    out = _named(every, "", columns)
    mass = E.percentiles(made.filter("kind = 1").select(F.col("mass").alias("s"), "n"), {"m_answer_p05": 0.05, "m_answer_p95": 0.95})
    out = out.unionByName(_named(mass, "", [F.col("m_answer_p05"), F.col("m_answer_p95")]))
    if pos_class is not None:
        scores = made.filter("kind = 2").select(F.col("score").alias("s"), F.col("is_pos").alias("pos"), F.col("is_neg").alias("neg"))
        out = out.unionByName(_named(E.auroc_of(scores), "", [F.col("auroc")]))
    span = F.concat(F.lit("by_gold_slot/"), (F.col("slot") * slots).cast("string"), F.lit("-"), (F.col("slot") * slots + slots - 1).cast("string"), F.lit("/"))
    per_slot = _totals(main.filter("slot is not null"), ["slot"])
    out = out.unionByName(_named(per_slot, span, [F.col("n"), _ratio("hits", "n").alias("accuracy"), _ratio("hits5", "n").alias("top5_accuracy"), n("nll"), _ratio("conf", "n").alias("conf_mean")]))
    per_family = _totals(main.filter("family is not null"), ["family"])
    out = out.unionByName(_named(per_family, _family_name(), [F.col("n"), _ratio("ok", "n").alias("accuracy"), n("nll"), _ratio("conf", "n").alias("conf_mean"), *_decoy()]))
    return out.unionByName(_calibration(main))


def _family_name() -> Column:
    return F.concat(F.lit("by_family/"), F.col("family"), F.lit("/"))


def consistency_evaluate(passes: DataFrame, pos_class: int | None = None, slots: int = SLOTS) -> DataFrame:
    """The record of several arrangements of the same questions: n, passes, accuracy, agree, js; families and decoys as means over passes (counts of pass 0);
    calib/... over all passes as repeated observations. passes: question, pass and what examples have.

    Passes of a question are few, so a question gathers them in an array; that is the one shuffle of the rows."""
    kept = [c for c in passes.columns if c != "question"]
    joined = passes.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("pass", *[c for c in kept if c != "pass"]))).alias("runs"))
    picks = F.transform("runs", lambda r: F.get(r["options"], M.top(r["q"])))
    joined = joined.withColumns({"agree": F.array_min(picks) == F.array_max(picks), "js": _divergence(F.col("runs"))})
    # a question's own numbers stand on its first row
    rows = joined.select("agree", "js", F.posexplode("runs").alias("_k", "r")).select("r.*", *[F.when(F.col("_k") == 0, F.col(c)).alias(c) for c in ("agree", "js")], F.when(F.col("_k") == 0, 1).alias("_one"))
    made = _with_questions(questions(rows, pos_class, slots))
    every = _totals(made, [])
    out = _named(every, "", [F.coalesce("questions", F.lit(0)).alias("n"), _ratio("n", "questions").alias("passes"), _ratio("ok", "n").alias("accuracy"), _ratio("agreed", "questions").alias("agree"), _ratio("divergence", "questions").alias("js")])
    return out.unionByName(_over_passes(made.filter("family is not null"), ["family"], _family_name(), ["n", "accuracy", "nll", "conf_mean"])).unionByName(_over_passes(made, [], F.lit(""), [])).unionByName(_calibration(made.drop("questions", "agreed", "divergence")))


def _with_questions(f: DataFrame) -> DataFrame:
    own = [F.sum("_one").alias("questions"), F.count_if("agree").alias("agreed"), F.sum("js").alias("divergence")]
    return written(f.groupBy(*_KEYS).agg(*_sums("p_pos" in f.columns), *own))


def _over_passes(rows: DataFrame, by: list[str], prefix: Column, plain: list[str]) -> DataFrame:
    """Each pass's numbers averaged over the passes that have them; counts are those of pass 0."""
    per = _totals(rows, ["pass", *by]).select("pass", *by, F.col("n"), _ratio("ok", "n").alias("accuracy"), _ratio("nll", "n").alias("nll"), _ratio("conf", "n").alias("conf_mean"), *_decoy())
    first = lambda c: F.max(F.when(F.col("pass") == 0, F.col(c))).alias(c)
    names = [*plain, "n_decoy", "decoy_rate", "decoy_of_errors", "decoy_chance"]
    joined = E.grouped(per, by).agg(*[first(c) if c in ("n", "n_decoy") else F.avg(c).alias(c) for c in names])
    there = joined if by else joined.filter("n_decoy > 0")
    return _named(there, prefix, [F.col(c) for c in names])


def _divergence(runs: Column) -> Column:
    """Jensen-Shannon of a question's distributions: the entropy of their mean less the mean of their entropies. An option's probabilities meet by its id."""
    options = F.array_distinct(F.flatten(F.transform(runs, lambda r: r["options"])))
    of = lambda o: F.filter(F.transform(runs, lambda r: F.get(r["q"], M.position_of(r["options"], o))), lambda p: p.isNotNull())
    mean = F.transform(options, lambda o: M.let(of(o), lambda ps: M.total(ps) / F.size(ps)))
    each = F.transform(runs, lambda r: M.entropy(r["q"]))
    return M.let(mean, lambda p: M.entropy(p)) - M.total(each) / F.size(runs)
