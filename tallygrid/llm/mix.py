"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Targets are words. The sources, by code point, weigh 5, 2, 1, repeating, and share the budget by weight; a source's target stops at CAP times its own
words, and what is over is shared again by weight among the others. That level is read off one ordered pass over the sources instead of
repeated rounds: by words per weight the sources that stop come first.

Within a source a document's expected copies are kappa * preference, CAP at most, with kappa such that the expected words are the target. The preference
grows with the root of a document's words (PREFER: a longer text gives more context a copy; any whole-numbered function of the size can be
given, a constant for equal shares). kappa follows from the table of distinct (source, size), whose rows a source are fewer than the root of twice its words.
The whole part of the expected copies is certain. The rest is an inclusion probability p, unequal over documents, for one copy more: a
document ranks by (u / (1 - u)) / (p / (1 - p)), u a hash of its id, source and size, and the sample is of a fixed size in words, as targets are: documents
in rank order as long as they fit into what the certain copies leave of the target. One that does not fit is passed over and the order goes on, PASSES times at most and while more than a thousandth of the target is open; last comes the
one of the others whose words are nearest to the gap, if it makes it smaller.

The place where a source's sample ends is found by range-dealt ranks: each range's words are summed, and only the range in which the target is
reached is ordered, so a source with a third of all rows is in no task as a whole. What joins the documents is a row a source.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source, the last; a null id is drawn like an id of its own;
repeated rows (same id, source and size) share one draw; sources without words have target 0; other columns are ignored, whatever their names; an empty table gives no rows; a longest
text counts whole. Reruns agree, as nothing depends on the layout of the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.llm.staging import small, stage

WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix"
#: Documents that are passed over, and the part of a target below which none is.
PASSES, OPEN = 4, 1000
#: Words between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a row of the table by source, its name not counted beyond 200 bytes.
_SOURCE_BYTES = 300


def PREFER(size: Column) -> Column:  # noqa: N802  a constant that is a function
    """Sixteen times the root of the size, whole."""
    return F.floor(16 * F.sqrt(size))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, u): words of the whole text, and a draw in (0, 1)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    return rows.withColumn("u", _draw(seed))


def _draw(seed: str) -> Column:
    name = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("source", F.lit("null")), F.col("size").cast("string"))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("bigint") + 0.5) / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources (source, source_size) with `target`. A row a source: its windows are as long as the list of sources."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    at = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sources.withColumn("_w", F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (at + 1).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size") * cap)
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before, every = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumns({
        "_k": F.row_number().over(by_level),
        "_left": F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
        "_share": F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)),
    })
    # the first source that its share doesn't fill, and with it all behind it, goes by weight
    rows = rows.withColumn("_open", F.min(F.when(F.col("_w") * F.col("_left") / F.col("_share") <= F.col("_cap"), F.struct("_k", "_left", "_share"))).over(every))
    by_weight = F.col("_w") * F.col("_open._left") / F.col("_open._share")
    return rows.select("source", "source_size", F.when(F.col("_k") < F.col("_open._k"), F.col("_cap").cast("double")).otherwise(by_weight).alias("target"))


def expected(prefer: Callable[[Column], Column], cap: int) -> Column:
    """A document's expected copies, from its size and its source's kappa; null kappa: all are at the cap."""
    return F.least(F.col("kappa") * prefer(F.col("size")), F.lit(float(cap)))


def plan(rows: DataFrame, weights: tuple[int, ...], cap: int, prefer: Callable[[Column], Column]) -> DataFrame:
    """A row a source: source, source_size, target, kappa, and `rest`, the words that certain copies leave to the sample."""
    cells = stage(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), light=True)
    goal = targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap)
    cells = _of_source(cells.filter("size > 0"), goal).withColumns({"_p": prefer(F.col("size")), "_words": F.col("size") * F.col("n")})
    cells = cells.withColumn("_weighed", (F.col("_p") * F.col("_words")).cast("decimal(38,0)"))
    first = Window.partitionBy("source").orderBy(F.desc("_p"), F.desc("size"))
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    over, under = F.coalesce(F.sum("_words").over(before), F.lit(0)), F.sum("_weighed").over(Window.partitionBy("source")) - F.coalesce(F.sum("_weighed").over(before), F.lit(0))
    cells = cells.withColumns({"_k": F.row_number().over(first), "_kappa": (F.col("target") - cap * over) / under.cast("double")})
    kappa = cells.filter(F.col("_kappa") * F.col("_p") <= cap).groupBy(F.col("source").alias("_s")).agg(F.min_by("_kappa", "_k").alias("kappa"))
    known = cells.join(kappa, F.col("source").eqNullSafe(F.col("_s")), "left")
    certain = known.groupBy(F.col("source").alias("_c"), "kappa").agg(F.sum(F.floor(expected(prefer, cap)) * F.col("_words")).alias("_certain"))
    joined = goal.join(certain, F.col("source").eqNullSafe(F.col("_c")), "left")
    return stage(joined.select("source", "source_size", "target", "kappa", (F.col("target") - F.coalesce("_certain", F.lit(0))).alias("rest")), light=True)


def _of_source(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """rows with the columns that their source has."""
    side = by_source.withColumnRenamed("source", "_of")
    return rows.join(side, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")


def _ranked(rows: DataFrame, prefer: Callable[[Column], Column], cap: int) -> DataFrame:
    """rows with `certain` copies and `rank`, which is null where there is no chance of one more."""
    m = expected(prefer, cap)
    chance = m - F.floor(m)
    rank = F.when((chance > 0) & (F.col("size") > 0), (F.col("u") / (1 - F.col("u"))) * ((1 - chance) / chance))
    return rows.withColumns({"certain": F.floor(m), "rank": rank})


def ends(drawn: DataFrame) -> DataFrame:
    """For each source of `drawn`: `stop`, the rank from which on documents no longer follow in order, `passed`, the ranks before it that were passed over, and `closing`, that of the one taken beyond the order (may
    be null). drawn: source, rank, rest, target, words, a row a source and rank.

    To pass a document over is to have its words more to fill, so each turn looks for the place of a larger sum among the same running sums."""
    parts = int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(drawn.repartitionByRange(parts, "source", "rank").withColumn("part", F.spark_partition_id()))
    by_part = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = dealt.groupBy("source", "part", "rest", "target").agg(F.sum("words").alias("words"))
    starts = stage(totals.withColumn("start", F.coalesce(F.sum("words").over(by_part), F.lit(0))), light=True)
    order = Window.partitionBy("source", "part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    no = F.lit(None).cast("double")
    state = starts.groupBy(F.col("source").alias("_of"), "target").agg(F.first("rest").alias("fill"))
    state = stage(state.select("_of", "target", "fill", no.alias("stop"), no.alias("gap"), F.array().cast("array<double>").alias("passed")), light=True)
    for _ in range(PASSES + 1):
        # where the sum that is to be filled ends: the range, and in it the document
        going = state.filter(F.col("stop").isNull())
        if going.isEmpty():
            break
        at = starts.join(small(going.select("_of", "fill"), _SOURCE_BYTES), F.col("source").eqNullSafe(F.col("_of"))).filter("start <= fill and fill < start + words")
        at = stage(at.select(F.col("source").alias("_s"), F.col("part").alias("_part"), "start", "fill"), light=True)
        inside = dealt.join(small(at, _SOURCE_BYTES), F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_part")))
        placed = inside.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(order), F.lit(0)))
        found = placed.filter("before <= fill and fill < before + words").select(F.col("source").alias("_f"), F.col("rank").alias("_rank"), F.col("words").alias("_words"), (F.col("fill") - F.col("before")).alias("_gap"))
        joined = state.join(found, F.col("_of").eqNullSafe(F.col("_f")), "left")
        goes_on = F.coalesce((F.col("_gap") > F.col("target") / OPEN) & (F.size("passed") < PASSES), F.lit(False))
        # at the end of the order all that is left is taken: a stop beyond every rank
        ended = F.col("stop").isNull() & ~goes_on
        stop = F.when(ended, F.coalesce("_rank", F.lit(float("inf")))).otherwise(F.col("stop"))
        gap = F.when(ended, F.coalesce("_gap", F.lit(0.0))).otherwise(F.col("gap"))
        fill, passed = F.when(goes_on, F.col("fill") + F.col("_words")).otherwise(F.col("fill")), F.when(goes_on, F.concat("passed", F.array("_rank"))).otherwise(F.col("passed"))
        state = stage(joined.select("_of", "target", fill.alias("fill"), stop.alias("stop"), gap.alias("gap"), passed.alias("passed")), light=True)
    others = dealt.join(small(state.filter("gap > 0").select("_of", "stop", "gap", "passed"), _SOURCE_BYTES), F.col("source").eqNullSafe(F.col("_of"))).filter((F.col("rank") >= F.col("stop")) | F.array_contains("passed", F.col("rank")))
    away = F.abs(F.col("words") - F.col("gap"))
    near = others.groupBy(F.col("source").alias("_f")).agg(F.min(F.when(away < F.col("gap"), F.struct(away.alias("away"), "rank"))).alias("c"))
    return stage(state.join(near, F.col("_of").eqNullSafe(F.col("_f")), "left").select(F.col("_of").alias("source"), "stop", "passed", F.col("c.rank").alias("closing")), light=True)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, prefer: Callable[[Column], Column] = PREFER, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target (its source's), copies, taken (words)."""
    rows = stage(sized(docs, doc_id, text, source, seed))
    return _copied(rows, *_solved(rows, weights, cap, prefer), cap, prefer).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _solved(rows: DataFrame, weights: tuple[int, ...], cap: int, prefer: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    by_source = plan(rows, weights, cap, prefer)
    ranked = _ranked(_of_source(rows, small(by_source, _SOURCE_BYTES)), prefer, cap).filter("rank is not null")
    return by_source, ends(ranked.groupBy("source", "rank", "rest", "target").agg(F.sum("size").alias("words")))


def _copied(rows: DataFrame, by_source: DataFrame, sample: DataFrame, cap: int, prefer: Callable[[Column], Column]) -> DataFrame:
    """rows with `copies`."""
    ranked = _ranked(_of_source(rows, small(by_source, _SOURCE_BYTES)), prefer, cap)
    side = small(sample, _SOURCE_BYTES).withColumnRenamed("source", "_of")
    known = ranked.join(side, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")
    in_order = (F.col("rank") < F.col("stop")) & ~F.array_contains("passed", F.col("rank"))
    more = F.coalesce(in_order, F.lit(False)) | F.coalesce(F.col("rank") == F.col("closing"), F.lit(False))
    return known.withColumn("copies", F.when(F.col("size") > 0, F.col("certain") + more.cast("bigint")).otherwise(F.lit(0).cast("bigint")))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, prefer: Callable[[Column], Column] = PREFER, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: documents with all their columns, each as often as it is taken, and `copy_no` from 1 on."""
    by_source, sample = _solved(rows := stage(sized(docs, doc_id, text, source, seed)), weights, cap, prefer)
    copies = _copied(rows.distinct(), by_source, sample, cap, prefer).filter("copies > 0")
    table = stage(copies.select("source", "size", F.col("doc_id").alias("_id"), "copies").withColumnRenamed("source", "_source").withColumnRenamed("size", "_size"))
    size = F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("bigint")
    joined = docs.join(table, docs[doc_id].eqNullSafe(table["_id"]) & docs[source].cast("string").eqNullSafe(table["_source"]) & (size == table["_size"]))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("bigint"), table["copies"])).alias("copy_no"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _passes() -> str:
    turns = []
    for k in range(PASSES + 1):
        goes_on = f"coalesce(e.fill_ - e.before > h.goal / {OPEN} AND len(h.passed) < {PASSES}, false)"
        at = f"SELECT e.*, h.fill AS fill_ FROM e JOIN h{k} h ON e.source IS NOT DISTINCT FROM h.source WHERE h.stop IS NULL AND e.before <= h.fill AND h.fill < e.before + e.words"
        turns.append(
            f"h{k + 1} AS MATERIALIZED (SELECT h.source, h.goal, CASE WHEN {goes_on} THEN h.fill + e.words ELSE h.fill END AS fill, CASE WHEN h.stop IS NULL AND NOT {goes_on} THEN coalesce(e.rk, CAST('inf' AS DOUBLE)) ELSE h.stop END AS stop, "
            f"CASE WHEN h.stop IS NULL AND NOT {goes_on} THEN coalesce(e.fill_ - e.before, 0) ELSE h.gap END AS gap, CASE WHEN {goes_on} THEN list_append(h.passed, e.rk) ELSE h.passed END AS passed FROM h{k} h LEFT JOIN ({at}) e ON h.source IS NOT DISTINCT FROM e.source)"
        )
    return ",\n".join(turns)


SQL = rf"""
WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
d AS (SELECT *, (CAST('0x' || md5(concat_ws('|', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), 'null'), coalesce(source, 'null'), CAST(size AS VARCHAR)))[1:13] AS BIGINT) + 0.5) / CAST({1 << 52} AS DOUBLE) AS u,
  CAST(floor(16 * sqrt(size)) AS BIGINT) AS p FROM z),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w, {CAP} * source_size AS cap FROM s),
l AS (SELECT *, row_number() OVER o AS k, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rem,
  CAST(sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS share FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, source IS NULL, source)),
f AS (SELECT k AS fk, rem AS frem, share AS fshare FROM l WHERE CAST(w * rem AS DOUBLE) / share <= cap ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN k < fk THEN CAST(cap AS DOUBLE) ELSE CAST(w * frem AS DOUBLE) / fshare END AS target FROM l CROSS JOIN f),
c AS (SELECT source, size, p, size * count(*) AS words FROM d WHERE size > 0 GROUP BY source, size, p),
g AS (SELECT c.*, t.target, row_number() OVER o AS k, (t.target - {CAP} * CAST(coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
  / CAST(sum(p * words) OVER (PARTITION BY c.source) - coalesce(sum(p * words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS kappa
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY c.source ORDER BY p DESC, size DESC)),
q AS (SELECT source, arg_min(kappa, k) AS kappa FROM g WHERE kappa * p <= {CAP} GROUP BY source),
r AS (SELECT g.source, any_value(g.target) - CAST(sum(floor(least(q.kappa * g.p, CAST({CAP} AS DOUBLE))) * g.words) AS DOUBLE) AS rest FROM g LEFT JOIN q ON g.source IS NOT DISTINCT FROM q.source GROUP BY g.source),
m AS (SELECT d.*, t.source_size, t.target, r.rest, least(q.kappa * d.p, CAST({CAP} AS DOUBLE)) AS m FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN r ON d.source IS NOT DISTINCT FROM r.source),
n AS (SELECT *, CASE WHEN m - floor(m) > 0 AND size > 0 THEN (u / (1 - u)) * ((1 - (m - floor(m))) / (m - floor(m))) END AS rk FROM m),
b AS MATERIALIZED (SELECT source, rk, rest, target, sum(size) AS words FROM n WHERE rk IS NOT NULL GROUP BY source, rk, rest, target),
e AS MATERIALIZED (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
h0 AS MATERIALIZED (SELECT source, any_value(target) AS goal, any_value(rest) AS fill, CAST(NULL AS DOUBLE) AS stop, CAST(NULL AS DOUBLE) AS gap, CAST([] AS DOUBLE[]) AS passed FROM b GROUP BY source),
{_passes()},
h AS (SELECT * FROM h{PASSES + 1}),
x AS (SELECT source, rk FROM (SELECT b.source, b.rk, row_number() OVER (PARTITION BY b.source ORDER BY abs(b.words - h.gap), b.rk) AS place FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source WHERE h.gap > 0 AND (b.rk >= h.stop OR list_contains(h.passed, b.rk)) AND abs(b.words - h.gap) < h.gap) WHERE place = 1),
k AS (SELECT n.*, CASE WHEN size = 0 THEN 0 ELSE CAST(floor(m) AS BIGINT) + CASE WHEN n.rk IS NOT NULL AND (coalesce(n.rk < h.stop AND NOT list_contains(h.passed, n.rk), false) OR coalesce(n.rk = x.rk, false)) THEN 1 ELSE 0 END END AS copies
  FROM n LEFT JOIN h ON n.source IS NOT DISTINCT FROM h.source LEFT JOIN x ON n.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM k
"""
