"""Scorers: what turns questions into scores is plugged in, and what questions share is read once.

A scorer is any object with the methods of Scorer (a model, a lookup, a formula). Questions with the same prefix (a system text, a document, a state) form a group: `read` sees each distinct prefix once, whatever
the size of the group, and `score` gets what it made with every batch of the group's questions. The groups' states and their questions go through one exchange: questions are dealt by prefix, those of a hot prefix also by a
salt, each part gets the state once, sorted before its questions, and a task holds one state and one batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.functions import menus as M
from tallygrid.written import written

#: Questions of one prefix in a part, at least; and parts of hot prefixes in all, at most, which bounds what is sent to every task.
PART_ROWS, MOST_HOT = 50_000, 10_000


class Scorer(Protocol):
    """`state` is the Spark type of what read gives. Both methods run on executors, so a scorer is sent there: what is large it loads on first use."""

    state: str

    def read(self, prefixes: pa.Array) -> pa.Array:
        """The state of each distinct prefix."""

    def score(self, state: Any, questions: pa.RecordBatch) -> pa.Array:
        """A list of scores for each question of one prefix, an entry an option."""


def check_scores(scores: pa.Array, questions: pa.RecordBatch, options: str | None) -> pa.Array:
    """Scores as lists of doubles: one list a question, as long as its menu, all finite."""
    scores = scores.cast(pa.list_(pa.float64()))
    if len(scores) != questions.num_rows or scores.null_count:
        raise ValueError(f"the scorer gave {len(scores) - scores.null_count} lists for {questions.num_rows} questions")
    flat = scores.flatten()
    if flat.null_count or not pc.all(pc.is_finite(flat)).as_py() and len(flat):
        raise ValueError("the scorer gave a score that is not finite")
    if options and not pc.all(pc.equal(pc.list_value_length(scores), pc.list_value_length(questions.column(options)))).as_py() and len(scores):
        raise ValueError("the scorer gave more or fewer scores than a menu has options")
    return scores


def prefix_states(questions: DataFrame, scorer: Scorer, prefix: str, parts: int | None = None) -> DataFrame:
    """(key, n, state) of each distinct prefix, written: read once, counted while it is gathered. A null prefix is a prefix."""
    seen = questions.select(_key(prefix).alias("_key"), F.col(prefix).alias("_prefix")).groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.first("_prefix").alias("_prefix"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("n"), scorer.read(b.column("_prefix"))], ["_key", "n", "state"])

    return written(seen.mapInArrow(work, f"_key string, n bigint, state {scorer.state}"))


def _key(prefix: str):
    """Equal for equal prefixes; a null one is apart from an empty one."""
    return F.coalesce(F.sha2(F.col(prefix).cast("string"), 256), F.lit("none"))


def score_shared(questions: DataFrame, scorer: Scorer, prefix: str, row_id: str, options: str | None = None, name: str = "z") -> DataFrame:
    """questions with the scorer's scores in `name`. `row_id` tells questions apart and deals those of a hot prefix; with `options` every list of scores has to be as long as that array."""
    states = prefix_states(questions, scorer, prefix)
    total = states.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    part = max(PART_ROWS, total // MOST_HOT)
    hot = states.filter(F.col("n") > part).select(F.col("_key").alias("_hot"), F.ceil(F.col("n") / part).cast("int").alias("_parts"))  # fewer than MOST_HOT rows
    columns = questions.columns
    dealt = questions.withColumn("_key", _key(prefix)).join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left")
    salt = F.pmod(F.xxhash64(F.col(row_id)), F.coalesce("_parts", F.lit(1))).cast("int")
    rows = dealt.select("_key", salt.alias("_salt"), F.lit(True).alias("_asks"), F.lit(None).cast(scorer.state).alias("_state"), *columns)
    each = states.join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left").select("_key", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_salt"), F.lit(False).alias("_asks"), F.col("state").alias("_state"))
    both = rows.unionByName(each, allowMissingColumns=True).repartition("_key", "_salt").sortWithinPartitions("_key", "_salt", "_asks")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            asks = b.column("_asks").to_pylist()
            lead = [k for k, a in enumerate(asks) if not a]
            for begin, end in zip([0, *(k + 1 for k in lead)], [*lead, len(asks)], strict=True):
                if end > begin:
                    group = b.slice(begin, end - begin).select(columns)
                    yield pa.RecordBatch.from_arrays([*group.columns, check_scores(scorer.score(state, group), group, options)], [*columns, name])
                if end < len(asks):
                    state = b.column("_state")[end].as_py()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in questions.schema)
    return both.mapInArrow(work, f"{kinds}, `{name}` array<double>")


def score(questions: DataFrame, function, options: str | None = None, name: str = "z") -> DataFrame:
    """questions with what `function` (record batch -> lists of numbers) makes of each batch: a scorer without shared parts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, check_scores(function(b), b, options)], [*b.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in questions.schema)
    return questions.mapInArrow(work, f"{kinds}, `{name}` array<double>")


def answered(scored: DataFrame, z: str = "z") -> DataFrame:
    """scored with the probabilities of its menu, its best position and its confidence."""
    out = scored.withColumn("q", M.softmax(F.col(z)))
    return out.withColumns({"pred": M.top(F.col("q")), "confidence": M.confidence(F.col("q"))})
