"""A plugged-in scorer over conversations: every turn is a question about its conversation's first turn, which all of its turns share."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F

from tallygrid.operators import scoring as S
from tallygrid.plans.base import rounded
from tallygrid.sources.readers import table

_LETTERS = "abcdefghijklmnopqrstuvwxyz"


class Letters:
    """Is a turn an answer, a question or a remark? By the letters that it shares with the first turn, its question marks, and the first turn's length."""

    state = "array<bigint>"

    @staticmethod
    def counts(text: str | None) -> list[int]:
        return [(text or "").count(c) for c in _LETTERS]

    def read(self, prefixes: pa.Array) -> pa.Array:
        return pa.array([self.counts(p) for p in prefixes.to_pylist()], pa.list_(pa.int64()))

    def score(self, state: list[int], questions: pa.RecordBatch) -> pa.Array:
        known, out = sum(state), []
        for text in questions.column("text").to_pylist():
            own = self.counts(text)
            out.append([sum(map(min, own, state)) / max(sum(own), 1), (text or "").count("?") / 4, known / (known + 200)])
        return pa.array(out, pa.list_(pa.float64()))


def shared_prefix_scores(spark, d):
    turns = table(spark, d, "conversations")
    first = turns.filter("turn = 0").select(F.col("conv_id").alias("_conv"), F.col("text").alias("prefix"))
    questions = turns.join(first, F.col("conv_id") == F.col("_conv"), "left").select(F.concat_ws("-", "conv_id", "turn").alias("row_id"), "prefix", "text", F.array(*map(F.lit, ("answer", "question", "remark"))).alias("options"))
    scored = S.answered(S.score_shared(questions, Letters(), "prefix", "row_id", "options"))
    return rounded(scored.select("row_id", F.get("options", "pred").alias("answer"), F.get("z", F.lit(0)).alias("shared"), "confidence"))


def _count(text: str) -> list[str]:
    return [f"(length({text}) - length(replace({text}, '{c}', '')))" for c in _LETTERS]


_SHARED = f"""WITH c AS (SELECT t.conv_id || '-' || t.turn AS row_id, coalesce(f.text, '') AS p, coalesce(t.text, '') AS x FROM conversations t LEFT JOIN conversations f ON t.conv_id = f.conv_id AND f.turn = 0),
n AS (SELECT row_id, {' + '.join(f'least({a}, {b})' for a, b in zip(_count('p'), _count('x'), strict=True))} AS both_, {' + '.join(_count('x'))} AS own, {' + '.join(_count('p'))} AS known, length(x) - length(replace(x, '?', '')) AS asks FROM c),
z AS (SELECT row_id, [both_ / CAST(greatest(own, 1) AS DOUBLE), asks / 4.0::DOUBLE, known / CAST(known + 200 AS DOUBLE)] AS z FROM n),
e AS (SELECT *, [exp(y - list_max(z)) FOR y IN z] AS e FROM z)
SELECT row_id, ['answer', 'question', 'remark'][list_position(z, list_max(z))] AS answer, round(z[1], 6) AS shared, round(greatest(0, least(1, (3 * list_max(e) / list_sum(e) - 1) / 2)), 6) AS confidence FROM e"""
_SHARED = re.sub(r"\s+", " ", _SHARED)

TABLE = {"shared_prefix_scores": (shared_prefix_scores, _SHARED)}
