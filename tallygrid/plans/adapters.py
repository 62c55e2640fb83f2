"""Queries of the adapters: every document becomes a row of each public data set's shape, and goes through its adapter with all rejections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.sources import adapters as A
from tallygrid.sources.readers import table


def _docs(spark, d):
    rows = table(spark, d, "documents").withColumns({"text": F.concat(F.lit("t "), F.coalesce("text", F.lit(""))), "lang": F.coalesce("lang", F.lit("und"))})
    return rows.select("doc_id", "text", "lang", "source", "n_chars", F.col("doc_id").alias("row_no"))


def _out(items):
    return items.select("uid", F.md5("query").alias("digest"), "question", F.array_join("option_names", "|").alias("names"), "gold_idx", "qtype", "context_label", "reason")


def _four(every: int):
    """Four options, of which the last repeats the third in some rows."""
    return F.array(F.lit("one"), F.lit("two"), F.lit("three"), F.when(F.col("n_chars") % every == 0, F.lit("three")).otherwise(F.col("lang")))


def quality(spark, d):
    part = lambda k: F.struct(F.concat_ws("-", "doc_id", F.lit(k)).alias("question_unique_id"), F.concat(F.lit(f"Question {k} of "), F.col("source")).alias("question"), _four(7 + k).alias("options"), (F.col("doc_id") % 4 + 1).alias("gold_label"))
    return _out(A.adapt("quality", _docs(spark, d).select(F.col("text").alias("article"), F.array(part(0), part(1)).alias("questions"))))


def reclor(spark, d):
    return _out(A.adapt("reclor", _docs(spark, d).select(F.col("doc_id").alias("id_string"), F.col("text").alias("context"), F.lit("Which follows?").alias("question"), _four(5).alias("answers"), (F.col("doc_id") % 4).alias("label"))))


def aokvqa(spark, d):
    choices = F.array(F.lit("left"), F.when(F.col("n_chars") % 6 == 0, F.lit("left")).otherwise(F.lit("right")), F.when(F.col("n_chars") % 5 != 0, F.col("source")))
    return _out(A.adapt("aokvqa", _docs(spark, d).select(F.col("doc_id").alias("question_id"), F.col("source").alias("question"), choices.alias("choices"), (F.col("doc_id") % 3).alias("correct_choice_idx"), F.col("text").cast("binary").alias("image"))))


def scienceqa(spark, d):
    hint = F.when(F.col("doc_id") % 3 != 0, F.col("text"))
    return _out(A.adapt("scienceqa", _docs(spark, d).select("row_no", F.col("lang").alias("question"), F.array("lang", "source").alias("choices"), (F.col("doc_id") % 2).alias("answer"), hint.alias("hint"), F.when(F.col("n_chars") % 4 != 0, F.col("text").cast("binary")).alias("image"))))


def cauldron_mcq(spark, d):
    first = F.struct(F.concat(F.lit("Question: Which language is "), F.col("doc_id").cast("string"), F.lit(" in?\nChoices:\nA. "), F.col("lang"), F.lit("\nB. "), F.when(F.col("n_chars") % 8 == 0, F.col("lang")).otherwise(F.lit("another")), F.lit("\nAnswer with the letter.")).alias("user"), F.when(F.col("doc_id") % 2 == 0, "Answer: A").otherwise("Answer: B").alias("assistant"))
    second = F.struct(F.col("text").alias("user"), F.col("source").alias("assistant"))
    return _out(A.adapt("cauldron_mcq", _docs(spark, d).select("row_no", F.array_repeat(F.lit("i"), (F.col("doc_id") % 2 + 1).cast("int")).alias("images"), F.array(first, second).alias("texts"))))


def cauldron_statements(spark, d):
    turn = F.struct(F.concat(F.lit('Is "'), F.col("text"), F.lit('" so?')).alias("user"), F.when(F.col("doc_id") % 2 == 0, "Yes.").otherwise(" no").alias("assistant"))
    plain = _docs(spark, d).filter(~F.contains("text", F.lit('"')))
    return _out(A.adapt("cauldron_statements", plain.select("row_no", F.array(F.lit("i"), F.lit("j")).alias("images"), F.array(turn).alias("texts")), two=True))


def legalbench(spark, d):
    spec = {"rules": "Texts have one language.", "context_fields": ["text", "source"], "question": "Which language?", "labels": ["de", "en", "es", "fr", "und"]}
    return _out(A.adapt("legalbench", _docs(spark, d).withColumn("answer", F.col("lang")), spec=spec))


def sharc(spark, d):
    answer = F.when(F.col("doc_id") % 4 == 0, "Yes").when(F.col("doc_id") % 4 == 1, " no ").when(F.col("doc_id") % 4 == 2, "Irrelevant").otherwise("Do you live there?")
    return _out(A.adapt("sharc", _docs(spark, d).select(F.col("doc_id").alias("utterance_id"), F.col("text").alias("snippet"), F.col("source").alias("scenario"), F.col("lang").alias("history"), F.lit("May I?").alias("question"), answer.alias("answer"))))


def conditionalqa(spark, d):
    docs = _docs(spark, d)
    pages = docs.groupBy(F.col("source").alias("url")).agg(F.max("lang").alias("title"), F.max_by("text", "doc_id").alias("contents"))
    kind = F.col("doc_id") % 7
    answer = F.struct(F.when(kind < 3, "yes").when(kind < 6, "no").otherwise("it depends").alias("answer"), F.when(kind == 2, F.array(F.lit("if so"))).otherwise(F.array().cast("array<string>")).alias("conditions"))
    answers = F.when(kind == 4, F.array(answer, answer)).otherwise(F.array(answer))
    return _out(A.adapt("conditionalqa", docs.select(F.col("doc_id").alias("id"), F.col("source").alias("url"), F.col("text").alias("scenario"), F.lit("Can I?").alias("question"), (kind == 5).alias("not_answerable"), answers.alias("answers")), documents=pages))


_T = "t AS (SELECT doc_id, 't ' || coalesce(text, '') AS text, coalesce(lang, 'und') AS lang, source, n_chars FROM documents)"


def _rows(uid: str, query: str, question: str, names: str, gold: str, label: str, qtype: str = "choice", reason: str = "NULL", source: str = "t", with_: str = "") -> str:
    return f"WITH {_T}{with_} SELECT {uid} AS uid, md5({query}) AS digest, {question} AS question, {names} AS names, CAST({gold} AS INT) AS gold_idx, '{qtype}' AS qtype, '{label}' AS context_label, CAST({reason} AS VARCHAR) AS reason FROM {source}"


def _json(**fields: str) -> str:
    body = " || ',' || chr(10) || ".join(f"'  \"{n.replace('_', ' ')}\": ' || to_json({v})" for n, v in fields.items())
    return f"'{{' || chr(10) || {body} || chr(10) || '}}'"


_MARK = "chr(57344)"
_FOUR = "'one|two|three|' || CASE WHEN n_chars % {n} = 0 THEN 'three' ELSE lang END"
_TWICE = "CASE WHEN n_chars % {n} = 0 THEN 'duplicate_options' END"
_ID = "CAST(doc_id AS VARCHAR)"

TABLE = {
    "adapter_quality": (quality, _rows(f"{_ID} || '-' || k", "text", "'Question ' || k || ' of ' || source", "'one|two|three|' || CASE WHEN n_chars % (7 + k) = 0 THEN 'three' ELSE lang END", "doc_id % 4", "Article", reason="CASE WHEN n_chars % (7 + k) = 0 THEN 'duplicate_options' END", source="(SELECT *, unnest([0, 1]) AS k FROM t)")),
    "adapter_reclor": (reclor, _rows(_ID, "text", "'Which follows?'", _FOUR.format(n=5), "doc_id % 4", "Argument", reason=_TWICE.format(n=5))),
    "adapter_aokvqa": (aokvqa, _rows(_ID, _MARK, "source", "'left|' || CASE WHEN n_chars % 6 = 0 THEN 'left' ELSE 'right' END || CASE WHEN n_chars % 5 <> 0 THEN '|' || source ELSE '' END", "doc_id % 3", "Photo", reason="CASE WHEN n_chars % 5 = 0 THEN 'blank_option' WHEN n_chars % 6 = 0 THEN 'duplicate_options' END")),
    "adapter_scienceqa": (scienceqa, _rows(_ID, f"CASE WHEN doc_id % 3 = 0 THEN {_MARK} ELSE {_json(image=_MARK, context='trim(text)')} END", "lang", "lang || '|' || source", "doc_id % 2", "Science problem", reason="CASE WHEN n_chars % 4 = 0 THEN 'no_image' END")),
    "adapter_cauldron_mcq": (cauldron_mcq, _rows(f"{_ID} || '/' || j", f"CASE WHEN doc_id % 2 = 0 THEN {_MARK} ELSE {_json(image_1=_MARK, image_2=_MARK)} END", "CASE WHEN j = 0 THEN 'Which language is ' || doc_id || ' in?' ELSE '' END", "CASE WHEN j = 0 THEN lang || '|' || CASE WHEN n_chars % 8 = 0 THEN lang ELSE 'another' END ELSE '' END", "CASE WHEN j = 0 THEN doc_id % 2 END", "Image", reason="CASE WHEN j = 1 THEN 'not_multiple_choice' WHEN n_chars % 8 = 0 THEN 'duplicate_options' END", source="(SELECT *, unnest([0, 1]) AS j FROM t)")),
    "adapter_cauldron_statements": (cauldron_statements, _rows(f"{_ID} || '/0'", _json(left_image=_MARK, right_image=_MARK), "'Is this statement true of the two images? \"' || trim(text) || '\"'", "'no|yes'", "CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END", "Images", "bool", source="(SELECT * FROM t WHERE NOT contains(text, '\"'))")),
    "adapter_legalbench": (legalbench, _rows(_ID, _json(rules="'Texts have one language.'", text="text", source="source"), "'Which language?'", "'de|en|es|fr|und'", "list_position(['de', 'en', 'es', 'fr', 'und'], lang) - 1", "Legal problem")),
    "adapter_sharc": (sharc, _rows(_ID, _json(snippet="text", scenario="source", history="lang"), "'May I?'", "'No|Yes|Irrelevant: The rule does not address the question|AskMore: Ask a follow-up question to obtain missing information'", "[1, 0, 2, 3][doc_id % 4 + 1]", "Rule and dialogue")),
    "adapter_conditionalqa": (conditionalqa, _rows(_ID, _json(title="title", document="contents", scenario="t.text"), "'Can I?'", "'no|yes'", "CASE WHEN doc_id % 7 < 3 THEN 1 ELSE 0 END", "Policy and scenario", "bool", "[NULL, NULL, 'conditional_answer', NULL, 'multiple_or_missing_answers', 'unanswerable', 'non_boolean_answer'][doc_id % 7 + 1]", "t JOIN p ON t.source = p.url", ", p AS (SELECT source AS url, max(lang) AS title, arg_max(text, doc_id) AS contents FROM t GROUP BY source)")),
}
