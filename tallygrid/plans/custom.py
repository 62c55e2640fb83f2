"""Queries of operators that parse foreign text or pack sequentially; tests hold them against goldens or brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.functions import assets as A
from tallygrid.functions import text as X
from tallygrid.operators import selection as S
from tallygrid.plans.base import scored
from tallygrid.plans.corpus import _tidied
from tallygrid.sources import adapters, readers
from tallygrid.sources.readers import table


def html_text(spark, d):
    t = X.tidy(X.html_text("html"))
    return table(spark, d, "pages").select("page_id", F.length(t).alias("n"), F.md5(t).alias("digest"))


def email_text(spark, d):
    raw = F.concat(F.lit("Subject: =?utf-8?q?"), F.col("role"), F.lit("?=\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), F.col("text")).cast("binary")
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(X.email_text()(raw)).alias("digest"))


def mysqldump_rows(spark, d):
    q = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
    row = F.concat(F.lit("("), F.col("doc_id").cast("string"), F.lit(","), q(F.col("text")), F.lit(",NULL,"), F.col("n_chars").cast("string"), F.lit(")"))
    dump = table(spark, d, "documents").select(F.concat(F.lit("INSERT INTO `docs` VALUES "), row, F.lit(";")).alias("value"))
    noise = dump.select(F.replace("value", F.lit("`docs`"), F.lit("`other`")).alias("value"))
    out = readers.dump_table(dump.unionByName(noise), "docs", "doc_id bigint, text string, missing string, n_chars bigint")
    return out.select("doc_id", F.md5("text").alias("digest"), "missing", "n_chars")


def state_text(spark, d):
    return table(spark, d, "events").select("event_id", F.md5(X.state_text("props")).alias("digest"))


def key_spans(spark, d):
    worked = F.concat(F.lit("3 * "), F.col("event_id").cast("string"), F.lit(" = "), (F.col("event_id") * 3).cast("string"), F.lit(", rounded to "), F.round("value").cast("int").cast("string"), F.lit(".\n2 <= 3, so the rule holds.\nAnswer: yes."))
    spans = X.key_spans(worked)
    return table(spark, d, "events").select("event_id", F.size(spans).alias("n"), F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias("spans"))


def split_steps(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(X.split_steps("text")).alias("steps"), F.md5(F.array_join(X.split_steps("text"), "|")).alias("digest"), F.md5(X.shorten_trace("text", F.lit(0.5))).alias("short"))


def curriculum(spark, d):
    c = X.curriculum("text", (F.col("item_id") % 4).cast("int"), F.lit(3))
    return table(spark, d, "benchmark").select("item_id", c["latent_n"].alias("latent_n"), F.md5(c["latent_text"]).alias("rest"))


def token_groups(spark, d):
    rows = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 40).alias("batch_no"), F.col("doc_id").alias("row_no"), F.col("n_chars").alias("length"))
    return S.pack_batches(rows, 20000)


def epoch_rounds(spark, d):
    items = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.floor(F.col("doc_id") / 2).alias("pair_key"), F.col("lang").alias("goal"))
    passes = spark.createDataFrame([("en", 1), ("fr", 2), ("de", 1), ("es", 3)], "goal string, n int")
    return S.epoch_rounds(items, passes, 32, "seed")


def hierarchical_draws(spark, d):
    docs = table(spark, d, "documents")
    items = docs.select(F.col("lang").alias("goal"), F.col("source").alias("domain"), (F.col("n_chars") % 3).alias("kind"), F.floor(F.col("doc_id") / 10).alias("context_id"), F.col("doc_id").alias("key"))
    weights = spark.createDataFrame([("en", 4.0), ("fr", 2.0), ("de", 1.0), ("es", 1.0)], "goal string, weight double")
    return S.hierarchical_draws(spark.range(500).withColumnRenamed("id", "draw_id"), items, weights, "seed")


def balanced_codes(spark, d):
    return S.balanced_runs(scored(spark, d).select(F.col("row_id").alias("row_no"), F.size("options").alias("k")), 0.5, "seed", 100)


def asset_resolve(spark, d):
    body = F.to_json(F.struct(F.col("role").alias("who"), F.concat(F.lit("see img:1 and "), F.col("text")).alias("text")))
    r = A.resolve(body, F.lit('{"q":{"instructions":"Is it?"}}'), F.lit('{"img:1":"QUJD"}'))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(r["state"]).alias("digest"), F.array_join(r["used"], ",").alias("used"), r["problem"].alias("problem"))


def adapter_menu(spark, d):
    """A reading-comprehension set built from documents, through an adapter and its counted skips."""
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("row_no"), F.col("doc_id").alias("id"), (F.col("doc_id") % 4).cast("int").alias("answer"), F.concat(F.lit("t"), F.coalesce("text", F.lit(""))).alias("text"), F.lit("Which?").alias("question"), F.when(F.col("n_chars") % 13 == 0, F.array(*map(F.lit, "aabc"))).otherwise(F.array(*map(F.lit, "abcd"))).alias("options"))
    out = adapters.logiqa2(rows)
    return out.groupBy(F.coalesce("reason", F.lit("accepted")).alias("fate"), "gold_idx").agg(F.count(F.lit(1)).alias("n"))


def adapter_history(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value")))).alias("c"))
    talk = F.transform("c", lambda t: F.struct(t["from"].alias("from"), F.when(t["from"] == "assistant", F.lit("[look up(word='a, b', n=[1, 2])]")).otherwise(t["value"]).alias("value")))
    rows = turns.select(F.col("conv_id").alias("row_no"), F.lit('Tools: [{"name": "look up", "description": "find"}, {"name": "stop"}] end').alias("system"), talk.alias("conversations"))
    out = adapters.toolace(rows)
    return out.select("uid", F.md5("query").alias("digest"), "gold_idx", "reason")


#: The planted text's five spans: two numbers, the comparison, the verdict and the last word.
_SPANS = """WITH t AS (SELECT event_id, '3 * ' || CAST(event_id AS VARCHAR) || ' = ' AS a, CAST(event_id * 3 AS VARCHAR) AS b, CAST(CAST(round(value) AS INT) AS VARCHAR) AS c FROM events),
p AS (SELECT event_id, length(a) AS s1, length(a) + length(b) AS e1, length(a) + length(b) + 13 AS s2, length(a) + length(b) + 13 + length(c) AS e2 FROM t)
SELECT event_id, 5 AS n, s1 || '-' || e1 || ',' || s2 || '-' || e2 || ',' || (e2 + 4) || '-' || (e2 + 6) || ',' || (e2 + 22) || '-' || (e2 + 27) || ',' || (e2 + 37) || '-' || (e2 + 40) AS spans FROM p"""

TABLE = {
    "html_text": (html_text, None),
    "email_text": (email_text, f"WITH t AS (SELECT conv_id, turn, role, {_tidied('text')} AS s FROM conversations) SELECT conv_id, turn, md5('Subject: ' || role || CASE WHEN s = '' THEN '' ELSE chr(10) || chr(10) || regexp_replace(substring(s, 1, 2000), '\\s+$', '') END) AS digest FROM t"),
    "mysqldump_rows": (mysqldump_rows, "SELECT doc_id, md5(text) AS digest, CAST(NULL AS VARCHAR) AS missing, n_chars FROM documents"),
    "state_text": (state_text, None),
    "key_spans": (key_spans, _SPANS),
    "split_steps": (split_steps, None),
    "curriculum": (curriculum, None),
    "token_groups": (token_groups, None),
    "epoch_rounds": (epoch_rounds, None),
    "hierarchical_draws": (hierarchical_draws, None),
    "balanced_codes": (balanced_codes, None),
    "asset_resolve": (asset_resolve, None),
    "adapter_menu": (adapter_menu, "WITH t AS (SELECT doc_id, doc_id % 4 AS a, 't' || coalesce(text, '') AS t, n_chars % 13 = 0 AS dup FROM documents), g AS (SELECT *, min(a) OVER w <> max(a) OVER w AS conflict FROM t WINDOW w AS (PARTITION BY t, dup)) SELECT CASE WHEN dup THEN 'duplicate_options' WHEN conflict THEN 'conflicting_labels' ELSE 'accepted' END AS fate, CAST(a AS INT) AS gold_idx, count(*) AS n FROM g GROUP BY 1, 2"),
    "adapter_history": (adapter_history, None),
}
