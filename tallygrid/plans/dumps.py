"""Queries of SQL dumps: documents and their labels as the statements of a dump, read back as tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrid.plans.corpus import _tidied
from tallygrid.sources import dumps as D
from tallygrid.sources.readers import table


def _statement(name: str, *values) -> Column:
    return F.concat(F.lit(f"INSERT INTO `{name}` VALUES ("), F.concat_ws(",", *values), F.lit(");"))


def _quoted(c) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))


def _lines(rows, place, *statements):
    """One line a statement; blocks of a thousand places, as a file has splits."""
    at = place.cast("bigint")
    lines = rows.select(F.lit("dump.sql").alias("file"), F.floor(at / 1000).cast("bigint").alias("block"), at.alias("_at"), F.posexplode(F.array(*statements)).alias("_k", "value"))
    return lines.select("file", "block", (F.col("_at") * 4 + F.col("_k")).alias("place"), "value")


def annotated_posts(spark, d):
    """Annotations stand in descending order of ids, posts in ascending order."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    n = F.lit(1 << 40)
    posts = _lines(docs, F.col("doc_id"), _statement("posts", F.col("doc_id").cast("string"), _quoted(F.coalesce("text", F.lit("")))), _statement("users", F.col("doc_id").cast("string")))
    notes = _lines(labels, n - F.col("doc_id"), _statement("adv_tags", F.col("doc_id").cast("string"), F.col("toxic").cast("string")))
    got = D.tables(posts.unionByName(notes), {"posts": "id bigint, body string", "adv_tags": "post_id bigint, label int"})
    return D.annotated_posts(got["adv_tags"], got["posts"]).select("order_no", "id", "label", F.md5("text").alias("digest"))


def dump_corpus(spark, d):
    docs = table(spark, d, "documents").withColumn("lang", F.coalesce("lang", F.lit("?")))
    post = _statement("viral_messages", (F.col("doc_id") * 10).cast("string"), F.when(F.col("doc_id") % 6 == 0, F.lit("NULL")).otherwise(_quoted(F.coalesce("text", F.lit("")))), _quoted(F.concat(F.lit("caption "), F.col("lang"))), (F.col("doc_id") % 5).cast("string"), (F.col("doc_id") % 4 - 2).cast("string"))
    tags = docs.select((F.col("doc_id") % 5).alias("t")).distinct()
    names = _statement("tags", F.col("t").cast("string"), F.concat(F.lit("'tag "), F.col("t").cast("string"), F.lit("'")), (F.col("t") % 2).cast("string"))
    groups = _statement("super_tags", F.col("t").cast("string"), F.concat(F.lit("'group "), F.col("t").cast("string"), F.lit("'")))
    lines = _lines(docs, F.col("doc_id") + 10, post).unionByName(_lines(tags, F.col("t"), names)).unionByName(_lines(tags.filter("t < 2"), F.col("t") + 5, groups))
    got = D.tables(lines, {"viral_messages": "id bigint, message string, caption string, tag int, sentiment int", "tags": "id int, name string, group_id int", "super_tags": "id int, name string"})
    merged, named = D.tagged_corpus(got["viral_messages"], got["tags"], got["super_tags"])
    again = D.corpus_from_json(D.corpus_json(merged))
    each = again.select(F.md5("text").alias("digest"), F.array_join("ids", ",").alias("ids"), F.explode("tags").alias("tag", "n"), F.coalesce(F.element_at("sentiments", 1), F.lit(0)).alias("positive"))
    return each.join(named, F.col("tag") == F.col("id")).select("digest", "ids", "name", "group", "n", "positive")


_ANNOTATED = f"""WITH t AS (SELECT l.doc_id, l.toxic, {_tidied("coalesce(d.text, '')")} AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT row_number() OVER (ORDER BY doc_id DESC) - 1 AS order_no, CAST(doc_id AS VARCHAR) AS id, CAST(toxic AS INT) AS label, md5({_tidied('substring(s, 1, 2000)')}) AS digest FROM t"""
_CORPUS = f"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 OR coalesce(text, '') = '' THEN 'caption ' || coalesce(lang, '?') ELSE replace(text, chr(92) || 'n', chr(10)) END AS s, doc_id % 5 AS tag, doc_id % 4 - 2 AS v FROM documents),
u AS (SELECT *, {_tidied('s')} AS x FROM p), t AS (SELECT *, {_tidied('substring(x, 1, 2000)')} AS text FROM u),
g AS (SELECT text, string_agg(CAST(doc_id * 10 AS VARCHAR), ',' ORDER BY doc_id) AS ids, count(*) FILTER (v = 1) AS positive FROM t WHERE text <> '' GROUP BY text)
SELECT md5(g.text) AS digest, any_value(ids) AS ids, 'tag ' || tag AS name, 'group ' || (tag % 2) AS "group", count(*) AS n, any_value(positive) AS positive FROM g JOIN t ON g.text = t.text GROUP BY g.text, tag"""

TABLE = {"annotated_posts": (annotated_posts, _ANNOTATED), "dump_corpus": (dump_corpus, _CORPUS)}
