"""Queries of stored selections, configurations and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.operators import stored as S
from tallygrid.sources.readers import table


def selection_check(spark, d):
    """Documents of even number are a selection; later some of their texts have changed and some are gone."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    selection = S.build_selection(docs.filter("doc_id % 2 = 0"), ["doc_id"], ["text", "source"])
    later = docs.filter("doc_id % 11 <> 4").withColumn("text", F.when(F.col("doc_id") % 9 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return S.check_selection(selection, later, ["doc_id"], ["text", "source"]).select("doc_id", "problem")


def config_diff(spark, d):
    """An event's properties beside the event, and the same with keys renamed, retyped, nested and changed."""
    e = table(spark, d, "events")
    old = F.to_json(F.struct(F.col("user_id").alias("user"), F.struct(F.col("event_type").alias("type"), F.array("event_id", "user_id").alias("ids")).alias("event"), F.lit("w").alias("worker")))
    new = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).otherwise(F.lit("u")).alias("user"), F.struct(F.concat("event_type", F.when(F.col("event_id") % 2 == 0, "").otherwise("?")).alias("type"), F.array("event_id").alias("ids")).alias("event"), F.lit("v").alias("worker"), F.col("event_id").alias("seed")))
    return S.config_diff(e.select("event_id", old.alias("c")), e.select("event_id", new.alias("c")), "event_id", "c", ("$.worker",))


def pair_links(spark, d):
    """Customers in tens; an odd one is the other half of the one before it."""
    key = F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.floor(key / 10).alias("ten"), key.alias("key"), F.when(key % 2 == 1, key - 1).alias("other_of"))
    return S.link_pairs(rows, ["ten"]).select("ten", "key", "pair")


TABLE = {
    "selection_check": (selection_check, "SELECT doc_id, CASE WHEN doc_id % 11 = 4 THEN 'missing' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 2 = 0 AND (doc_id % 11 = 4 OR doc_id % 9 = 3)"),
    "config_diff": (config_diff, """SELECT event_id, '$.user' AS path, 'retyped' AS difference, CAST(user_id AS VARCHAR) AS old, CASE WHEN event_id % 3 = 0 THEN '"' || user_id || '"' ELSE '"u"' END AS new FROM events
UNION ALL SELECT event_id, '$.event.type', 'changed', '"' || event_type || '"', '"' || event_type || '?"' FROM events WHERE event_id % 2 <> 0
UNION ALL SELECT event_id, '$.event.ids[1]', 'missing', CAST(user_id AS VARCHAR), NULL FROM events UNION ALL SELECT event_id, '$.seed', 'added', NULL, CAST(event_id AS VARCHAR) FROM events"""),
    "pair_links": (pair_links, "SELECT c_custkey // 10 AS ten, c_custkey AS key, CASE WHEN c_custkey % 2 = 1 THEN c_custkey - 1 WHEN c_custkey < (SELECT max(c_custkey) FROM customer) THEN c_custkey + 1 END AS pair FROM customer"),
}
