"""Relational and time-window extensions over the star schema and the events; no part of the reference's own operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.operators import metrics as E
from tallygrid.plans.base import SCORED, features, rounded
from tallygrid.sources.readers import table
from tallygrid.streaming import sessions, windowed_values


def rollup_family(spark, d):
    f = features(spark, d).withColumn("half", (F.col("row_id") % 2).cast("int"))
    out = f.rollup("half", "family").agg(F.count(F.lit(1)).alias("n"), E.share(F.col("correct")).alias("accuracy"), F.grouping_id().alias("level"))
    return rounded(out)


def join_revenue(spark, d):
    """Orders, customers and nations by revenue; the small sides are dimensions that Spark broadcasts by their size."""
    l, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    r = l.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r")).groupBy("l_orderkey").agg(F.sum("r").alias("r"))
    out = r.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(out.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.sum("r").alias("revenue")), 2)


def pricing_summary(spark, d):
    l = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rounded(l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count(F.lit(1)).alias("n")), 2)


def event_windows(spark, d):
    return rounded(windowed_values(table(spark, d, "events")), 4)


def event_sessions(spark, d):
    return rounded(sessions(table(spark, d, "events"), "6 hours"), 4)


def json_paths(spark, d):
    e = table(spark, d, "events")
    keys = F.json_object_keys("props")
    return e.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


TABLE = {
    "rollup_family": (rollup_family, SCORED + "SELECT CAST(row_id % 2 AS INT) AS half, family, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy, grouping(row_id % 2, family) AS level FROM f GROUP BY ROLLUP (row_id % 2, family)"),
    "join_revenue": (join_revenue, "SELECT n_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "pricing_summary": (pricing_summary, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 2) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"),
    "event_windows": (event_windows, "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 4) AS largest FROM events GROUP BY 1, 2"),
    "event_sessions": (event_sessions, "WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k"),
    "json_paths": (json_paths, "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key"),
}
