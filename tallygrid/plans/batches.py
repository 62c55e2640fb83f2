"""Queries of batches with a fixed make-up: customers as items, one in five an edit of the customer before, segments as goals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.operators import batches as B
from tallygrid.sources.readers import table

_PASSES, _QUOTA, _BATCHES, _SEED = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 1, "HOUSEHOLD": 1, "MACHINERY": 3}, {"choice": 7, "bool": 4, "score": 3}, 120, "batches"


def _units(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    kind = F.when(key % 7 < 4, "choice").when(key % 7 < 6, "bool").otherwise("score")
    return B.pair_units(c.select(key.alias("key"), F.when(key % 5 == 1, key - 1).alias("contrast"), F.trim("c_mktsegment").alias("goal"), kind.alias("qtype")), _PASSES)


def type_quota_batches(spark, d):
    return B.type_quota(_units(spark, d), _QUOTA, _BATCHES, _SEED).select("unit", "qtype", "size", "round", "batch_no", "half")


def pair_strata_batches(spark, d):
    return B.pair_strata(_units(spark, d), 4, 24, _BATCHES, _SEED).select("unit", "goal", "size", "round", "batch_no")


_ITEMS = f"""WITH i AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 1 THEN c_custkey - 1 END AS contrast, trim(c_mktsegment) AS goal, CASE WHEN c_custkey % 7 < 4 THEN 'choice' WHEN c_custkey % 7 < 6 THEN 'bool' ELSE 'score' END AS qtype FROM customer),
p AS (SELECT i.*, g.n FROM i JOIN (VALUES {', '.join(f"('{g}', {n})" for g, n in _PASSES.items())}) g(goal, n) ON i.goal = g.goal),
u AS (SELECT e.key AS unit, CASE WHEN s.key IS NULL THEN 1 ELSE 2 END AS size, coalesce(s.goal, e.goal) AS goal, coalesce(s.qtype, e.qtype) AS qtype, greatest(e.n, coalesce(s.n, 0)) AS n FROM p e LEFT JOIN p s ON e.contrast = s.key WHERE e.contrast IS NOT NULL
UNION ALL SELECT key, 1, goal, qtype, n FROM p WHERE contrast IS NULL AND key NOT IN (SELECT contrast FROM p WHERE contrast IS NOT NULL)),
c AS (SELECT *, unnest(range(1, n + 1)) AS copy FROM u)"""
_ORDER = f"sha256('{_SEED}|' || round || '|' || copy || '|' || unit)"
_TYPES = f"""{_ITEMS},
k AS (SELECT qtype, count(*) FILTER (size = 1) AS s, count(*) FILTER (size = 2) AS p, count(*) FILTER (size = 1) + 2 * count(*) FILTER (size = 2) AS slots FROM c GROUP BY qtype),
q AS (SELECT k.*, v.q, (v.q // 2) * slots >= p * v.q AS enough FROM k JOIN (VALUES {', '.join(f"('{t}', {n})" for t, n in _QUOTA.items())}) v(qtype, q) ON k.qtype = v.qtype),
m AS (SELECT qtype, m, q, CASE WHEN enough THEN m * p * q // slots ELSE m * (q // 2 + 1) - m * s * (q // 2 + 1) // (s + p) END AS pairs, CASE WHEN enough THEN m * q - 2 * (m * p * q // slots) ELSE m * s * (q // 2 + 1) // (s + p) END AS singles, enough FROM q, (SELECT unnest(range(0, {_BATCHES} + 1)) AS m)),
w AS (SELECT a.qtype, a.m AS batch_no, b.enough, b.q, a.pairs AS p0, b.pairs AS p1, a.singles AS s0, b.singles AS s1 FROM m a JOIN m b ON a.qtype = b.qtype AND b.m = a.m + 1),
r AS (SELECT c.*, unnest(range(0, 1 + CAST(ceil({_BATCHES} * q.q / CAST(least(slots, s + p) AS DOUBLE)) AS BIGINT))) AS round, CASE WHEN size = 1 THEN q.s ELSE q.p END AS each FROM c JOIN q ON c.qtype = q.qtype),
x AS (SELECT *, row_number() OVER (PARTITION BY qtype, size, round ORDER BY {_ORDER}) - 1 + round * each AS ix FROM r)
SELECT unit, x.qtype, CAST(size AS INT) AS size, CAST(round AS INT) AS round, batch_no, size = 2 AND NOT enough AND ix = p1 - 1 AND s0 = s1 AS half FROM x JOIN w ON x.qtype = w.qtype AND CASE WHEN size = 1 THEN ix >= s0 AND ix < s1 ELSE ix >= p0 AND ix < p1 END"""
_STRATA = f"""{_ITEMS},
t AS (SELECT *, CASE WHEN size = 2 THEN 'pairs' ELSE goal END AS stratum FROM c), k AS (SELECT stratum, count(*) AS each FROM t GROUP BY stratum),
d AS (SELECT *, 16 * each / CAST(sum(each) OVER () AS DOUBLE) AS due FROM k WHERE stratum <> 'pairs'),
q AS (SELECT stratum, each, floor(due) + CASE WHEN row_number() OVER (ORDER BY floor(due) - due, stratum) <= 16 - sum(floor(due)) OVER () THEN 1 ELSE 0 END AS quota FROM d UNION ALL SELECT stratum, each, 4 FROM k WHERE stratum = 'pairs'),
r AS (SELECT t.*, k.each, k.quota, unnest(range(0, 1 + CAST(ceil({_BATCHES} * k.quota / k.each) AS BIGINT))) AS round FROM t JOIN q k ON t.stratum = k.stratum),
x AS (SELECT *, row_number() OVER (PARTITION BY stratum, round ORDER BY {_ORDER}) - 1 + round * each AS ix FROM r)
SELECT unit, goal, CAST(size AS INT) AS size, CAST(round AS INT) AS round, CAST(floor(ix / quota) AS BIGINT) AS batch_no FROM x WHERE floor(ix / quota) < {_BATCHES}"""

TABLE = {"type_quota_batches": (type_quota_batches, _TYPES), "pair_strata_batches": (pair_strata_batches, _STRATA)}
