import math
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallygrid.llm import mix as X
from tallygrid.llm import staging

SCHEMA = "doc_id long, text string, source string, size string, target int, copies int, rank int, _of string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1, 1, 1, "z") for r in rows], SCHEMA)


def words(n):
    return "\t ".join(["wörd"] * n)


ROWS = [(k, words(1 + k * 7 % 90), f"s{k % 5}") for k in range(300)]
ROWS += [(1000 + k, words(3), "tiny") for k in range(4)] + [(2000 + k, words(40), "hot") for k in range(250)] + [(None, words(9), None), (None, None, None), (3000, "", "blank"), (3001, " \n", "blank"), (3002, words(3000), "hot")]
ROWS += [(4000, words(11), "s1")] * 3


def shared(sizes):
    """Targets by repeated rounds of exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, still, left = {}, set(names), Fraction(sum(sizes.values()))
    while still:
        each = {s: left * weight[s] / sum(weight[x] for x in still) for s in still}
        over = {s for s in still if each[s] > 3 * sizes[s]}
        if not over:
            return target | each
        target |= {s: Fraction(3 * sizes[s]) for s in over}
        left -= sum(target[s] for s in over)
        still -= over
    return target


@pytest.mark.parametrize(("limit", "prefer"), [(48 << 20, X.PREFER), (0, lambda size: F.lit(1).cast("bigint"))])
def test_targets_caps_and_nearness(spark, monkeypatch, limit, prefer):
    monkeypatch.setattr(staging, "BROADCAST_BYTES", limit)
    got = X.mix(frame(spark, ROWS), prefer=prefer).collect()
    assert len(got) == len(ROWS)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken == r.copies * r.size <= 3 * r.size
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), len(re.findall(X.WORD, t or ""))) for d, t, _ in ROWS)
    want = shared(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12)
    for s in sizes:
        most = max((r.size for r in got if r.source == s), default=0)
        assert abs(taken[s] - want[s]) <= min(most, max(0.03 * want[s], 5)), s
    assert abs(sum(taken.values()) - sum(sizes.values())) < 0.02 * sum(sizes.values())


def test_reruns_agree_whatever_the_layout(spark):
    docs = frame(spark, ROWS)
    rows = lambda d: sorted(map(str, X.mix(d).collect()))
    first = rows(docs.repartition(7))
    assert first == rows(docs.orderBy(F.desc("doc_id")).coalesce(1)) == rows(docs.repartition(3, "source"))
    assert first != sorted(map(str, X.mix(docs, seed="other").collect()))


def brute(spark, rows):
    """The sample by its definition, one source after the other: rank order, then the document nearest to the gap."""
    got = X.plan(sized := X.sized(frame(spark, rows)), X.WEIGHTS, X.CAP, X.PREFER).collect()
    draws, out = sized.collect(), []
    for s in got:
        own = [r for r in draws if r.source == s.source]
        m = {id(r): 0.0 if not r.size else min(3.0, (s.kappa or math.inf) * math.floor(16 * math.sqrt(r.size))) for r in own}
        if own and s.kappa:
            assert math.isclose(sum(m[id(r)] * r.size for r in own), s.target, rel_tol=1e-9)
        groups = {}
        for r in own:
            p = m[id(r)] % 1
            if p and r.size:
                groups.setdefault(r.u / (1 - r.u) * ((1 - p) / p), []).append(r)
        gap, more, passed, rest = s.rest, set(), [], []
        for rank in sorted(groups):
            n = sum(r.size for r in groups[rank])
            if rest:
                rest.append((rank, n))
            elif n <= gap:
                more.add(rank)
                gap -= n
            elif len(passed) < X.PASSES and gap > s.target / X.OPEN:
                passed.append((rank, n))
            else:
                rest.append((rank, n))
        near = min(((abs(n - gap), rank) for rank, n in passed + rest if abs(n - gap) < gap), default=None) if rest else None
        more |= {near[1]} if near else set()
        out += [(str(r.doc_id), r.size, (int(m[id(r)]) + any(r in g for k, g in groups.items() if k in more)) * r.size) for r in own]
    return sorted(out)


def test_equals_sequential_definition(spark):
    got = sorted((str(r.doc_id), r.size, r.taken) for r in X.mix(frame(spark, ROWS)).collect())
    assert got == brute(spark, ROWS)


def test_a_source_of_few_documents_comes_near(spark):
    """Long documents that do not fit are passed over, early or late in the order."""
    rows = [(k, words(n), "a") for k, n in enumerate([900, 70, 60, 50, 40, 30, 20, 10])] + [(100 + k, words(50), "b") for k in range(60)] + [(200, words(5), "c"), (300, words(2500), "b"), (301, words(1900), "b")]
    got = X.mix(frame(spark, rows)).collect()
    for s in ("a", "b", "c"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(0.05 * own[0].target, 25), s
    assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == brute(spark, rows)


def test_expected_copies_are_met_over_draws(spark):
    """Over several seeds the documents of a source are taken as often as expected, and longer ones more often."""
    rows = [(k, words(4 if k % 2 else 36), "a") for k in range(60)] + [(100 + k, words(30), "b") for k in range(60)]
    sized = X.sized(frame(spark, rows))
    kappa = {r.source: r.kappa for r in X.plan(sized, X.WEIGHTS, X.CAP, X.PREFER).collect()}
    runs = [X.mix(frame(spark, rows), seed=f"seed{k}").filter("source = 'b'").select("doc_id", "copies") for k in range(3)]
    copies = [r.copies for d in runs for r in d.collect()]
    assert math.isclose(sum(copies) / len(copies), kappa["b"] * math.floor(16 * math.sqrt(30)), abs_tol=0.02)
    a = X.mix(frame(spark, rows)).filter("source = 'a'").collect()
    mean = lambda size: sum(r.copies for r in a if r.size == size) / 30
    assert mean(36) > 1.5 * mean(4)


def test_mixed_corpus_repeats_whole_rows(spark):
    docs = frame(spark, ROWS)
    taken = {}
    for r in X.mix(docs).collect():
        taken[str(r.doc_id), r.size] = taken.get((str(r.doc_id), r.size), 0) + r.copies
    out = X.mixed(docs)
    assert out.columns == [*docs.columns, "copy_no"]
    got = {}
    for r in out.collect():
        key = str(r.doc_id), len(re.findall(X.WORD, r.text))
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in taken.items() if n}


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (None, "", None)], [(1, "one", None)], [(5, words(200_000), "a"), (6, "b", "b")]])
def test_small_tables(spark, rows):
    got = X.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.taken <= 3 * r.size for r in got)
    if len(rows) == 1:
        assert (got[0].target, got[0].taken) == (1.0, 1)


def test_no_python_in_the_plan(spark):
    plan = X.mix(frame(spark, ROWS))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
