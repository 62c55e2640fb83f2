import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallygrid.llm import decontaminate as D

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, found, best = split(t), set(), set(), (0, None, None)
        for i, b in items:
            v = split(b)
            wide = min(10, len(v))
            for k in range(len(w)) if v else ():
                for j in range(len(v) - wide + 1):
                    n = 0
                    while k + n < len(w) and j + n < len(v) and w[k + n] == v[j + n]:
                        n += 1
                    if n >= wide and (-n, i, k) < (-best[0], best[1] if best[0] else i, best[2] if best[0] else k + 1):
                        best = (n, i, k)
            windows = {tuple(v[k : k + 10]) for k in range(max(1, len(v) - 9))} if v else set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        hit |= set(range(k, k + n))
                        found.add(i)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit), best[0], str(best[1]) if best[0] else "", best[2] if best[0] else -1))
    return sorted(out, key=str)


def tables(spark, docs, items):
    return spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, items string").withColumns({c: F.lit(1) for c in ("hits0", "longest", "n_words0")}).repartition(3), spark.createDataFrame(items, "item_id long, text string")


def corpus(seed):
    rnd = random.Random(seed)
    prose = lambda n: " ".join(rnd.choice(["the", "of", "Ä", "an", "it"]) + rnd.choice(["", "", "x", "3"]) for _ in range(n))
    items = [(k, prose(rnd.choice([2, 5, 9, 10, 11, 40]))) for k in range(12)] + [(20, None), (21, "!!"), (22, ""), (100, prose(15)), (9, prose(12))]
    docs = []
    for k in range(60):
        part = rnd.choice(items)[1] or ""
        docs.append((k, f"{prose(rnd.randint(0, 60))}. {part.upper() if k % 3 else part}! {prose(rnd.randint(0, 9))}"))
    docs += [(90, None), (91, ""), (92, items[5][1][:-3]), (93, docs[3][1]), (93, docs[3][1]), (94, " ".join([items[0][1]] * 300))]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs, items = corpus(seed)
    a, b = tables(spark, docs, items)
    want = brute(docs, items)
    assert sorted(map(tuple, D.digest(D.scan(a, b)).collect()), key=str) == want
    kept = D.clean(a, b)
    assert kept.columns == a.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in want if not r[5])


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    docs, items = corpus(3)
    a, b = tables(spark, docs, items)
    monkeypatch.setattr(D.blocks, "__defaults__", (120,))
    assert len(list(D.blocks(b, "item_id", "text"))) > 3
    assert sorted(map(tuple, D.digest(D.scan(a, b)).collect()), key=str) == brute(docs, items)


def test_blocks_judge_repeated_rows_and_null_ids_one_by_one(spark, monkeypatch):
    docs, items = corpus(3)
    docs += [(None, docs[0][1]), (None, docs[1][1]), (None, "")]
    a, b = tables(spark, docs, items)
    want = sorted((str(r[1:]), str(r[0])) for r in brute([(-1 if d is None else d, t) for d, t in docs], items))
    monkeypatch.setattr(D.blocks, "__defaults__", (120,))
    got = sorted((str(tuple(r)[1:]), str(-1 if r.doc_id is None else r.doc_id)) for r in D.digest(D.scan(a, b)).collect())
    assert got == want


def test_longest_matches(spark):
    docs = [(1, "zz a b c d e f g yy"), (2, "q a b c d e f g h i j k z"), (3, "b c d e")]
    a, b = tables(spark, docs, [(7, "a b c d e f g h i j k l")])
    got = {r.item_pos: (r.length, r.doc_id, r.doc_pos) for r in D.longest_matches(a, b).collect()}
    assert got[0] == (11, 2, 1) and got[7] == (4, 2, 8) and 8 not in got


@pytest.mark.parametrize("kind,name", [("int", 7), ("smallint", 7), ("string", "seven")])
def test_kinds_of_item_ids(spark, kind, name):
    docs = spark.createDataFrame([(1, "x a b c d e")], "doc_id int, text string")
    items = spark.createDataFrame([(name, "a b c d e f")], f"item_id {kind}, text string")
    assert [tuple(r) for r in D.longest_matches(docs, items).orderBy("item_pos").collect()] == [(name, 0, 5, 1, 1), (name, 1, 4, 1, 2)]
    items = spark.createDataFrame([(name, "a b c d e")], f"item_id {kind}, text string")
    row = D.scan(docs, items).collect()[0]
    assert (row.items, row.longest, row.longest_item, row.longest_at) == ([name], 5, name, 1)


def test_very_long_text(spark):
    item = " ".join(f"i{k}" for k in range(30))
    text = "zz " * 600_000 + item + " zz" * 300_000
    a, b = tables(spark, [(1, text), (2, text.replace("i15", "no"))], [(7, item)])
    got = {r.doc_id: (r.n_words, r.n_hit, r.longest, r.longest_at) for r in D.digest(D.scan(a, b)).collect()}
    assert got == {1: (900_030, 30, 30, 600_000), 2: (900_030, 29, 15, 600_000)}


def test_empty_tables(spark):
    a, b = tables(spark, [(1, "a b")], [(1, "c")])
    assert D.digest(D.scan(a.limit(0), b)).count() == 0
    assert [r.contaminated for r in D.digest(D.scan(a, b.limit(0))).collect()] == [False] and D.clean(a, b.limit(0)).count() == 1
