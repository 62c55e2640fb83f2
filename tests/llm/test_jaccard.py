import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import jaccard as J
from tallygrid.llm import staging


def brute(texts, percent, width):
    sets = {}
    for d, t in texts.items():
        w = (t or "").lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def corpus(seed):
    """Families with few and many edits, chains, families around the threshold, short texts, nulls and equal rows."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randrange(400))
    texts = {}
    for _ in range(14):
        base = [word() for _ in range(rnd.choice([5, 9, 20, 45, 90, 200]))]
        for _ in range(rnd.randint(1, 9)):
            edited = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, len(base) // 25])):
                edited[rnd.randrange(len(edited))] = word()
            texts[len(texts)] = " ".join(edited)
            if rnd.random() < 0.3:
                base = edited
    for t in (None, "", " \n\t", "one", "One", "one two", "one two three", "one two three four", texts[0], texts[0], texts[1].upper()):
        texts[len(texts)] = t
    return texts


@pytest.mark.parametrize("seed,percent,width,chunk", [(1, 85, 4, 1024), (2, 85, 4, 4), (3, 80, 5, 3)])
def test_equals_all_pairs(spark, monkeypatch, seed, percent, width, chunk):
    monkeypatch.setattr(J, "CHUNK", chunk)
    texts = corpus(seed)
    rows = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, cluster int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(rows, percent=percent, width=width).collect()}
    assert got == brute(texts, percent, width)


def test_shuffled_where_nothing_may_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(staging, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(J, "CHUNK", 6)
    texts = corpus(4)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(rows).collect()} == brute(texts, 85, 4)


@pytest.mark.parametrize("percent,width", [(85, 4), (80, 5)])
def test_empty_table(spark, percent, width):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.join(empty, percent=percent, width=width).collect() == []
    assert J.keep_one(empty, percent=percent, width=width).collect() == []


def family(rnd, n):
    """One unit of n documents, loosely similar: some link with the base, some with one another only, most with none."""
    base = [f"w{i}" for i in range(120)]
    texts = {0: " ".join(base)}
    while len(texts) < n:
        edited = list(base)
        for at in rnd.sample(range(120), rnd.choice([0, 1, 2, 3, 4, 5, 5, 5, 6, 7, 8])):
            edited[at] = f"x{rnd.randrange(3000)}"
        for _ in range(rnd.choice([1, 1, 1, 2])):  # a few partners of their own
            texts[len(texts)] = " ".join(edited)
            edited[rnd.randrange(120)] = f"y{len(texts)}"
    return texts


def brute_large(texts, percent, width):
    """The same as `brute` by bit masks."""
    bit, sets = {}, {}
    for d, t in texts.items():
        w = t.split()
        sets[d] = sum({1 << bit.setdefault(tuple(w[i : i + width]), len(bit)) for i in range(len(w) - width + 1)})
    size = {d: s.bit_count() for d, s in sets.items()}
    ids, label = list(sets), {d: d for d in sets}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if label[a] != label[b] and 100 * (c := (sets[a] & sets[b]).bit_count()) >= percent * (size[a] + size[b] - c):
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    return {d: (size[d], label[d]) for d in sets}


def test_one_unit_of_thousands(spark):
    texts = family(random.Random(3), 2600)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(rows, percent=85, width=2).collect()}
    assert got == brute_large(texts, 85, 2)
    assert 50 < len({c for _, c in got.values()}) < 2500


def test_one_unit_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(J, "UNIT_BYTES", 1 << 17)  # ten documents
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(1500)]
    texts = {}
    for d in range(60):
        edited = list(base)
        for at in rnd.sample(range(1500), rnd.choice([10, 30, 60, 90, 110])):
            edited[at] = f"x{rnd.randrange(400)}"
        texts[d] = " ".join(edited)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(rows, percent=85, width=2).collect()} == brute_large(texts, 85, 2)


def thue_morse(bits, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(1 << bits))


def test_words_that_collide_in_polynomial_hashes(spark):
    one, two = thue_morse(11), thue_morse(11, "b", "a")
    texts = {1: f"{one} p q r s", 2: f"{two} p q r s", 3: f"{one} p q r s", 4: one, 5: two}
    got = {r.doc_id: r.component_id for r in J.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


ROWS = [
    (1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (1, "a b c d e f", "y"),  # repeated rows
    (2, "k l m n o p", "x"), (2, "q r s t u v", "x"),  # one id, two texts
    (None, "a b c d e f", "x"), (None, "w1 w2 w3 w4", "x"), (None, "W1 w2 w3 w4", "z"), (None, None, "x"),
    (9, "w5 w6 w7 w8", "x"), (7, "w5  w6 w7 w8", "x"), (7, "w5  w6 w7 w8", "x"), (8, "", "x"), (8, "", "x"),
]


@pytest.mark.parametrize("limit", [48 << 20, 0])
def test_repeated_rows_and_null_ids_stay_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(staging, "BROADCAST_BYTES", limit)
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, part string").repartition(3).withColumns({c: F.lit(1) for c in ("set", "keys", "id", "text_key", "cls", "hub", "component")})
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.join(rows).collect()), key=str)
    want = [(1, 3, 1)] * 3 + [(2, 3, 2)] * 2 + [(None, 3, 1), (None, 1, None), (None, 1, None), (None, 0, None), (9, 1, 7), (7, 1, 7), (7, 1, 7), (8, 0, 8), (8, 0, 8)]
    assert got == sorted(want, key=str)
    kept = J.keep_one(rows)
    assert kept.schema == rows.schema
    got = sorted(((r.doc_id, r.text, r.part) for r in kept.collect()), key=str)
    first = [r for r in got if r[0] is None and r[1] and r[1].lower() == "w1 w2 w3 w4"]
    assert len(first) == 1
    want = [(1, "a b c d e f", "x"), (2, "k l m n o p", "x"), (2, "q r s t u v", "x"), (None, None, "x"), (7, "w5  w6 w7 w8", "x"), (8, "", "x"), (8, "", "x"), *first]
    assert got == sorted(want, key=str)


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(400_000))
    texts = {1: long, 2: long.replace("w9 ", "z "), 3: long[: len(long) // 2], 4: "x" * 3_000_000, 5: "x" * 2_999_999}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    half = len(texts[3].split()) - 3
    assert got == {1: (399_997, 1), 2: (399_997, 1), 3: (half, 3), 4: (1, 4), 5: (1, 5)}


def test_divide_skip_finds_all_partners():
    rnd = np.random.default_rng(5)
    base = rnd.choice(1 << 30, 300, replace=False).astype(np.uint64)
    sets = []
    for _ in range(120):
        s = base.copy()
        n = rnd.integers(0, 60)
        s[rnd.choice(300, n, replace=False)] = rnd.choice(1 << 30, n)
        sets.append(np.unique(s))
    lists = J.Lists(sets)
    for q, s in enumerate(sets):
        want = [p for p, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 85 * len(np.union1d(s, t))]
        assert sorted(lists.search(s, np.ones(len(sets), dtype=bool), 85)) == want, q


def test_pairs_share_a_class():
    sizes = J.Sizes(85)
    sizes.grow(3000)
    for a in range(1, 2000):
        for b in {a, a + 1, a * 100 // 85}:
            if b >= a and (d := J.differences(a, b, 85)):
                ok = (sizes.least <= a) & (sizes.most >= b)
                assert ok.any(), (a, b)
                assert (sizes.segments[ok] >= d + sizes.slack[ok]).any()


@pytest.mark.parametrize("grain", [J.COARSE, J.FINE])
def test_linked_pairs_share_the_keys_they_need(grain):
    rnd = np.random.default_rng(11)
    sizes, mixed = J.Sizes(85, *grain), 0
    for _ in range(5000):
        n = int(rnd.integers(4, 120))
        union = rnd.integers(0, 1 << 63, n).astype(np.uint64)
        differ = rnd.integers(1, max(1, n * 15 // 100) + 1)
        cut = rnd.integers(0, differ + 1)
        sets = [np.unique(union[cut:]), np.unique(np.concatenate([union[:cut], union[differ:]]))]
        if 100 * len(np.intersect1d(*sets)) < 85 * len(np.union1d(*sets)) or np.array_equal(*sets):
            continue
        key, size, row, need = J.keys(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), sizes)
        group = np.repeat(np.arange(len(size)), size)
        _, kind = sizes.of(np.array([len(s) for s in sets]))
        for c in np.unique(kind):
            pair = [g for g in np.flatnonzero(kind == c)]
            if len(pair) == 2:
                common = len(np.intersect1d(key[group == pair[0]], key[group == pair[1]]))
                assert need[pair].min() >= 1 and common >= need[pair].max(), (sets, c)
                emits = [np.count_nonzero(group == g) == sizes.segments[c] for g in pair]
                mixed += emits[0] != emits[1]
    assert mixed


@pytest.mark.parametrize("times", [1, 2, 5])
def test_rare_shingles_of_rows_that_several_tasks_read(spark, times):
    """Every two linked sets of a large unit share a key by their rarest shingles, however often their rows are read."""
    rnd = np.random.default_rng(4)
    base = rnd.integers(1, 1 << 40, 100)
    sets = {k: np.sort(np.concatenate([base[: 92 + k % 3], rnd.integers(1 << 41, 1 << 42, 8 - k % 3)])) for k in range(6)}
    sets[6] = np.sort(rnd.integers(1 << 43, 1 << 44, 40))
    rows = [(1, k, len(s), bytearray(s.astype("<i8").tobytes()), True) for k, s in sets.items() for _ in range(times)]
    large = spark.createDataFrame(rows, "hub long, id long, n long, set binary, asks boolean").repartition(4).select("hub", "id", "n", "asks", "set")
    keys = {}
    for r in J._by_tokens(large, 85).collect():
        keys.setdefault(r.id, []).append(r.key)
    for a in sets:
        assert len(set(keys.get(a, []))) == len(keys.get(a, []))
        for b in sets:
            both = len(np.intersect1d(sets[a], sets[b]))
            if a < b and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                assert set(keys[a]) & set(keys[b])
    assert times > 1 or 6 not in keys


def test_repeated_rows_in_large_units(spark, monkeypatch):
    """Families that no hub connects, every row read several times by different tasks."""
    monkeypatch.setattr(J, "CHUNK", 6)
    texts = corpus(5)
    rows = spark.createDataFrame([(d, t) for d, t in texts.items()] * 3, "doc_id long, text string").repartition(6)
    want = brute(texts, 85, 4)
    got = J.join(rows).collect()
    assert len(got) == 3 * len(texts) and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
