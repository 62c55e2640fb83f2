import hashlib

import numpy as np
import pytest

from tallygrid.llm import staging
from tallygrid.llm import vectors as V
from tallygrid.llm import yinyang as Y

DIMS, PARTS = 8, 4
SCHEMA = "vec_id long, embedding array<double>, label string, code string, v string, lower string, error string, _label string, vector int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], label, *"zzzzz", 1) for i, x, label in rows], SCHEMA).repartition(3)


def brute(rows, entries, rounds):
    keep = [(i, np.floor(1024 * np.array(x)).astype(int).tolist(), label) for i, x, label in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    if not keep:
        return []
    w = DIMS // PARTS
    first = sorted(keep, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * w : p * w + w] for _, v, _ in first] for p in range(PARTS)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(v[p * w : p * w + w], e, strict=True)), n) for n, e in enumerate(books[p]))
    for _ in range(rounds):
        own = [[near(v, p)[1] for _, v, _ in keep] for p in range(PARTS)]
        books = [[[sum(c) // len(c) for c in zip(*g, strict=True)] if (g := [v[p * w : p * w + w] for (_, v, _), o in zip(keep, own[p], strict=True) if o == n]) else e for n, e in enumerate(books[p])] for p in range(PARTS)]
    coded = [(i, [near(v, p) for p in range(PARTS)], label) for i, v, label in keep]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = lambda c: sum(d for d, _ in c)
    return sorted([(i, "".join(f"{n:02x}" for _, n in c), error(c), sum(error(o) for _, o, k in coded if k == label), digest) for i, c, label in coded], key=str)


def vectors(n, seed=0):
    r = np.random.default_rng(seed)
    return [(int(k), (r.integers(-3, 4, DIMS) / 16 + r.normal(0, 0.01, DIMS)).tolist(), "ab"[k % 2] if k % 5 else None) for k in range(n)]


CASES = {
    "blobs": vectors(300),
    "ties": [(k, [(k % 7) / 1024 * 2, (k % 5) / 1024 * 2] * 4, "a") for k in range(70)],
    "equal": [(k, [0.25] * DIMS, None) for k in range(30)],
    "hot copies": [*vectors(60), *[(100 + k, [1.0] * DIMS, "hot") for k in range(100)]],
    "repeated and null ids": [*vectors(20), *vectors(20), (None, [0.5] * DIMS, "a"), (None, [0.75] * DIMS, None), (None, None, None)],
    "unusable": [*vectors(20), (50, None, "a"), (54, [1, None] * 4, "a"), (55, [1, float("nan")] * 4, "a"), (56, [float("-inf")] * 8, None)],
    "fewer than entries": vectors(5),
    "nothing usable": [(1, None, "a")],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("entries", [3, 40])
def test_equals_full_scans(spark, monkeypatch, case, entries):
    if entries == 3:
        monkeypatch.setattr(staging, "BROADCAST_BYTES", 0)
    got, books = Y.compress(frame(spark, CASES[case]), parts=PARTS, entries=entries, rounds=3, dims=DIMS, groups=6)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(CASES[case], entries, 3)


def test_bounds_skip_scans_and_change_no_code():
    """Lloyd over one part: every round as a full scan says, ties included, and after the first with fewer distances."""
    r = np.random.default_rng(3)
    x = (r.integers(-5, 6, (4000, 4)) * 40 + r.integers(-4, 5, (4000, 4))).astype(np.int64)
    book = Y.Codebook.first(x[:96].copy(), 12)
    code, lower, done = np.zeros(len(x), dtype=np.int64), np.zeros((len(x), 12), dtype=np.int64), []
    for _ in range(8):
        code, best, lower, n = book.assign(x, code, lower)
        apart = V.distances(x, book.entries)
        assert (code == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()
        others = np.where(np.arange(96)[None, :] == code[:, None], np.iinfo(np.int64).max, apart)
        for g, members in enumerate(book.members):
            assert (lower[:, g] ** 2 <= others[:, members].min(axis=1)).all()
        done.append(n / apart.size)
        book = book.moved(V.means(book.entries, {k: (int((code == k).sum()), x[code == k].sum(axis=0).tolist()) for k in np.unique(code).tolist()}))
    assert done[-1] < 0.35 < done[0]


def test_codes_expand_to_near_vectors(spark):
    rows = vectors(200)
    codes, books = Y.compress(frame(spark, rows), parts=PARTS, entries=200, rounds=2, dims=DIMS)
    got = {r.vec_id: (r.vector, r.error) for r in Y.expand(codes, books).collect()}
    assert len(got) == 200
    for i, x, _ in rows:
        vector, error = got[i]
        assert sum((a - b) ** 2 for a, b in zip(x, vector, strict=True)) ** 0.5 <= error**0.5 / 1024 + DIMS**0.5 / 1024


def test_large_components_and_other_lengths(spark):
    rows = [(k, [15_000 * (k % 3), -29_999] * 4, "a") for k in range(12)]
    got, _ = Y.compress(frame(spark, rows), parts=PARTS, entries=4, rounds=2, dims=DIMS)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 4, 2)
    with pytest.raises(Exception, match="has not 8 components but 7"):
        Y.compress(frame(spark, [(1, [0.0] * 7, "a")]), dims=DIMS)
    with pytest.raises(Exception, match="vector component"):
        Y.compress(frame(spark, [(1, [1e300] * 8, "a")]), dims=DIMS)
