import hashlib

import numpy as np
import pytest

from tallygrid.llm import sortmeans as S
from tallygrid.llm import vectors as V

DIMS = 4
SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster string, distance string, vector int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], 0, "z", "z", "z", 1) for i, x in rows], SCHEMA).repartition(3)


def brute(rows, k, rounds):
    keep = [(i, np.floor(256 * np.array(x, dtype=np.float32).astype(np.float64)).astype(int).tolist()) for i, x in rows if x is not None and len(x) == DIMS and all(c is not None and np.isfinite(c) for c in x)]
    if not keep:
        return []
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(keep, key=key)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in keep]
        centres = [[sum(col) // len(col) for col in zip(*g, strict=True)] if (g := [v for (_, v), o in zip(keep, own, strict=True) if o == n]) else c for n, c in enumerate(centres)]
    last = [(i, *nearest(v)) for i, v in keep]
    inertia = lambda n: sum(d for _, d, c in last if c == n)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, c, d, inertia(c), sum(x[1] for x in last), digest[c]) for i, d, c in last], key=str)


def vectors(n, seed=0, spread=0.01):
    r = np.random.default_rng(seed)
    return [(int(k), (r.integers(-4, 5, DIMS) / 8 + r.normal(0, spread, DIMS)).tolist()) for k in range(n)]


CASES = {
    "blobs": vectors(300),
    "ties": [(k, [x / 256, y / 256, 0, 0]) for k, (x, y) in enumerate((x, y) for x in range(-8, 8, 2) for y in range(-8, 8, 2))],
    "equal": [(k, [0.5, 0.5, 0.5, 0.5]) for k in range(30)],
    "hot copies": [*vectors(40), *[(100 + k, [1, 1, 1, 1]) for k in range(100)]],
    "repeated and null ids": [*vectors(20), *vectors(20), (None, [0, 0, 0, 1]), (None, [0, 0, 0, 2]), (None, None)],
    "unusable": [*vectors(20), (50, None), (51, []), (52, [1, 2, 3]), (53, [1, 2, 3, 4, 5]), (54, [1, None, 3, 4]), (55, [1, float("nan"), 3, 4]), (56, [1, float("inf"), 3, 4])],
    "fewer than k": vectors(5),
    "one": vectors(1),
    "nothing usable": [(1, None), (None, [1, 2, None, 4])],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("k", [1, 12])
def test_equals_full_scans(spark, case, k):
    got = S.cluster(frame(spark, CASES[case]), k=k, rounds=3, dims=DIMS)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(CASES[case], k, 3)


def test_scans_stop_and_lose_no_tie():
    """Integer points around integer centroids, from every previous assignment: as a full scan says, with fewer distances."""
    r = np.random.default_rng(1)
    centroids = r.integers(-6, 7, (30, 3)) * 20
    x = np.concatenate([centroids.repeat(30, axis=0) + r.integers(-3, 4, (900, 3)), (centroids[:-1] + centroids[1:]) // 2])
    apart = V.distances(x, centroids)
    order = S.Order(centroids)
    for before in (np.zeros(len(x), dtype=np.int64), r.integers(0, 30, len(x)), apart.argmin(axis=1), apart.argmax(axis=1)):
        cluster, distance = order.assign(x, before)
        assert (cluster == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()
    own = V.row_distances(x, centroids[apart.argmin(axis=1)])
    looked = sum(int(np.searchsorted(order.apart[a], 4 * d, side="right")) for a, d in zip(apart.argmin(axis=1), own, strict=True))
    assert looked < 0.3 * apart.size


def test_large_components(spark):
    rows = [(k, [60_000 * (k % 3), -99_999, k, 0]) for k in range(12)]
    got = S.cluster(frame(spark, rows), k=3, rounds=2, dims=DIMS)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 3, 2)
    with pytest.raises(Exception, match="vector component"):
        S.cluster(frame(spark, [(1, [1e30, 0, 0, 0])]), dims=DIMS).collect()


def test_distances_and_roots_are_exact():
    r = np.random.default_rng(2)
    for most in (100, 1 << 20, (1 << 25) - 1):
        x, y = r.integers(-most, most + 1, (50, 16)), r.integers(-most, most + 1, (7, 16))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in y] for p in x]
        assert V.distances(x, y).tolist() == want
    for s in [0, 1, 2, 3, 4, *[(1 << k) + d for k in range(2, 61, 3) for d in (-1, 0, 1)], *[q * q + d for q in (94906267, 1 << 30) for d in (-1, 0, 1)]]:
        low, high = int(V.root_below(np.array([s]))[0]), int(V.root_above(np.array([s]))[0])
        assert low * low <= s < (low + 1) ** 2 and high == low + (low * low < s)
