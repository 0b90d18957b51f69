import hashlib

import numpy as np
import pytest

from beaconloom.llm import centroids
from beaconloom.llm.centroids import Simplex, bounds, cluster, nearest


def brute(rows, count=16, rounds=3, width=64):
    kept = [
        (i, tuple(int(np.floor(64 * float(x))) for x in v))
        for i, v in rows
        if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [list(v) for _, v in order[:count]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(middle))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in range(len(middle)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if members:
                middle[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    final = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, c, d in final if c == k) for k in range(len(middle))]
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle]
    return sorted(((i, c, d, inertia[c], sum(inertia), digest[c]) for i, c, d in final), key=repr)


def found(df, **options):
    return sorted(map(tuple, cluster(df, **options).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS cluster", "1 AS distance", "2 AS apex")


def blobs(n, seed, width=64):
    rng = np.random.default_rng(seed)
    heart = rng.normal(size=(9, width))
    return [(int(i), (heart[rng.integers(9)] + 0.2 * rng.normal(size=width)).tolist()) for i in range(n)]


def test_bounds_hold_the_distance():
    rng = np.random.default_rng(1)
    points = rng.integers(-200, 200, (60, 64))
    simplex = Simplex(points[:16])
    assert len(simplex.pivots) == centroids.PIVOTS
    apexes, _ = simplex.apexes(points)
    low, high = bounds(apexes, apexes)
    true = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    assert (low <= true + 1e-6 * true.max()).all() and (high >= true - 1e-6 * true.max()).all()


def test_pivots_that_lie_in_one_plane_are_passed_over():
    line = np.arange(16)[:, None] * np.ones((1, 64), np.int64)
    assert len(Simplex(line.astype(np.int64)).pivots) == 2
    assert len(Simplex(np.zeros((16, 64), np.int64)).pivots) == 1


def test_filter_spares_comparisons_and_keeps_ties():
    vectors = np.array([v for _, v in blobs(3000, 5)])
    whole = np.floor(64 * vectors).astype(np.int64)
    middle = np.concatenate([whole[:12], whole[:4]])  # four centroids twice
    simplex = Simplex(middle)
    near, far, compared = nearest(whole, simplex.apexes(whole)[0], middle, simplex)
    exact = ((whole[:, None] - middle[None]) ** 2).sum(axis=2)
    assert (near == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()
    assert compared < exact.size / 2


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(lake, seed):
    rows = blobs(300, seed)
    assert found(frame(lake, rows).repartition(5)) == brute(rows)


def test_odd_vectors(lake):
    rows = blobs(40, 3)
    nan, inf = float("nan"), float("inf")
    rows += [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [nan] + [1.0] * 63), (105, [1.0] * 63 + [-inf])]
    rows += [(106, [None] + [1.0] * 63), (107, [0.0] * 64), (107, [0.0] * 64), (1, rows[1][1]), (1, rows[2][1]), (None, rows[4][1])]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [(300, [-0.001] * 64), (301, [4000.5] * 64)]
    assert found(frame(lake, rows)) == brute(rows)


def test_few_equal_and_no_vectors(lake):
    assert found(frame(lake, [])) == []
    for rows in ([(1, [0.5] * 64)], [(i, [0.25] * 64) for i in range(30)], [(1, [0.5] * 64), (None, [0.1] * 64)]):
        assert found(frame(lake, rows)) == brute(rows)


def test_other_sizes(lake):
    rows = blobs(120, 4, width=6)
    assert found(frame(lake, rows), count=5, rounds=6, width=6, pivots=3) == brute(rows, 5, 6, 6)


def test_components_beyond_the_bound_are_an_error(lake):
    with pytest.raises(Exception, match="do not fit into 64 bits"):
        cluster(frame(lake, [(1, [1e30] * 64)])).collect()
