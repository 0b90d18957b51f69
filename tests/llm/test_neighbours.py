import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconloom.llm import neighbours
from beaconloom.llm.neighbours import Index, fit_tree, squares


def vectors(lake, rows):
    df = lake.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>")
    return df.selectExpr("*", *[f"'x' AS {c}" for c in "leaf cell query rank score size query_id".split()])


def brute(rows, query, count=10):
    points = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    found = sorted((float(np.sqrt(((points[query] - p) ** 2).sum())), i) for i, p in points.items() if i != query)
    return [(i, s) for s, i in found[:count]]


def clustered(n, seed=0, width=12):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(20, width)) * 3
    return [(i, (centers[rng.integers(20)] + rng.normal(size=width)).tolist()) for i in range(n)]


def results(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_best_bins_give_every_leaf_once_nearest_first():
    points = np.array([v for _, v in clustered(2000)])
    tree = fit_tree(points, 100)
    assert 50 < tree.leaves < 400
    leaves = tree.leaf_of(points)
    for p, leaf in zip(points[:20], leaves[:20], strict=True):
        order = list(tree.best_bins(p))
        assert sorted(order) == list(range(tree.leaves)) and order[0] == leaf
    assert np.allclose(squares(points[:3], points[:4]), ((points[:3, None] - points[None, :4]) ** 2).sum(axis=2))


def test_recall_against_brute_force(lake, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 300)
    rows = clustered(3000)
    df = vectors(lake, rows).repartition(4)
    index = Index(df, leaf_rows=40)
    assert index.measured >= neighbours.RECALL and index.visits < index.tree.leaves
    found = results(index.search(df.where("vec_id % 50 = 0")))
    assert sorted(found) == list(range(0, 3000, 50))
    hits = 0
    for query, listed in found.items():
        assert [r for r, _, _ in listed] == list(range(1, 11))
        hits += len({i for _, i, _ in listed} & {i for i, _ in brute(rows, query)})
        distance = dict(brute(rows, query, 3000))
        assert all(abs(distance[i] - s) < 1e-12 for _, i, s in listed)
        assert [(s, i) for _, i, s in listed] == sorted((s, i) for _, i, s in listed)
    assert hits / (10 * len(found)) >= 0.9


def test_copies_that_fill_a_third_of_the_table(lake, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 100)
    rows = clustered(800)
    rows = [(i, rows[1][1] if i % 3 == 0 else v) for i, v in rows]
    df = vectors(lake, rows).repartition(4)
    found = results(Index(df, leaf_rows=40).search(df.where("vec_id % 100 = 0")))
    for query in (0, 300, 600):  # copies: all ten at distance 0, the smallest ids first
        assert [(i, s) for _, i, s in found[query]] == brute(rows, query)
        assert {s for _, _, s in found[query]} == {0.0}


def test_vectors_that_take_no_part(lake):
    good = clustered(60, width=3)
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (200, [0.0, 0.0, 0.0]), (300, [1.0, None, 2.0]), (400, [nan, 1.0, 1.0]), (500, [inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (600, [1.0, 2.0]), (700, [])]
    df = vectors(lake, good + bad)
    found = results(Index(df).search(df.where("vec_id % 20 = 0")))
    assert sorted(found) == [0, 20, 40]
    assert all([(i, s) for _, i, s in v] == brute(good, q) for q, v in found.items())


@pytest.mark.parametrize("n", [0, 1, 4])
def test_small_tables(lake, n):
    rows = clustered(n, width=2)
    df = vectors(lake, rows)
    found = results(Index(df).search(df))
    assert {q: [(i, s) for _, i, s in v] for q, v in found.items()} == {i: brute(rows, i) for i, _ in rows if n > 1}


def test_queries_need_not_be_in_the_table(lake):
    rows = clustered(100, width=4)
    other = vectors(lake, [(5000, [0.5, 0.5, 0.5, 0.5])])
    found = results(Index(vectors(lake, rows)).search(other))
    assert [(i, s) for _, i, s in found[5000]] == brute([*rows, (5000, [0.5] * 4)], 5000)
    assert other.where(F.col("vec_id") < 0).count() == 0


def test_recall_that_is_aimed_at():
    assert neighbours.RECALL >= 0.97
