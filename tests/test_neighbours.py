"""Neighbours of all vectors above a threshold against every pair."""

import numpy as np
import pytest
from provena.operators import neighbours


def brute(rows, threshold):
    good = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    unit = [np.array(v) / np.linalg.norm(v) if g else None for (_, v), g in zip(rows, good, strict=True)]
    out = {}
    for k, (i, v) in enumerate(rows):
        others = [m for m, g in enumerate(good) if g and good[k] and len(rows[m][1]) == len(v)]
        near = [m for m in others if m != k and unit[m] @ unit[k] >= threshold]
        out.setdefault(i, []).append((min((rows[m][0] for m in others if rows[m][1] == v), default=None), len(near)))
    return {i: sorted(x, key=str) for i, x in out.items()}


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], []).append((r["class_id"], r["n_links"]))
    return {i: sorted(x, key=str) for i, x in out.items()}


@pytest.mark.parametrize("dim,threshold", [(3, 0.95), (32, 0.85), (200, 0.7)])
def test_against_every_pair(spark, dim, threshold):
    rng = np.random.default_rng(dim)
    base = rng.standard_normal((150, dim))
    noise = np.sqrt(1 / threshold**2 - 1) * np.linalg.norm(base, axis=1, keepdims=True) / np.sqrt(dim) * rng.uniform(0.5, 1.2, (150, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base + noise * rng.standard_normal((150, dim))]))]
    work = {}
    found, pairs = neighbours.similar_rows(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", threshold, work=work)
    want = brute(rows, threshold)
    assert got(found) == want
    assert pairs.count() == sum(n for x in want.values() for _, n in x) // 2
    assert work["verified"] >= pairs.count() and work["verified"] < work["compared"]


def test_odd_vectors_copies_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.1]), (5, [-1.0, 0.0]), (6, [1.0]), (7, [1.0, 0.0, 0.0]), (8, None), (9, []), (10, [0.0, 0.0]), (11, [1.0, None]), (12, [nan, 1.0]), (13, [inf, 1.0]), (14, [0.0, 1.0])]
    df = spark.createDataFrame([*rows, (None, [1.0, 0.0])], "id long, v array<double>")
    found, pairs = neighbours.similar_rows(df, "id", "v")
    assert got(found) == brute(rows, 0.85)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(1, 2), (1, 4), (2, 4)]
    empty = neighbours.similar_rows(df.limit(0), "id", "v")
    assert [x.count() for x in empty] == [0, 0]


def test_group_of_copies_is_one_vector(spark):
    df = spark.sql("SELECT id, array(double(if(id < 3000, 1, id)), 1D, 1D) AS v FROM range(3010)")
    work = {}
    found, pairs = neighbours.similar_rows(df, "id", "v", 0.99, work=work)
    assert found.where("id < 3000 AND n_links = 2999 AND class_id = 0").count() == 3000
    assert pairs.count() == 45 and work["compared"] <= 55 * work["tables"]


def test_plan_grows_slower_than_the_vectors():
    small, large = neighbours.plan(10**5, 0.85, 1e-3), neighbours.plan(10**7, 0.85, 1e-3)
    per = lambda n, p: p[1] * n / 2 ** p[0]  # noqa: E731  compared pairs of a vector
    assert per(10**7, large) < 30 * per(10**5, small) and large[1] < 10 * small[1]
    with pytest.raises(ValueError):
        neighbours.plan(10, 1.0, 1e-3)


def test_signatures_against_every_pair(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base + rng.uniform(0.3, 0.8, (150, 1)) * rng.standard_normal((150, 32))]))]
    found, _ = neighbours.similar_rows(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", miss=1e-5)
    assert got(found) == brute(rows, 0.85)


def test_every_pair_in_many_cells_and_passes(spark, monkeypatch):
    for name, value in (("GROUP", 64 * 16 * 8), ("MOVED", 1), ("TALL", 32), ("WIDE", 16)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((200, 16)) * np.geomspace(1, 0.05, 16)  # a few main axes
    rows = [(f"n{i}", v.tolist()) for i, v in enumerate([*base, *(1e130 * base[:50] + 1e129 * rng.standard_normal((50, 16))), *base[:20, :9]])]
    work = {}
    found, pairs = neighbours.similar_rows(spark.createDataFrame(rows, "id string, v array<double>"), "id", "v", 0.9, work=work)
    want = brute(rows, 0.9)
    assert got(found) == want and work["tables"] > 10
    assert pairs.count() == pairs.select("a", "b").distinct().count() == sum(n for x in want.values() for _, n in x) // 2


def test_no_pair_at_the_threshold_is_missed():
    """Products that are just the threshold: whatever the number of columns, the bound keeps them."""
    rng = np.random.default_rng(1)
    u = rng.standard_normal((3000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.standard_normal((3000, 64))
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    at = 0.85 * u + np.sqrt(1 - 0.85**2) * w
    got = {(int(a), int(b)) for x, y, _ in neighbours._meet(u, at, 0.85 - 1e-12) for a, b in zip(x, y, strict=True)}
    assert {(i, i) for i in range(3000)} <= got and len(got) < 3100


def test_vectors_whose_squares_leave_the_numbers(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 2e200]), (3, [1.0, 1.0]), (4, [1e-200, 1e-200]), (5, [1e200, -1e200])]
    found, pairs = neighbours.similar_rows(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.9)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
