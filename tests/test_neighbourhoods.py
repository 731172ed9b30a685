"""Neighbourhood sizes against sets in plain Python."""

import glob
import os
import random

import pytest
from provena.operators import neighbourhoods
from provena.operators.state import shared_folder


def plain(edges, hops):
    near = {}
    for a, b in edges:
        if a is not None and b is not None:
            near.setdefault(a, {a}).add(b)
            near.setdefault(b, {b}).add(a)
    out, now = {}, {n: {n} for n in near}
    for hop in range(1, hops + 1):
        now = {n: set().union(*(now[m] for m in near[n])) for n in near}
        out |= {(n, hop): len(s) - 1 for n, s in now.items()}
    return out


def test_exact_and_sketched(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(1500), rng.randrange(1500)) for _ in range(1800)] + [(0, k) for k in range(700)] + [(5000, 5000), (5001, 5002), (5002, 5001), (None, 1), (2, None)]
    df = spark.createDataFrame(edges + edges[:50], "src long, dst long")
    want, whole = plain(edges, 3), 60
    got = neighbourhoods.sizes(df, 3, whole).collect()
    assert {(r["node"], r["hop"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n = want[r["node"], r["hop"]]
        assert r["exact"] == (n < whole)
        assert r["size"] == n if r["exact"] else abs(r["size"] - n) <= 0.08 * n
    assert {(r["node"], r["hop"]): r["size"] for r in neighbourhoods.sizes(df, 2, 2000).collect()} == plain(edges, 2)


def test_empty_and_names(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert {tuple(r) for r in neighbourhoods.sizes(df, 2).collect()} == {("a", 1, 1, True), ("b", 1, 2, True), ("c", 1, 1, True), ("a", 2, 2, True), ("b", 2, 2, True), ("c", 2, 2, True)}
    assert neighbourhoods.sizes(df.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        neighbourhoods.sizes(df, 0)


def test_every_size_is_counted(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(1500)] + [(0, k) for k in range(400)] + [(901, 901)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = {(n, hop): (size, size < 60) for (n, hop), size in plain(edges, 3).items()}
    assert max(size for size, _ in want.values()) > 600
    got = lambda: {(r["node"], r["hop"]): (r["size"], r["exact"]) for r in neighbourhoods.sizes(df, 3, 60).collect()}
    assert got() == want
    for name, value in (("PIECE", 50), ("GATHERED", 2000), ("TIMES", 0), ("FLOOR", 150_000)):  # lists in pieces, wide nodes by pairs, several passes of both
        monkeypatch.setattr(neighbourhoods, name, value)
    assert got() == want


def test_last_sets_are_counted_and_not_kept(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(600), rng.randrange(600)) for _ in range(6000)]
    df = spark.createDataFrame(edges, "src long, dst long")
    files = lambda: {f for f in glob.glob(f"{shared_folder(spark).removeprefix('file://')}/*/*.parquet")}
    before = files()
    got = {(r["node"], r["hop"]): r["size"] for r in neighbourhoods.sizes(df, 2, 4096).collect()}
    assert got == plain(edges, 2)
    members = sum(n for (_, hop), n in got.items() if hop == 2)
    assert sum(os.path.getsize(f) for f in files() - before) < members  # a byte for each member would be more
