"""Stored discovery against a breadth-first search in plain Python."""

import random

import pytest
from provena.operators import discovery
from provena.operators.store import Conflict, Store


def plain(links, seeds):
    seen, front, k = {s: (None, 0) for s in seeds}, set(seeds), 0
    while front:
        k += 1
        new = {}
        for a, b in sorted(x for x in links if None not in x):
            if a in front and b not in seen:
                new.setdefault(b, (a, k))
        seen |= new
        front = set(new)
    return seen


def rows(df):
    got = [(r["id"], (r["discovered_from"], r["round"])) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def tables(spark, links, seeds):
    return spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame([(s,) for s in seeds], "id long")


def test_random_graph_with_nulls_repeats_and_a_hub(spark, tmp_path):
    rng = random.Random(4)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(150)] + [(7, n) for n in range(200, 260)] + [(None, 1), (3, None), (5, 5)]
    store = Store(spark, f"file://{tmp_path}/s")
    discovery.start(store, *tables(spark, links * 2, [1, 7, 7, None]), buckets=4)
    assert rows(discovery.discover(store)) == plain(links, [1, 7])


def test_goes_on_after_a_loss_and_keeps_its_plan(spark, tmp_path, monkeypatch):
    links = [(k, k + 1) for k in range(22)]
    store = Store(spark, f"file://{tmp_path}/s")
    discovery.start(store, *tables(spark, links, [0]), buckets=2)
    assert set(rows(discovery.discover(store, rounds=3))) == {0, 1, 2, 3}
    before = store.manifest()["version"]
    with monkeypatch.context() as m:  # the writer is lost before it publishes
        m.setattr(Store, "_publish", lambda self, new: (_ for _ in ()).throw(Conflict("lost")))
        with pytest.raises(Conflict):
            discovery.advance(store)
    assert store.manifest()["version"] == before
    size = len(store.read("seen")._jdf.queryExecution().optimizedPlan().toString())
    again = Store(spark, f"file://{tmp_path}/s")  # another driver
    discovery.start(again, *tables(spark, [(0, 99)], [50]), buckets=2)  # has begun: changes nothing
    assert rows(discovery.discover(again)) == plain(links, [0])
    assert len(again.read("seen")._jdf.queryExecution().optimizedPlan().toString()) <= size + 8
    assert max(len(p) for p in again.manifest()["tables"]["seen"]["at"].values()) <= discovery.MERGED
    assert rows(discovery.discover(again)) == plain(links, [0])


def test_limits_and_empty_tables(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/a")
    discovery.start(store, *tables(spark, [(1, 2), (2, 3), (3, 4)], [1]), buckets=2)
    assert discovery.discover(store, max_ids=3).count() == 3
    for name, links, seeds in (("b", [], [1]), ("c", [(1, 2)], [])):
        store = Store(spark, f"file://{tmp_path}/{name}")
        discovery.start(store, *tables(spark, links, seeds), buckets=2)
        assert discovery.discover(store).count() == len(seeds)
