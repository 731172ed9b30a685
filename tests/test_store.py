"""Bucketed versioned tables and what is kept up in them, against plain dictionaries."""

import random
from collections import Counter

import pytest
from provena.operators import counts
from provena.operators.store import Conflict, Store


def test_upserts_against_a_dictionary(spark, tmp_path):
    rng, store, want = random.Random(1), Store(spark, f"file://{tmp_path}/s"), {}
    for n, how in enumerate(["keep", "keep", "replace", "fields", "delete", "fields", "keep", "replace"]):
        rows = [(rng.choice([None, "a", "b"]), rng.randrange(40), rng.choice([None, "x", "y", "z"]), rng.choice([None, 1, 2])) for _ in range(25)]
        inserted = {r[:2] for r in rows} - set(want)
        for key in {r[:2] for r in rows}:
            same = sorted((r[2:] for r in rows if r[:2] == key), key=lambda v: [(x is not None, x or 0 if i else x or "") for i, x in enumerate(v)])
            if how == "delete":
                want.pop(key, None)
            elif how == "keep":
                want.setdefault(key, same[-1])
            elif how == "replace":
                want[key] = same[-1]
            else:
                old = want.get(key, (None, None))
                want[key] = tuple(max((v[i] for v in same if v[i] is not None), default=old[i]) for i in (0, 1))
        df = spark.createDataFrame(rows, "source string, id int, name string, rank int")
        done = store.upsert("nodes", f"batch-{n}", df, ["source", "id"], how, buckets=8)
        assert {(r["source"], r["id"]): (r["name"], r["rank"]) for r in store.read("nodes").collect()} == want, how
        assert store.read("nodes").count() == len(want)
        if how != "delete":
            assert done["inserted"] == len(inserted) and done["matched"] == len({r[:2] for r in rows} - inserted)
        again = store.upsert("nodes", f"batch-{n}", df, ["source", "id"], how, buckets=8)
        assert again["rewritten"] == 0 and store.manifest()["version"] == n + 1


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.upsert("t", "base", spark.range(5000).selectExpr("id", "id AS v"), ["id"], "replace", buckets=50)
    before = store.manifest()["tables"]["t"]["at"]
    done = store.upsert("t", "one", spark.createDataFrame([(7, -1), (8, -1)], "id long, v long"), ["id"], "replace", buckets=50)
    after = store.manifest()["tables"]["t"]["at"]
    assert done["touched"] <= 2 and done["rewritten"] < 400 and done["matched"] == 2
    assert sum(before[b] != after[b] for b in after) == done["touched"]
    assert store.read("t").where("v = -1").count() == 2 and store.read("t").count() == 5000
    assert store.read("t", store.touched(spark.createDataFrame([(7,)], "id long"), ["id"], 50)).count() < 400


def test_lost_and_rival_writers(spark, tmp_path, monkeypatch):
    store, rows = Store(spark, f"file://{tmp_path}/s"), spark.createDataFrame([(1, "a")], "id int, v string")
    store.upsert("t", "0", rows, ["id"], "replace", 4)
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.upsert("t", "1", spark.createDataFrame([(1, "lost")], "id int, v string"), ["id"], "replace", 4)
    assert [tuple(r) for r in store.read("t").collect()] == [(1, "a")]
    base = store.manifest()
    rival = spark.createDataFrame([(2, "b")], "id int, v string")
    store.commit("first", base, append={"t": (rival, ["id"], 4)})
    with pytest.raises(Conflict):
        store.commit("second", base, append={"t": (rival, ["id"], 4)})
    assert sorted(r["id"] for r in store.read("t").collect()) == [1, 2]
    assert store.vacuum() == 2 and len(store.versions()) == 1  # the lost writer's data and the refused one's
    assert sorted(r["id"] for r in store.read("t").collect()) == [1, 2]
    with pytest.raises(ValueError):
        store.upsert("t", "2", rows, ["id"], "replace", 5)


def test_pair_counts_move_by_differences(spark, tmp_path):
    rng, store, links = random.Random(2), Store(spark, f"file://{tmp_path}/s"), Counter()
    for n in range(6):
        rows = [(rng.choice(["s", "t"]), rng.randrange(5), rng.randrange(5), rng.choice([None, 1, 2, 3]), rng.choice([1, 1, 1, -1, -2])) for _ in range(40)]
        net = Counter()
        for *k, change in rows:
            net[tuple(k)] += change
        for k, change in net.items():
            links[k] = max(0, links[k] + change)
        df = spark.createDataFrame(rows, "source string, src int, dst int, doc int, change int")
        for _ in range(2):  # a repeat changes nothing
            counts.apply(store, f"b{n}", df, buckets=8)
        want: dict = {}
        for (s, a, b, _), times in links.items():
            if times:
                d, m = want.get((s, a, b), (0, 0))
                want[s, a, b] = (d + 1, m + times)
        assert {(r["source"], r["src"], r["dst"]): (r["n_docs"], r["n_links"]) for r in counts.pairs(store).collect()} == want
    assert store.manifest()["version"] == 6
    counts.apply(store, "nothing", df.limit(0), buckets=8)
    assert counts.pairs(store).count() == len(want)
