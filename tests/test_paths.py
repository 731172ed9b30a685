"""Paths between two sets of nodes, from both ends, against depth-first enumeration."""

import random

import pytest
from provena.operators import graph


def trails(edges, starts, ends, depth):
    out, stack = [], [((s,), ()) for s in starts]
    while stack:
        nodes, used = stack.pop()
        for i, a, b in edges:
            if a == nodes[-1] and i not in used and len(used) < depth:
                stack.append(((*nodes, b), (*used, i)))
                if b in ends:
                    out.append(stack[-1])
    return sorted(out)


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8])
def test_paths_between(spark, depth):
    rng = random.Random(depth)
    edges = [(i, rng.randrange(9), rng.randrange(9)) for i in range(13)] + [(100, None, 3), (101, 3, None)]
    df = spark.createDataFrame(edges, "eid int, src int, dst int")
    starts, ends = {0, 1, 77}, {1, 4, 5}
    node = lambda x: spark.createDataFrame([(n,) for n in [*x, None, min(x)]], "node int")
    got = graph.paths_between(df, node(starts), node(ends), depth).collect()
    assert sorted((tuple(r["nodes"]), tuple(r["eids"])) for r in got) == trails(edges[:-2], starts, ends, depth)
    assert all(r["start"] == r["nodes"][0] and r["end"] == r["nodes"][-1] and r["length"] == len(r["eids"]) for r in got)


def test_no_way_and_bad_depth(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "eid string, src int, dst int")
    one, four = (spark.createDataFrame([(x,)], "node int") for x in (1, 4))
    assert graph.paths_between(df, one, four, 10).count() == 0
    assert graph.paths_between(df.limit(0), one, four, 4).count() == 0
    assert graph.paths_between(df, one, one, 4).count() == 0
    with pytest.raises(ValueError):
        graph.paths_between(df, one, four, 0)


def test_partial_trails_stay_few(spark):
    """A tree of degree 4 and six levels with one way to the end: forward search would write 4 + 16 + ... + 4,096 partial trails."""
    edges, level, eid = [], [0], 0
    for depth in range(6):
        nxt = []
        for n in level:
            for _ in range(4):
                eid += 1
                edges.append((eid, n, eid))
                nxt.append(eid)
        level = nxt
    df = spark.createDataFrame(edges, "eid int, src int, dst int")
    work: list = []
    got = graph.paths_between(df, spark.createDataFrame([(0,)], "node int"), spark.createDataFrame([(level[-1],)], "node int"), 8, work).collect()
    assert len(got) == 1 and got[0]["length"] == 6
    assert dict(work)["edges"] == 6 and sum(n for _, n in work) <= 20
