"""Sizes of the neighbourhoods of all nodes, counted exactly: lists of reached nodes go along the edges, in passes of bounded size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import undirected
from .state import Steps

#: Members that a list holds at most.
PIECE = 4096
#: Members, repeats included, up to which a node's are gathered in one row; of other nodes each pair of node and member is a row.
GATHERED = 1 << 17
#: Members that a pass moves at most, so many times those of the lists that every pass reads, or FLOOR.
TIMES, FLOOR = 4, 1 << 26


def _lists(pairs: DataFrame) -> DataFrame:
    """node, members of distinct pairs (node, member) that lie together by node."""
    pieces = F.ceil(F.count("*").over(Window.partitionBy("node")) / PIECE)
    return pairs.select("node", "member", F.pmod(F.xxhash64("member"), pieces).alias("piece")).groupBy("node", "piece").agg(F.collect_list("member").alias("members")).drop("piece")


def _share(what: str, k: int, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(n), what), F.lit(n)) == k if n > 1 else F.lit(True)


def _step(steps: Steps, near: DataFrame, state: DataFrame, hop: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """(node, n: how many nodes one step more reaches; node, members: which, unless this is the last hop)."""
    moves = near.select("node", F.explode("members").alias("other"))
    held = state.groupBy(F.col("node").alias("other")).agg(F.sum(F.size("members")).alias("n"))
    weights = steps.write(moves.join(held, "other").groupBy("node").agg(F.sum("n").alias("weight")), f"weights-{hop}")
    few = F.col("weight") <= GATHERED
    entries = near.agg(F.sum(F.size("members"))).first()[0] or 0
    one = max(FLOOR, TIMES * entries)
    few_sum, many_sum = (int(x or 0) for x in weights.agg(F.sum(F.when(few, F.col("weight"))), F.sum(F.when(~few, F.col("weight")))).first())
    counts = reached = None
    reach = lambda rows, sets: rows.join(sets.select(F.col("node").alias("other"), F.col("members").alias("reached")), "other")

    n = max(1, -(-few_sum // one))
    for k in range(n):  # nodes are dealt to passes; the lists that meet at a node are one row there
        mine = near.where(_share("node", k, n)).join(weights.where(few).select("node"), "node", "left_semi").select("node", F.explode("members").alias("other"))
        found = reach(mine, state).select("node", "reached").repartition("node").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("reached"))).alias("members"))
        if last:
            counts = steps.write(found.select("node", F.size("members").cast("long").alias("n")), f"counts-{hop}")
        else:
            cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("members") - 1) / PIECE).cast("int")), lambda i: F.slice("members", i * PIECE + 1, PIECE))
            reached = steps.write(found.select("node", F.explode(cut).alias("members")), f"reached-{hop}")

    n = -(-many_sum // one)
    for k in range(n):  # members are dealt to passes, so that one node's are not all in one; pairs are made distinct before they move
        mine = near.join(weights.where(~few).select("node"), "node", "left_semi").select("node", F.explode("members").alias("other"))
        part = state.select("node", F.explode("members").alias("member")).where(_share("member", k, n)).groupBy("node", F.pmod(F.xxhash64("member"), F.lit(64)).alias("p")).agg(F.collect_list("member").alias("members")) if n > 1 else state
        found = reach(mine, part).select("node", F.explode("reached").alias("member")).distinct()
        if last:
            counts = steps.write(found.groupBy("node").agg(F.count("*").alias("n")), f"counts-{hop}")
        else:
            reached = steps.write(_lists(found.repartition("node")), f"reached-{hop}")
    steps.drop(f"weights-{hop}")
    if not last:
        counts = reached.select("node", F.size("members").cast("long").alias("n"))
    return counts, reached


def sizes(edges: DataFrame, hops: int, whole: int = 256) -> DataFrame:
    """node, hop (1 to hops), size, exact: how many other nodes lie within so many undirected steps.

    Every size is counted, none is estimated; `exact` only says whether a neighbourhood has fewer than `whole` nodes. edges: src,
    dst of one type; repeated edges count once, loops add nothing, rows with a null end are left out.

    A node's set is the union of the sets of its neighbours, one hop shorter. Those are moved as lists of at most PIECE members, in
    passes that take as many nodes as move TIMES the members of the graph, so that disk grows with edges and not with pairs. Nodes
    of more than GATHERED members, repeats included, go by distinct pairs of node and member, so that no group is held in memory
    whole. The sets of all hops but the last are written: they are the size of the answer's sums.
    """
    if hops < 1 or whole < 1:
        raise ValueError("hops and whole are at least 1")
    steps = Steps(edges.sparkSession)
    ends = steps.write(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    both = undirected(ends).select("node", F.col("other").alias("member"))
    both = both.union(both.select("node", "node"))  # a step may stay
    near = steps.write(_lists(both.repartition("node").distinct()), "reached-1")
    steps.drop("edges")
    state, found = near, []
    for hop in range(1, hops + 1):
        if hop == 1:
            counts = near.select("node", F.size("members").cast("long").alias("n"))
        else:
            counts, state = _step(steps, near, state, hop, hop == hops)
        n = F.sum("n")
        found.append(counts.groupBy("node").agg(F.lit(hop).alias("hop"), (n - 1).alias("size"), (n <= whole).alias("exact")).select("node", "hop", "size", "exact"))
    return reduce(DataFrame.union, found)
