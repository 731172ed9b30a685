"""Graph queries over node and edge tables: edges have eid, src, dst; a document column where paths belong to one document."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Both directions of every edge, with direction out or in."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    out = edges.select(*rest, F.col(src).alias("node"), F.col(dst).alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(edges.select(*rest, F.col(dst).alias("node"), F.col(src).alias("other"), F.lit("in").alias("direction")))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, in_degree, out_degree, degree; nodes (node) without edges keep zeros."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    if nodes is not None:
        ends = ends.union(nodes.select("node", F.lit(0), F.lit(0)))
    d = ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return d.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def weighted_degree(edges: DataFrame, weight: str) -> DataFrame:
    """node, weight over its edges in both directions; a self-loop counts once."""
    back = edges.where("src <> dst").select(F.col("dst").alias("node"), weight)
    return edges.select(F.col("src").alias("node"), weight).union(back).groupBy("node").agg(F.sum(weight).alias("weight"))


def bounded_paths(edges: DataFrame, start: DataFrame, depth: int, end: Column | None = None) -> DataFrame:
    """All trails of 1 to depth edges from start (node): start, end, length, nodes, eids; no edge is used twice, nodes may be.

    Depth is a number, so that the plan is a fixed chain of joins. Filter edges before: predicates on all edges of a path
    belong there.
    """
    if depth < 1:
        raise ValueError("depth is at least 1")
    e = edges.select(F.col("eid").alias("e_id"), F.col("src").alias("e_src"), F.col("dst").alias("e_dst"))
    now = start.select(F.col("node").alias("start"), F.col("node").alias("end"), F.lit(0).alias("length"), F.array("node").alias("nodes"), F.array().cast(f"array<{edges.schema['eid'].dataType.simpleString()}>").alias("eids"))
    found = None
    for k in range(1, depth + 1):
        step = now.join(e, (F.col("end") == F.col("e_src")) & ~F.array_contains("eids", F.col("e_id")))
        now = step.select("start", F.col("e_dst").alias("end"), F.lit(k).alias("length"), F.concat("nodes", F.array("e_dst")).alias("nodes"), F.concat("eids", F.array("e_id")).alias("eids"))
        found = now if found is None else found.union(now)
    return found if end is None else found.where(end)


def reach(edges: DataFrame, start: DataFrame, end: DataFrame, hops: int) -> DataFrame:
    """node, after (fewest edges from any start) and before (fewest to any end) of the nodes that either side reaches within `hops`; null: not reached.

    Both searches share their rounds; a round moves the nodes that the one before found, never trails, and is written.
    """
    from .state import materialize

    out = edges.select(F.lit(True).alias("onward"), F.col("src").alias("node"), F.col("dst").alias("other"))
    steps = materialize(out.union(edges.select(F.lit(False), "dst", "src")).distinct(), "steps")
    front = start.select(F.lit(True).alias("onward"), "node").union(end.select(F.lit(False), "node")).distinct()
    front = seen = materialize(front.withColumn("d", F.lit(0)), "reached")
    for k in range(1, hops + 1):
        new = front.join(steps, ["onward", "node"]).select("onward", F.col("other").alias("node")).distinct()
        front = materialize(new.join(seen.select("onward", "node"), ["onward", "node"], "left_anti").withColumn("d", F.lit(k)), "reached")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.groupBy("node").agg(F.min(F.when(F.col("onward"), F.col("d"))).alias("after"), F.min(F.when(~F.col("onward"), F.col("d"))).alias("before"))


def paths_between(edges: DataFrame, start: DataFrame, end: DataFrame, depth: int, work: list | None = None) -> DataFrame:
    """All trails of 1 to depth edges from a start node to an end node: start, end, length, nodes, eids; no edge is used twice, nodes may be.

    The search goes from both ends. Distances of nodes come first (reach), and only edges on some walk from a start to an end
    of at most depth edges stay. Over these, trails grow from the starts up to half the depth, and from the ends backwards up to
    the other half; either drops a trail as soon as the other end is farther than the edges that are left. A trail of up to half
    the depth is a forward one that stands on an end; each longer one is a forward half of full length and a backward rest that
    meet in one node and share no edge. Partial trails thus grow as degree^(depth/2), whole ones are only those asked for.

    start, end: node. Edges with a null end are on no trail; repeated start or end nodes count once. work, a list, gets a
    (step, rows) for each table that the search wrote.
    """
    from .state import materialize

    if depth < 1:
        raise ValueError("depth is at least 1")

    def kept(df: DataFrame, what: str) -> DataFrame:
        df = materialize(df, "trails")
        if work is not None:
            work.append((what, df.count()))
        return df

    kind = edges.schema["eid"].dataType.simpleString()
    e = materialize(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("eid", "src", "dst"), "edges")
    start, end = (x.where("node IS NOT NULL").select("node").distinct() for x in (start, end))
    near = materialize(reach(e, start, end, depth - 1), "near")
    live = e.join(near.select(F.col("node").alias("src"), "after"), "src").join(near.select(F.col("node").alias("dst"), "before"), "dst")
    live = kept(live.where(F.col("after") + 1 + F.col("before") <= depth).select("eid", "src", "dst", "after", "before"), "edges")
    half = (depth + 1) // 2
    none = F.array().cast(f"array<{kind}>")

    now, found = start.select(F.col("node").alias("start"), F.col("node").alias("end"), F.array("node").alias("nodes"), none.alias("eids")), []
    for k in range(1, half + 1):
        step = now.join(live, (F.col("end") == F.col("src")) & (F.col("before") + k <= depth) & ~F.array_contains("eids", F.col("eid")))
        step = step.select("start", F.col("dst").alias("end"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("eids", F.array("eid")).alias("eids"), F.col("before").alias("left"))
        now = kept(step, f"forward {k}")
        found.append(now.where("left = 0").select("start", "end", F.lit(k).alias("length"), "nodes", "eids"))
    back = end.select(F.col("node").alias("begin"), F.col("node").alias("last"), F.array("node").alias("then"), none.alias("used"))
    for k in range(1, depth - half + 1):
        step = back.join(live, (F.col("begin") == F.col("dst")) & (F.col("after") + k <= depth) & ~F.array_contains("used", F.col("eid")))
        back = kept(step.select(F.col("src").alias("begin"), "last", F.concat(F.array("src"), "then").alias("then"), F.concat(F.array("eid"), "used").alias("used")), f"backward {k}")
        whole = now.join(back, (F.col("end") == F.col("begin")) & ~F.arrays_overlap("eids", "used"))
        found.append(whole.select("start", F.col("last").alias("end"), F.lit(half + k).alias("length"), F.concat("nodes", F.slice("then", 2, k)).alias("nodes"), F.concat("eids", "used").alias("eids")))
    return reduce(DataFrame.union, found)


def hop_distances(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """start, node, distance of the nodes within `hops` undirected steps; each (start, node) once, by its shortest distance."""
    both = undirected(edges).select("node", "other").distinct()
    seen = start.select(F.col("node").alias("start"), "node", F.lit(0).alias("distance")).distinct()
    front = seen
    for k in range(1, hops + 1):
        near = front.join(both, "node").select("start", F.col("other").alias("node")).distinct()
        front = near.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(k))
        seen = seen.union(front)
    return seen


def hop_edges(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """start and the distinct edges with an end within hops - 1 steps: all that a trail of `hops` edges can use."""
    near = hop_distances(edges, start, hops - 1).select("start", "node")
    by_src = edges.join(near, edges["src"] == near["node"]).select("start", *edges.columns)
    by_dst = edges.join(near, edges["dst"] == near["node"]).select("start", *edges.columns)
    return by_src.union(by_dst).distinct()


def document_path(edges: DataFrame, doc: str, pos: str = "pos") -> DataFrame:
    """Per document the nodes in order (last one too) and the number of edges."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("src").alias("s"), F.col("dst").alias("d"))))
    g = edges.groupBy(doc).agg(ordered.alias("x"))
    return g.select(doc, F.concat(F.transform("x", lambda e: e["s"]), F.array(F.element_at("x", -1)["d"])).alias("nodes"), F.size("x").cast("long").alias("n_edges"))


def shared_by_all(members: DataFrame, group: str, chain: str, member: str) -> DataFrame:
    """group, member of the members that all chains of their group have."""
    n = members.groupBy(group).agg(F.count_distinct(chain).alias("n_chains"))
    own = members.where(F.col(member).isNotNull()).groupBy(group, member).agg(F.count_distinct(chain).alias("n"))
    return own.join(n, group).where("n = n_chains").select(group, member, "n_chains")


def side_by_side(members: DataFrame, group: str, chain: str, pos: str, member: str) -> DataFrame:
    """Places as rows, all chains of the group beside each other: a map from chain to the member there."""
    one = members.groupBy(group, pos, chain).agg(F.min(member).alias("m"))
    return one.groupBy(group, pos).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(chain).alias("chain"), "m")))).alias("chains"))


def frequent(rows: DataFrame, name: str, doc: str, k: int) -> DataFrame:
    """The k most frequent names with links and distinct docs, ties by name."""
    g = rows.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("links"), F.count_distinct(doc).alias("docs"))
    return g.orderBy(F.col("links").desc(), "name").limit(k)


def visual_edges(edges: DataFrame, doc: str, chain: str, pos: str, colours: list[str]) -> DataFrame:
    """Edges of a drawn chain between the node ids of visual_nodes, in the chain's colour."""
    node = lambda p: F.concat_ws("_", F.lit("n"), F.col(doc).cast("string"), F.col(chain).cast("string"), p.cast("string"))
    c = F.array(*[F.lit(x) for x in colours])
    return edges.select(node(F.col(pos)).alias("from_id"), node(F.col(pos) + 1).alias("to_id"), F.element_at(c, (F.col(chain) % len(colours) + 1).cast("int")).alias("colour"))


def visual_nodes(members: DataFrame, doc: str, chain: str, pos: str, name: str, colours: list[str]) -> DataFrame:
    """Nodes of a drawn chain: an id that repeats members per chain, role by place, colour by chain number."""
    c = F.array(*[F.lit(x) for x in colours])
    return members.select(
        F.concat_ws("_", F.lit("n"), F.col(doc).cast("string"), F.col(chain).cast("string"), F.col(pos).cast("string")).alias("node_id"), F.col(name).alias("label"),
        F.when(F.col(pos) == 0, F.lit("lead")).otherwise(F.lit("narrator")).alias("role"), F.col(pos).cast("long").alias("level"), F.element_at(c, (F.col(chain) % len(colours) + 1).cast("int")).alias("colour"),
    )


def crawl(links: DataFrame, seeds: DataFrame, max_ids: int | None = None, rounds: int | None = None) -> DataFrame:
    """Breadth-first discovery over links (src, dst): id, discovered_from, round, until a round finds nothing new.

    max_ids ends it after the round that reaches it, rounds after so many; neither is set by default.

    Each round is written to the shared checkpoint folder, so that lineage stays short and lost executors cost one round.
    """
    from .state import materialize

    links = materialize(links.select("src", "dst"), "links")  # every round reads them
    seen = materialize(seeds.select(F.col("id"), F.lit(None).cast(seeds.schema["id"].dataType).alias("discovered_from"), F.lit(0).alias("round")).distinct(), "crawl")
    front = seen
    for k in itertools.count(1):
        if rounds is not None and k > rounds:
            break
        new = front.join(links, front["id"] == links["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("discovered_from"))
        new = materialize(new.join(seen.select("id"), "id", "left_anti").select("id", "discovered_from", F.lit(k).alias("round")), "crawl")
        if new.isEmpty():
            break
        seen, front = seen.union(new), new
        if max_ids and seen.count() >= max_ids:
            break
    return seen
