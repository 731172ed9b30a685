"""Breadth-first discovery over stored links that goes on where it stopped.

Links lie in buckets of their source, visited ids in buckets of the id, the front in a table of its own. A round reads the links of
the buckets that its front falls into and the visited ids of the buckets that it may reach, and adds what is new, all in one
version of the store: a driver or executor that is lost costs the round, and the next call goes on from the last version. The plan
of a round has the same size whatever its number: it starts from files, and a bucket of more than MERGED pieces is put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .state import materialize, remove, scratch
from .store import Store

MERGED = 8


def start(store: Store, links: DataFrame, seeds: DataFrame, buckets: int = 64) -> None:
    """Keep links (src, dst; any more columns are left out) and the seeds (id) as round 0. Nulls and repeats are left out; a store that has begun is left alone."""
    base = store.manifest()
    if store.has("links", base):
        return
    kept = links.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    first = seeds.select("id").where("id IS NOT NULL").distinct().select("id", F.lit(None).cast(links.schema["src"].dataType).alias("discovered_from"), F.lit(0).alias("round"))
    first = materialize(first, "seeds")
    store.commit("start", base, append={"links": (kept, ["src"], buckets), "seen": (first, ["id"], buckets), "front": (first.select("id"), ["id"], buckets)}, notes={"round": 0, "found": first.count()})


def advance(store: Store) -> int:
    """One round: how many ids it found, each kept with the smallest source in the front. What it wrote for itself goes at its end."""
    work = scratch(store.spark, "round")
    try:
        return _round(store, work)
    finally:
        remove(store.spark, work)


def _round(store: Store, work: str) -> int:
    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return store.spark.read.schema(df.schema).parquet(f"{work}/{name}")

    base = store.manifest()
    k, buckets = base["notes"]["round"] + 1, base["tables"]["front"]["buckets"]
    front = store.read("front", manifest=base)
    links = store.read("links", [int(b) for b in base["tables"]["front"]["at"]], base)  # both are bucketed alike
    near = front.join(links, front["id"] == links["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("discovered_from"))
    near = kept(near, "reached")
    seen = store.read("seen", store.touched(near, ["id"], buckets), base).select("id")
    new = kept(near.join(seen, "id", "left_anti").select("id", "discovered_from", F.lit(k).alias("round")), "found")
    n = new.count()
    if not n:
        return 0
    many = [int(b) for b, pieces in base["tables"]["seen"]["at"].items() if len(pieces) >= MERGED]
    replace = {"front": (new.select("id"), ["id"], buckets, list(range(buckets)))}
    if many:
        replace["seen"] = (store.read("seen", many, base), ["id"], buckets, many)
    store.commit(f"round-{k}", base, replace=replace, append={"seen": (new, ["id"], buckets)}, notes={"round": k, "found": base["notes"]["found"] + n})
    if k % MERGED == 0:
        store.vacuum()
    return n


def discover(store: Store, rounds: int | None = None, max_ids: int | None = None) -> DataFrame:
    """Rounds until nothing is new, or until so many rounds or ids are in the store, earlier calls counted: id, discovered_from, round.

    Later rounds may remove the files that an earlier result reads.
    """
    while True:
        notes = store.manifest()["notes"]
        if (rounds is not None and notes["round"] >= rounds) or (max_ids is not None and notes["found"] >= max_ids) or not advance(store):
            return store.read("seen")
