"""Stored counts of pairs, kept up by differences instead of recounts.

`links` has each (source, src, dst, doc) with the times it occurs, `pairs` each (source, src, dst) with n_docs, its distinct
documents, and n_links. Both are bucketed by the pair, so that a batch reads and writes the same few buckets of both, in one
version of the store. A pair's counts move by what the batch changes in its documents: no document is counted again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .state import materialize
from .store import Store

PAIR = ["source", "src", "dst"]


def apply(store: Store, batch: str, changes: DataFrame, buckets: int = 64) -> dict:
    """changes: source, src, dst, doc, change (links added, or taken away if negative). Rows of the same link add up; more taken than
    there are leaves none. A batch seen before changes nothing. Gives the new manifest.
    """
    base = store.manifest()
    if batch in base["applied"]:
        return base
    net = materialize(changes.groupBy(*PAIR, "doc").agg(F.sum("change").cast("long").alias("change")).where("change <> 0"), "changes")
    touched = store.touched(net, PAIR, buckets)
    old = store.read("links", touched, base) if store.has("links", base) else net.limit(0).select(*PAIR, "doc", F.col("change").alias("times"))
    both = old.select(*PAIR, "doc", "times", F.lit(0).cast("long").alias("change")).unionByName(net.withColumn("times", F.lit(0).cast("long")))
    moved = both.groupBy(*PAIR, "doc").agg(F.sum("times").alias("before"), F.greatest(F.sum("times") + F.sum("change"), F.lit(0)).alias("after"))
    moved = materialize(moved, "moved-links")
    links = moved.where("after > 0").select(*PAIR, "doc", F.col("after").alias("times"))
    diff = moved.where("after <> before").groupBy(*PAIR).agg(
        F.sum((F.col("after") > 0).cast("long") - (F.col("before") > 0).cast("long")).alias("n_docs"), F.sum(F.col("after") - F.col("before")).alias("n_links"))
    counts = store.read("pairs", touched, base).unionByName(diff) if store.has("pairs", base) else diff
    counts = counts.groupBy(*PAIR).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links")).where("n_links > 0")
    return store.commit(batch, base, replace={"links": (links, PAIR, buckets, touched), "pairs": (counts, PAIR, buckets, touched)})


def pairs(store: Store) -> DataFrame:
    return store.read("pairs")
