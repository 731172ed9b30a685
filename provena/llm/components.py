"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step: every node links its larger (large) or smaller neighbours to the smallest of them and itself."""
    near = links.union(links.select(F.col("b"), F.col("a"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if large:
        new = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return new.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node that it reaches) for every node of links (a, b); nodes without links are left out.

    Rounds are written to the shared folder, each twice: both stars. The number of rounds grows with the logarithm of the
    longest path. A node with very many links is one row of a grouped minimum and a side that a skewed join may split.
    """
    spark, paths = links.sparkSession, []

    def written(df: DataFrame) -> DataFrame:
        paths.append(scratch(spark, "links"))
        df.write.parquet(paths[-1])
        if len(paths) > 2:
            discard(df, paths[-3])
        return spark.read.schema(df.schema).parquet(paths[-1])

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, after = None, state(now)
    while before != after:
        before = after
        now = written(_star(_star(now, True), False))
        after = state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
