"""Retry state of an append log, kept in a store: attempts since the last success, whatever order and however often rows come.

`last` has each item's latest success, `failures` each failed attempt after it, both bucketed by the item; what came before a
success is dropped with it. The state is a function of the set of rows seen: repeated rows count once, and rows that come late
change it as if they had come in time. Each batch of a stream is one version of the store under the batch's own id, so that a
batch that is run again after a restart changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.state import materialize
from ..operators.store import Store


def apply(store: Store, batch: str, log: DataFrame, buckets: int = 32) -> dict:
    """log: item, seq (of a total order within the item), ok. Rows without item, seq or ok are left out. Gives the new manifest."""
    base = store.manifest()
    if batch in base["applied"]:
        return base
    rows = materialize(log.where("item IS NOT NULL AND seq IS NOT NULL AND ok IS NOT NULL").select("item", "seq", "ok").distinct(), "retry-log")
    touched = store.touched(rows, ["item"], buckets)
    won, lost = rows.where("ok").select("item", "seq"), rows.where("NOT ok").select("item", "seq")
    if store.has("last", base):
        won, lost = won.unionByName(store.read("last", touched, base)), lost.unionByName(store.read("failures", touched, base))
    last = materialize(won.groupBy("item").agg(F.max("seq").alias("seq")), "retry-last")
    open_ = lost.distinct().join(last.withColumnRenamed("seq", "last"), "item", "left").where(F.col("last").isNull() | (F.col("seq") > F.col("last"))).select("item", "seq")
    return store.commit(batch, base, replace={"last": (last, ["item"], buckets, touched), "failures": (open_, ["item"], buckets, touched)})


def keep(log: DataFrame, path: str, checkpoint: str, name: str = "retries", buckets: int = 32):
    """Start a query that applies every batch of a streaming log (item, seq, ok) to the store at path and ends with the input at hand."""
    each = lambda batch, n: apply(Store(batch.sparkSession, path), f"{name}-{n}", batch, buckets)
    return log.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def queue(store: Store, most: int) -> DataFrame:
    """item, n_rerun (failures since its last success), give_up; items without any are left out."""
    return store.read("failures").groupBy("item").agg(F.count("*").alias("n_rerun")).withColumn("give_up", F.col("n_rerun") >= most)
