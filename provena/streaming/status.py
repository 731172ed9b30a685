"""Latest status of each key from an append log, kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def windowed_counts(log: DataFrame, time: str, status: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows by window and status; rows over `late` behind the watermark are dropped by Spark."""
    return log.withWatermark(time, late).groupBy(F.window(time, width), status).agg(F.count("*").alias("n"))


def keep_latest(log: DataFrame, key: str, status: str, seq: str, target: str, checkpoint: str):
    """Start a query that upserts the latest status of each key into versions of target; readers take the newest by `current`."""

    def upsert(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(key).agg(F.max_by(status, seq).alias(status), F.max(seq).alias(seq))
        before = current(spark, target, n)
        merged = new if before is None else before.unionByName(new).groupBy(key).agg(F.max_by(status, seq).alias(status), F.max(seq).alias(seq))
        merged.write.mode("overwrite").parquet(f"{target}/v={n:012d}")

    return log.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version under target; a version is complete where its writer has committed it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    done = [n for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS")) and (before is None or int(n[2:]) < before)]
    return spark.read.parquet(f"{target}/{done[-1]}") if done else None
