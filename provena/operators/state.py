"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; set here only where it is unset and all is one process, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file:///tmp/checkpoints/provena"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended: the folder's owner cleans up
        pass


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, path)
    return path


#: While a table is written, Spark deletes the shuffle files of that job as soon as it ends: nothing else reads them.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, mode: str = "error", by: tuple[str, ...] = ()) -> None:
    """df written in Parquet files, zstd-compressed, in a folder for each value of `by`, without shuffle files left behind."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        out = df.write.mode(mode).option("compression", "zstd")
        (out.partitionBy(*by) if by else out).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """df written once and read back: short lineage that survives lost executors. The table goes when the driver ends, since results are lazy."""
    path = scratch(df.sparkSession, what)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """The tables that one operator writes on its way, dropped as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, what: str) -> DataFrame:
        """A new table, or more rows of one that is there."""
        path = self.paths.setdefault(what, scratch(self.spark, what))
        write(df, path, "append")
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for what in names:
            if what in self.paths:
                remove(self.spark, self.paths.pop(what))


def write_state(df: DataFrame, path: str) -> None:
    """Replace a state table: a new version is written by Spark's committer, then named in the pointer file by one rename.

    Readers see the old version or the new one, whole; a writer that is lost in between changes nothing.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    new, now = hadoop.Path(f"{path}/next-{version}"), hadoop.Path(f"{path}/current")
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    hadoop.FileContext.getFileContext(now.toUri(), spark._jsc.hadoopConfiguration()).rename(new, now, _overwrite(spark))


def _overwrite(spark: SparkSession):
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    return options


def read_state(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.text(f"{path}/current").first()[0]
    return spark.read.parquet(f"{path}/{version}")
