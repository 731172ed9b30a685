"""Pages of an ordered table with the total, found by stored key bounds and counts and never by skipping rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .state import remove, scratch


class Paged:
    """A table written once in ranges of its order; for each range its rows and first and last key (one small row, held by the driver).

    A page by number reads the ranges that it lies in; a page after a key reads the range of that key on. Either costs the same
    wherever the page is. order: columns of a total order, ascending, nulls first.
    """

    def __init__(self, df: DataFrame, order: list[str], ranges: int, path: str | None = None):
        self.spark: SparkSession = df.sparkSession
        self.order, self.schema, self.path = order, df.schema, path or scratch(df.sparkSession, "paged")
        parts = df.repartitionByRange(ranges, *order).withColumn("range_", F.spark_partition_id()).sortWithinPartitions(*order)
        parts.write.partitionBy("range_").parquet(self.path)
        key = F.struct(*order)
        sizes = self._read().groupBy("range_").agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last")).orderBy("range_").collect()  # a row for each range
        self.ranges = [(r["range_"], r["n"], tuple(r["first"]), tuple(r["last"])) for r in sizes]
        self.total = sum(r[1] for r in self.ranges)

    def _read(self, ranges: list[int] | None = None) -> DataFrame:
        """All rows with their range, or those of some ranges: only their files are listed."""
        if ranges is None:
            return self.spark.read.schema(StructType([*self.schema.fields, StructField("range_", IntegerType())])).parquet(self.path)
        if not ranges:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/range_={k}" for k in ranges])

    def page(self, number: int, size: int) -> tuple[DataFrame, int]:
        """Page `number` (from 1) in order, and the total of rows; empty beyond the last page."""
        if number < 1 or size < 1:
            raise ValueError("pages are numbered from 1 and have rows")
        skip, before, chosen, offset = (number - 1) * size, 0, [], None
        for k, n, _, _ in self.ranges:
            if before + n > skip and before < skip + size:
                offset = skip - before if offset is None else offset
                chosen.append(k)
            before += n
        return self._read(chosen).orderBy(*self.order).offset(offset or 0).limit(size), self.total

    def after(self, key: tuple | None, size: int) -> tuple[DataFrame, int]:
        """The `size` rows that follow a key (None: the first ones), and the total of rows."""
        if size < 1:
            raise ValueError("a page has rows")
        rank = lambda k: tuple((v is not None, v) if v is not None else (False,) for v in k)
        chosen, held = [], 0
        for k, n, first, last in self.ranges:
            if (key is None or rank(last) > rank(key)) and held < size:
                chosen.append(k)
                held += n if key is None or rank(first) > rank(key) else 0
        rows = self._read(chosen)
        if key is not None:
            beyond = F.lit(False)
            for c, v in reversed(list(zip(self.order, key, strict=True))):
                same, more = (F.col(c).isNull(), F.col(c).isNotNull()) if v is None else (F.col(c) == F.lit(v), F.coalesce(F.col(c) > F.lit(v), F.lit(False)))
                beyond = more | (F.coalesce(same, F.lit(False)) & beyond)
            rows = rows.where(beyond)
        return rows.orderBy(*self.order).limit(size), self.total

    def drop(self) -> None:
        remove(self.spark, self.path)
