"""Stored tables in hash buckets and versions: a batch writes the buckets that it touches and nothing else.

A store is a folder. data/ holds what batches wrote, one folder for each table and batch with a partition for each bucket;
versions/ holds numbered manifests that say which of those make up each bucket. A batch writes its data with Spark's committer
and then its manifest under the next number by one rename that fails where the number is taken. Readers see the version before
or the one after, whole; a writer that is lost in between leaves data that no manifest names; of two writers from one version
one is refused. A batch has an id, and one that the store has seen (of the last REMEMBERED) changes nothing.

Buckets are pmod(xxhash64(keys), buckets): null keys are one key like any other. The driver holds the manifest, whose size goes
with the number of buckets, and the list of touched buckets.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from .state import remove, write

REMEMBERED = 1000


class Conflict(RuntimeError):
    """Another writer has made the version that this one was going to make."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # versions

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._fs(f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version that is still kept; an empty one where the store is new."""
        numbers = self.versions()
        if not numbers:
            return {"version": 0, "applied": [], "tables": {}, "notes": {}}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{numbers[-1] if version is None else version:09d}", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        new, fs = self._fs(f"{self.path}/versions/_{uuid.uuid4().hex}")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = hadoop.Path(f"{self.path}/versions/{manifest['version']:09d}")
        none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        none[0] = hadoop.Options.Rename.NONE
        try:
            if fs.exists(target):
                raise Conflict(f"version {manifest['version']} is there already")
            hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, target, none)
        except Exception as e:
            fs.delete(new, False)
            if fs.exists(target) and not isinstance(e, Conflict):
                raise Conflict(f"version {manifest['version']} is there already") from e
            raise

    def vacuum(self, keep: int = 1) -> int:
        """Remove all but the newest versions and the data that none of these names. Not while a batch is being written. Gives the folders removed."""
        numbers = self.versions()
        kept = [self.manifest(n) for n in numbers[-keep:]]
        for n in numbers[:-keep]:
            remove(self.spark, f"{self.path}/versions/{n:09d}")
        named = {f"{name}/{d}" for m in kept for name, t in m["tables"].items() for dirs in t["at"].values() for d in dirs}
        p, fs = self._fs(f"{self.path}/data")
        gone = 0
        for table in fs.listStatus(p) if fs.exists(p) else []:
            for d in fs.listStatus(table.getPath()):
                if f"{table.getPath().getName()}/{d.getPath().getName()}" not in named:
                    fs.delete(d.getPath(), True)
                    gone += 1
        return gone

    # tables

    def has(self, name: str, manifest: dict | None = None) -> bool:
        return name in (manifest or self.manifest())["tables"]

    @staticmethod
    def bucket(keys: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def touched(self, rows: DataFrame, keys: list[str], buckets: int) -> list[int]:
        """The buckets that rows fall into: at most as many numbers as there are buckets."""
        return sorted(r["b"] for r in rows.select(self.bucket(keys, buckets).alias("b")).distinct().collect())

    def read(self, name: str, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets: only their files are listed and read."""
        t = (manifest or self.manifest())["tables"][name]
        wanted = t["at"] if buckets is None else {str(b): t["at"].get(str(b), []) for b in buckets}
        paths = [f"{self.path}/data/{name}/{d}/bucket={b}" for b, dirs in wanted.items() for d in dirs]
        schema = StructType.fromJson(json.loads(t["schema"]))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, batch: str, base: dict, replace: dict | None = None, append: dict | None = None, notes: dict | None = None) -> dict:
        """One version more. replace: name to (rows, keys, buckets, touched): the rows are all that the touched buckets hold from
        now on; append: name to (rows, keys, buckets): the rows are added to their buckets. Rows that `stage` wrote have what it
        gave beside them as one entry more. base is the manifest that both were made from. Gives the new manifest, or base as it
        is where the batch was applied before.
        """
        if batch in base["applied"]:
            return base
        new = json.loads(json.dumps(base))
        new["version"], new["applied"] = base["version"] + 1, [*base["applied"], batch][-REMEMBERED:]
        new["notes"].update(notes or {})
        for name, (rows, keys, buckets, touched, *staged) in (replace or {}).items():
            t = self._table(new, name, rows, keys, buckets)
            written = staged[0] if staged else self._write(name, rows, keys, buckets).items()
            for b in touched:
                t["at"].pop(str(b), None)
            for b, d in written:
                t["at"].setdefault(b, []).append(d)
        for name, (rows, keys, buckets, *staged) in (append or {}).items():
            t = self._table(new, name, rows, keys, buckets)
            for b, d in staged[0] if staged else self._write(name, rows, keys, buckets).items():
                t["at"].setdefault(b, []).append(d)
        self._publish(new)
        return new

    @staticmethod
    def _table(manifest: dict, name: str, rows: DataFrame, keys: list[str], buckets: int) -> dict:
        t = manifest["tables"].setdefault(name, {"schema": rows.schema.json(), "keys": keys, "buckets": buckets, "at": {}})
        if t["keys"] != keys or t["buckets"] != buckets or [(f.name, f.dataType) for f in StructType.fromJson(json.loads(t["schema"]))] != [(f.name, f.dataType) for f in rows.schema]:
            raise ValueError(f"{name} has other keys, buckets or columns")
        return t

    def stage(self, name: str, rows: DataFrame, keys: list[str], buckets: int, dealt: bool = False) -> tuple[DataFrame, list[tuple[str, str]]]:
        """Rows that a commit will append, written ahead where they will stay, and read back: a batch that reads them again writes
        them once. Until then no manifest names them. dealt: the rows lie in few partitions a bucket already.
        """
        written = self._write(name, rows, keys, buckets, dealt)
        paths = [f"{self.path}/data/{name}/{d}/bucket={b}" for b, d in written.items()]
        back = self.spark.read.schema(rows.schema).parquet(*paths) if paths else self.spark.createDataFrame([], rows.schema)
        return back, list(written.items())

    def _write(self, name: str, rows: DataFrame, keys: list[str], buckets: int, dealt: bool = False) -> dict[str, str]:
        """Rows by bucket in a folder of their own; the buckets that got any."""
        d = f"w-{uuid.uuid4().hex}"
        path = f"{self.path}/data/{name}/{d}"
        rows = rows.withColumn("bucket", self.bucket(keys, buckets))
        write((rows if dealt else rows.hint("rebalance", "bucket")).sortWithinPartitions("bucket", *keys), path, by=("bucket",))
        p, fs = self._fs(path)
        found = (s.getPath().getName() for s in fs.listStatus(p))
        return {n.removeprefix("bucket="): d for n in found if n.startswith("bucket=")}

    # upserts

    def upsert(self, name: str, batch: str, rows: DataFrame, keys: list[str], how: str, buckets: int = 64) -> dict:
        """Merge rows into a table by key. how: keep (rows that exist stay), replace (new rows win whole, nulls too), fields (a new
        row sets what it has; null means absent), delete (rows of these keys go).

        Of several rows of one key in a batch the one of the largest values counts (for fields: each field's largest). Gives the
        counts inserted, matched, rewritten (rows in the touched buckets), touched and buckets; all 0 for a batch seen before.
        """
        base = self.manifest()
        none = {"inserted": 0, "matched": 0, "rewritten": 0, "touched": 0, "buckets": buckets}
        if batch in base["applied"]:
            return none
        touched = self.touched(rows, keys, buckets)
        schema = StructType.fromJson(json.loads(base["tables"][name]["schema"])) if self.has(name, base) else rows.schema
        values = [f.name for f in schema if f.name not in keys]
        new = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(schema[c].dataType).alias(c) for c in schema.names]).withColumn("new_", F.lit(1))
        old = (self.read(name, touched, base) if self.has(name, base) else rows.sparkSession.createDataFrame([], schema)).withColumn("new_", F.lit(0))
        g, whole = old.union(new).groupBy(*keys), F.struct(*values, F.lit(True).alias("is_"))
        flags = [F.min("new_").alias("first_"), F.max("new_").alias("last_")]
        if how == "fields":
            merged = g.agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("new_", c))).alias(c) for c in values], *flags)
        elif how in ("keep", "replace", "delete"):
            order = F.struct(F.col("new_") if how != "keep" else -F.col("new_"), whole)
            merged = g.agg(F.max_by(whole, order).alias("w_"), *flags).select(*keys, *[F.col(f"w_.{c}").alias(c) for c in values], "first_", "last_")
        else:
            raise ValueError(how)
        seen = Observation()
        merged = merged.observe(seen, F.count("*").alias("rewritten"), F.count_if(F.col("first_") == 1).alias("inserted"), F.count_if((F.col("first_") == 0) & (F.col("last_") == 1)).alias("matched"))
        if how == "delete":
            merged = merged.where("last_ = 0")
        self.commit(batch, base, replace={name: (merged.select(*schema.names), keys, buckets, touched)})
        return none | {k: seen.get[k] for k in ("rewritten", "inserted", "matched") if k != "inserted" or how != "delete"} | {"touched": len(touched)}
