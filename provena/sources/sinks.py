"""Keyed upserts and exports. Upserts give the new table; writing it is Spark's own committed, partitioned write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import escape_quotes


def upsert_keep(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New keys are added, rows that exist stay as they are."""
    return target.unionByName(new.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert_replace(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows win with all their values, nulls too."""
    fresh = new.dropDuplicates(keys)
    return target.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert_fields(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only the fields that a new row has are set: null means absent."""
    n = new.dropDuplicates(keys).select(*[F.col(c).alias(f"n_{c}") for c in new.columns], F.lit(True).alias("n_"))
    on = [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in keys]
    joined = target.join(n, on, "full")
    cols = list(dict.fromkeys([*target.columns, *new.columns]))
    pick = lambda c: F.coalesce(*([F.col(f"n_{c}")] if c in new.columns else []), *([F.col(c)] if c in target.columns else [])).alias(c)
    return joined.select(*[pick(c) for c in cols])


def upsert_counts(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """inserted and matched rows of an upsert."""
    hit = new.dropDuplicates(keys).join(target.select(*keys).distinct().withColumn("t_", F.lit(True)), keys, "left")
    return hit.agg(F.count_if(F.col("t_").isNull()).alias("inserted"), F.count_if(F.col("t_").isNotNull()).alias("matched"))


def patch(target: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Set columns only on keys that exist."""
    cols = [c for c in values.columns if c != key]
    v = values.dropDuplicates([key]).select(key, *[F.col(c).alias(f"p_{c}") for c in cols], F.lit(True).alias("p_"))
    out = target.join(v, key, "left")
    have = lambda c: F.col(c) if c in target.columns else F.lit(None)
    return out.withColumns({c: F.when(F.col("p_"), F.col(f"p_{c}")).otherwise(have(c)) for c in cols}).drop("p_", *[f"p_{c}" for c in cols])


def edges_between(edges: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame, src: str, dst: str, node: str, keys: list[str]) -> DataFrame:
    """Edges whose two ends exist, once for each key."""
    a, b = src_nodes.select(F.col(node).alias(src)).distinct(), dst_nodes.select(F.col(node).alias(dst)).distinct()
    return edges.join(a, src, "left_semi").join(b, dst, "left_semi").dropDuplicates(keys)


def edge_id(*parts: str) -> Column:
    """A deterministic id, so that appending twice can be seen and undone."""
    return F.left(F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256), F.lit(16))


def delete_source(target: DataFrame, source: str | None = None) -> DataFrame:
    return target.limit(0) if source is None else target.where(~F.col("source").eqNullSafe(F.lit(source)))


def drop_failed(log: DataFrame, keys: DataFrame, key: str, failed: Column) -> DataFrame:
    """The log without the failed rows of some keys."""
    gone = log.withColumn("f_", failed).join(keys.select(key).distinct().withColumn("k_", F.lit(True)), key, "left")
    return gone.where(~(F.coalesce("k_", F.lit(False)) & F.coalesce("f_", F.lit(False)))).select(*log.columns)


def resume(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items not done yet, by id and never by count."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def write_jsonl(df: DataFrame, path: str, order: list | None = None) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_json_arrays(df: DataFrame, path: str, by: str) -> None:
    """One JSON array a line for the rows of each value of `by`, non-ASCII text as it is: a grouped table of bounded groups, not a table's whole."""
    rest = [c for c in df.columns if c != by]
    df.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("value")).select("value").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """Arrays become lines of a cell; with bom each file's header starts with U+FEFF."""
    flat = df.select(*[(F.array_join(c, "\n") if kind.startswith("array") else F.col(c)).alias(("﻿" if bom and k == 0 else "") + c) for k, (c, kind) in enumerate(df.dtypes)])
    flat.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def node_script(nodes: DataFrame, label: str, keys: list[str], texts: list[str] = ()) -> DataFrame:
    """One MERGE statement as text for each node."""
    value = lambda c: F.concat(F.lit("'"), F.replace(escape_quotes(F.col(c).cast("string"), c in texts), F.lit("\n"), F.lit("\\n")), F.lit("'"))
    props = lambda cols: F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), value(c)) for c in cols])
    sets = [F.concat(F.lit(f"n.{c} = "), value(c)) for c in nodes.columns if c not in keys]
    tail = F.concat(F.lit(" SET "), F.concat_ws(", ", *sets)) if sets else F.lit("")
    return nodes.select(F.concat(F.lit(f"MERGE (n:{label} {{"), props(keys), F.lit("})"), tail, F.lit(";")).alias("value"))


def edge_script(edges: DataFrame, kind: str, label: str, key: str) -> DataFrame:
    v = lambda c: F.concat(F.lit("'"), escape_quotes(F.col(c).cast("string")), F.lit("'"))
    return edges.select(F.concat(F.lit(f"MATCH (a:{label} {{{key}: "), v("src"), F.lit(f"}}), (b:{label} {{{key}: "), v("dst"), F.lit(f"}}) MERGE (a)-[:{kind}]->(b);")).alias("value"))


def write_graph(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines under path, and a manifest of their names and schemas."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    spark.createDataFrame([(n, df.schema.json()) for n, df in tables.items()], "name string, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_graph(spark, path: str) -> dict[str, DataFrame]:
    from pyspark.sql import types as T
    import json

    names = spark.read.schema("name string, schema string").json(f"{path}/manifest").collect()  # one row for each table
    return {r["name"]: spark.read.schema(T.StructType.fromJson(json.loads(r["schema"]))).json(f"{path}/{r['name']}") for r in names}
