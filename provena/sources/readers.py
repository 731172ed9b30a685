"""Readers with explicit schemas. Files are listed and opened by Spark alone, whatever store they are in."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.text import strip_leading, trim_ws
from ..operators.state import materialize

#: File names that name no source.
GENERIC_NAMES = ["results", "result", "narrator_chains", "narrator_graph", "data"]


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A whole file that holds a JSON array; another top-level value is an error (checked on a line of text)."""
    first = spark.read.text(path, wholetext=True).select(F.left(F.ltrim(F.regexp_replace("value", r"^﻿?\s+", "")), F.lit(1)).alias("c")).where("c <> '['").limit(1)
    if not first.isEmpty():
        raise ValueError(f"{path}: the file's value is no JSON array")
    return spark.read.schema(schema).option("multiLine", True).json(path)


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str, mode: str = "skip", success: bool = False) -> DataFrame:
    """JSON lines: bad ones are skipped (skip), kept in _corrupt (count) or an error (strict); success keeps rows of that status."""
    reader = spark.read.schema(schema)
    if mode == "count":
        full = T.StructType(T._parse_datatype_string(schema).fields if isinstance(schema, str) else list(schema.fields)).add("_corrupt", "string")
        lines = spark.read.text(path).where(trim_ws("value") != "")
        return lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    out = reader.option("mode", {"skip": "DROPMALFORMED", "strict": "FAILFAST"}[mode]).json(path)
    return out.where("status = 'success'") if success else out


def kept_and_skipped(counted: DataFrame) -> DataFrame:
    return counted.agg(F.count_if(F.col("_corrupt").isNull()).alias("kept"), F.count_if(F.col("_corrupt").isNotNull()).alias("skipped"))


def biographies(rows: DataFrame, seq: str) -> DataFrame:
    """The last row of each person_id by seq; names without leading colons, empty texts as null."""
    last = rows.groupBy("person_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("person_id", seq)]), seq).alias("r")).select("person_id", "r.*")
    clean = {c: F.nullif(strip_leading(c) if c == "name" else F.col(c), F.lit("")) for c, kind in last.dtypes if kind == "string" and c != "person_id"}
    return last.withColumns(clean)


def json_map(spark: SparkSession, path: str, value: str = "array<string>") -> DataFrame:
    """key, value of one JSON object; keys that start with _comment are left out. A missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"key string, value {value}")
    text = spark.read.text(path, wholetext=True)
    m = text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))
    return m.where(~F.col("key").startswith("_comment"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def csv_text(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """text of a CSV with a header: the first column, or a named one that must be there. Blank rows are dropped, texts trimmed."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if column and column not in df.columns:
        raise ValueError(f"{path} has no column {column}: {df.columns}")
    c = F.col(f"`{column or df.columns[0]}`")
    return df.select(trim_ws(c).alias("text")).where("text <> ''")


def csv_sniffed(spark: SparkSession, path: str, names: tuple[str, ...] = ("hadith_text", "text", "hadith"), index: tuple[str, ...] = ("hadith_index", "index", "id")) -> DataFrame:
    """doc_index, text: the text from the first known column that is not empty, else from any; the index where it is digits, else the row's number."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    cols = df.columns
    df = number_rows(df, name="row_no_")
    lower = {c.lower(): c for c in cols}
    texts = [lower[n] for n in names if n in lower] + cols
    text = F.coalesce(*[F.nullif(trim_ws(F.col(f"`{c}`")), F.lit("")) for c in texts])
    idx = next((lower[n] for n in index if n in lower), None)
    number = F.when(F.col(f"`{idx}`").rlike(r"^\d+$"), F.col(f"`{idx}`").try_cast("long")) if idx else F.lit(None).cast("long")
    return df.select(F.coalesce(number, F.col("row_no_")).alias("doc_index"), text.alias("text")).where("text IS NOT NULL")


def number_rows(df: DataFrame, start: int = 1, name: str = "row_no", header: bool = False) -> DataFrame:
    """name numbers the rows of a DataFrame that reads files: files by their names, then rows as they stand; with header the first row of each file goes.

    A first pass counts the rows of each stretch that a task reads, the second adds what stands before: rows never move. The
    counts are a written table, so that Spark broadcasts them where their size is small and joins them otherwise.
    """
    held = df.withColumns({"file_": F.col("_metadata.file_path"), "at_": F.col("_metadata.file_block_start"), "m_": F.monotonically_increasing_id()})
    counted = held.groupBy("file_", "at_").agg(F.min("m_").alias("first_"), F.count("*").alias("n_"))
    if header:
        top = (F.row_number().over(Window.partitionBy("file_").orderBy("at_")) == 1).cast("int")
        counted = counted.withColumn("top_", top).select("file_", "at_", (F.col("first_") + F.col("top_")).alias("first_"), (F.col("n_") - F.col("top_")).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("file_", "at_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each stretch of some 128 MB
    stretches = materialize(counted.select("file_", "at_", "first_", before.alias("before_")), "stretches")
    met = held.join(stretches, ["file_", "at_"], "left")  # every row has its stretch; as a left join it is never the rows that are broadcast
    return met.where(F.coalesce(F.expr("m_ >= first_"), F.lit(True))).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("m_") - F.col("first_") + F.col("before_") + start).cast("long").alias(name))


def csv_shape(spark: SparkSession, path: str, names: dict[str, str], id_col: str = "id", header: bool = True) -> DataFrame:
    """A CSV in the shape that a pipeline wants: columns renamed by `names` (by their place, as _c0, _c1 ..., without a header), a sequential id from 1 where id_col is none of them. Rows of several files count on in the order of the files' names."""
    df = spark.read.option("header", header).option("multiLine", True).option("escape", '"').csv(path)
    df = df.withColumnsRenamed(names)
    if id_col in df.columns:
        return df
    return number_rows(df, name=id_col).select(id_col, *[F.col(f"`{c}`") for c in df.columns])


def label_tables(spark: SparkSession, path: str, label: str, schema: str | None = None) -> DataFrame:
    """The rows of one label of a node or edge table that is partitioned by label: only its folder is read."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path).where(F.col("label") == label)


def raw_lines(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Non-blank lines with their ordinal from 0, without the header: the first such line of each file. Several files count on in the order of their names."""
    lines = spark.read.text(path).where(trim_ws("value") != "")
    return number_rows(lines, 0, "ordinal", header).select("ordinal", F.col("value").alias("line"))


def id_lines(spark: SparkSession, path: str) -> DataFrame:
    """The first number of each line that has one."""
    return spark.read.text(path).select(F.regexp_extract("value", r"(\d+)", 1).alias("i")).where("i <> ''").select(F.col("i").cast("long").alias("id"))


def source_of_file(path: Column) -> Column:
    """The source that a file name tells: what stands before the first _, null for generic names."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    head = F.split(base, "_")[0]
    generic = lambda c: F.lower(c).isin(GENERIC_NAMES)
    return F.when(generic(base), F.lit(None)).when(base.contains("_") & ~generic(head), head).otherwise(base)


def detect_format(spark: SparkSession, path: str) -> str:
    """chains or result, by the keys of the array's first records; neither is an error."""
    keys = set(spark.read.option("multiLine", True).json(path).columns)
    return format_of(keys)


def format_of(keys) -> str:
    if "chains" in keys:
        return "chains"
    if "narrators" in keys:
        return "result"
    raise ValueError(f"neither chains nor narrators among {sorted(keys)}")


def graph_export(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv_to_parquet(spark: SparkSession, source: str, target: str) -> None:
    spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(source).write.mode("overwrite").parquet(target)


def manifest(rows: dict) -> str:
    return json.dumps(rows, ensure_ascii=False, sort_keys=True)
