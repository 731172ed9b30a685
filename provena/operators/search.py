"""Text search and vector similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def contains(column: str, needle: str) -> Column:
    """Literal, case-sensitive, null-safe; an empty needle holds everywhere."""
    return F.coalesce(F.col(column), F.lit("")).contains(needle)


def optional_filters(df: DataFrame, equal: dict | None = None, text: tuple[str, str] | None = None) -> DataFrame:
    """Filters that are left out where their value is empty or 'all'."""
    for c, v in (equal or {}).items():
        if v not in (None, "", "all"):
            df = df.where(F.col(c) == v)
    return df.where(contains(*text)) if text and text[1] else df


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}]+"), lambda x: x != "")


def token_table(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """id, token, tf, n_tokens over one or several fields."""
    t = docs.select(F.col(id_col).alias("id"), F.concat(*[tokens(F.col(f)) for f in fields]).alias("t")).withColumn("n_tokens", F.size("t").cast("long"))
    return t.select("id", "n_tokens", F.explode("t").alias("token")).groupBy("id", "n_tokens", "token").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str, id_col: str, fields: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score, matched of every row with any query word: one scan for the counts of all rows, one for the scores, and no shuffle of rows."""
    words = list(dict.fromkeys(w for w in "".join(ch.lower() if ch.isalnum() else " " for ch in query).split()))
    if not words:
        return docs.limit(0).select(F.col(id_col).alias("id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matched"))
    t = docs.select(F.col(id_col).alias("id"), F.concat(*[tokens(F.col(f)) for f in fields]).alias("t"))
    times = lambda w: F.size(F.filter("t", lambda x: x == F.lit(w)))
    t = t.select("id", F.size("t").alias("n"), *[times(w).alias(f"tf{k}") for k, w in enumerate(words)])
    stats = t.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(words))])
    score, matched, any_ = F.lit(0.0), F.lit(0).cast("long"), F.lit(False)
    for k in range(len(words)):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("mean")))
        score, matched, any_ = score + F.when(tf > 0, part).otherwise(0.0), matched + (tf > 0).cast("long"), any_ | (tf > 0)
    return t.where(any_).crossJoin(F.broadcast(stats)).select("id", score.alias("score"), matched.alias("matched"))  # stats is one row


def page(df: DataFrame, order: list, limit: int, skip: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similar_to(vectors: DataFrame, key, id_col: str, vector: str, k: int = 10, threshold: float = 0.85) -> DataFrame:
    """The k rows nearest by cosine to the row of one key, itself left out: a scan against one vector, and a top-k."""
    one = vectors.where(F.col(id_col) == key).select(F.col(vector).alias("q")).limit(1)
    s = vectors.where(F.col(id_col) != key).crossJoin(F.broadcast(one)).select(F.col(id_col), F.round(cosine(F.col(vector), F.col("q")), 6).alias("score"))
    return s.where(F.col("score") >= threshold).orderBy(F.col("score").desc(), id_col).limit(k)


def backlog(items: DataFrame, done: DataFrame, key: str, size: int = 96) -> DataFrame:
    """Items not yet done with a batch number; numbered within hash parts, so that no task orders all of them."""
    todo = items.join(done.select(key), key, "left_anti").withColumn("part", F.pmod(F.xxhash64(key), F.lit(64)))
    n = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return todo.withColumn("batch", F.concat_ws("-", "part", F.floor(n / size).cast("string"))).drop("part")
