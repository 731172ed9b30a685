"""Coverage and data quality: status logs, gaps, duplicates, brackets, retries, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_status(log: DataFrame, key: str, status: str, seq: list[str]) -> DataFrame:
    """key, status of the last row."""
    return log.groupBy(key).agg(F.max_by(status, F.struct(*seq)).alias("status"))


def dominant_status(log: DataFrame, key: str, success: Column, reason: Column, seq: list[str]) -> DataFrame:
    """key, status (success if ever so) and the reason of the last failure where it never was."""
    g = log.groupBy(key).agg(F.max(success).alias("ok"), F.max_by(F.coalesce(F.nullif(reason, F.lit("")), F.lit("unknown")), F.when(~success, F.struct(*seq))).alias("last"))
    return g.select(key, F.when(F.col("ok"), F.lit("success")).otherwise(F.lit("failed")).alias("status"), F.when(~F.col("ok"), F.col("last")).alias("reason"))


def status_report(expected: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """Every expected key with its status, or missing."""
    return expected.join(status, key, "left").select(key, F.coalesce("status", F.lit("missing")).alias("status"))


def missing_in_range(seen: DataFrame, key: str, first: int, last: int | None = None) -> DataFrame:
    """Numbers of first to last (the largest seen by default) that no row has."""
    if last is None:
        last = seen.agg(F.max(F.col(key).cast("long"))).first()[0]  # one number
        last = first - 1 if last is None else last
    return seen.sparkSession.range(first, last + 1).toDF(key).join(seen.select(F.col(key).cast("long").alias(key)), key, "left_anti")


def duplicates(rows: DataFrame, key: str, place: str) -> DataFrame:
    """Keys of several rows, with their places in order, repeats kept."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(place)).alias("places")).where("n > 1")


def nearest_before(points: DataFrame, events: DataFrame, width: int = 10_000) -> DataFrame:
    """For each point (idx) the largest p of the events (at, p) with at < idx, null without: idx, p.

    The line is cut into stretches of `width`. What earlier stretches hold comes from one row for each of them, so that no
    task sorts all events.
    """
    p_type = events.schema["p"].dataType
    rows = events.select("at", F.lit(1).alias("kind"), "p").union(points.select(F.col("idx").alias("at"), F.lit(0), F.lit(None).cast(p_type)).distinct())
    rows = rows.withColumn("part", F.floor(F.col("at") / width))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = rows.groupBy("part").agg(F.max("p").alias("m")).select("part", F.max("m").over(w).alias("earlier"))
    inside = F.max("p").over(Window.partitionBy("part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("inside", inside).where("kind = 0").join(earlier, "part", "left")
    return out.select(F.col("at").alias("idx"), F.greatest("inside", "earlier").alias("p"))


def bracket(missing: DataFrame, ranges: DataFrame, width: int = 10_000) -> DataFrame:
    """For each missing idx the page before and after its gap: idx, prev_page, next_page.

    ranges: page, lo, hi, read in order of lo: prev is the last with hi < idx, next the first with lo > idx; a page that spans
    idx is neither.
    """
    m = missing.select(F.col("idx").cast("long").alias("idx")).distinct()
    prev = nearest_before(m, ranges.select(F.col("hi").cast("long").alias("at"), F.struct("lo", "page").alias("p")), width)
    back = nearest_before(m.select((-F.col("idx")).alias("idx")), ranges.select((-F.col("lo").cast("long")).alias("at"), F.struct((-F.col("lo").cast("long")).alias("lo"), (-F.col("page").cast("long")).alias("page")).alias("p")), width)
    nxt = back.select((-F.col("idx")).alias("idx"), (-F.col("p.page")).alias("next_page"))
    return prev.select("idx", F.col("p.page").cast("long").alias("prev_page")).join(nxt, "idx")


def gap_pages(brackets: DataFrame) -> DataFrame:
    """The distinct pages strictly between prev_page and next_page."""
    b = brackets.where("next_page - prev_page > 1")
    return b.select(F.explode(F.sequence(F.col("prev_page") + 1, F.col("next_page") - 1)).alias("page")).distinct()


def expected_range(seen: DataFrame, key: str, first: int = 0) -> DataFrame:
    """Every number from first to the largest seen, as key."""
    last = seen.agg(F.max(F.col(key).cast("long"))).first()[0]  # one number
    return seen.sparkSession.range(first, first if last is None else last + 1).toDF(key)


def retryable(log: DataFrame, key: str, success: Column, final: Column) -> DataFrame:
    """Keys that never succeeded and never failed for good."""
    return log.groupBy(key).agg(F.max(success | final).alias("done")).where(~F.col("done")).select(key)


def attempts(log: DataFrame, key: str, success: Column, seq: list[str], most: int) -> DataFrame:
    """key, n_rerun (failures since the last success), give_up; keys whose last row succeeded have none and are left out."""
    last = log.groupBy(key).agg(F.max(F.when(success, F.struct(*seq))).alias("last"))
    after = log.join(last, key).where(~success & (F.col("last").isNull() | (F.struct(*seq) > F.col("last"))))
    return after.groupBy(key).agg(F.count("*").alias("n_rerun")).withColumn("give_up", F.col("n_rerun") >= most)


def three_way(ids: dict[str, DataFrame], key: str) -> DataFrame:
    """Which of the named id sets have a key: one boolean column each."""
    rows = None
    for name, df in ids.items():
        one = df.select(F.col(key).alias(key), F.lit(name).alias("n_")).distinct()
        rows = one if rows is None else rows.union(one)
    return rows.groupBy(key).agg(*[F.max(F.col("n_") == name).alias(f"in_{name}") for name in ids])


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias("p_key")), F.col(child_key) == F.col("p_key"), "left_anti")


def assert_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break uniqueness, with their count: an empty result is a held constraint."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


#: What an error page of a protecting proxy says.
ERROR_MARKERS = ["cf-browser-verification", "challenge-platform", "just a moment", "checking your browser", 'id="cf-wrapper"', 'id="cf-error-details"', "error code 520", "error code 522", "cloudflare"]


def page_class(html: Column, block: str = "<article", person: str = "/narrator/", least: int = 100) -> Column:
    """empty_html, api_failure (an error page), no_hadith_blocks, no_narrators or success."""
    text = F.lower(F.coalesce(html, F.lit("")))
    error = F.lit(False)
    for m in ERROR_MARKERS:
        error = error | text.contains(m)
    return (
        F.when(F.length(F.trim(text)) < least, F.lit("empty_html")).when(error, F.lit("api_failure"))
        .when(~text.contains(block.lower()), F.lit("no_hadith_blocks")).when(~text.contains(person.lower()), F.lit("no_narrators")).otherwise(F.lit("success"))
    )
