"""Bindings of the star-schema tables to provenance tables, the same in Spark and in SQL.

A document is an order, its chain the order's lineitems in a total order, a person a supplier or a part, books and chapters
regions and nations; conversations are role-tagged sequences, events an append log, page URLs numbered places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import chains


class Tables:
    """Lazy access to one folder's tables and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def members(self) -> DataFrame:
        rows = self.lineitem.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("person_id"))
        return chains.number_members(rows, ["doc_id"], ["l_linenumber", "part_id", "person_id"]).select("doc_id", "pos", "part_id", "person_id")

    def edges(self, member: str = "person_id") -> DataFrame:
        return chains.consecutive_edges(self.members(), ["doc_id"], member)

    def log(self) -> DataFrame:
        return self.events.select("event_id", "ts", "user_id", F.col("event_type").alias("status"), F.col("props").alias("reason"))

    def page_numbers(self) -> DataFrame:
        """page, index: the number that ends a URL's path."""
        return self.pages.select(F.col("page_id").alias("page"), F.regexp_extract("url", r"/[a-z]{2}/(\d+)", 1).alias("i")).where("i <> ''").select("page", F.col("i").cast("long").alias("idx"))

    def turns(self) -> DataFrame:
        return self.conversations.select("conv_id", "turn", "role", "text")

    def books(self) -> DataFrame:
        """doc_id, chapter_id, chapter, book_id, book, total of every order."""
        o = self.orders.select(F.col("o_orderkey").alias("doc_id"), "o_custkey", F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("grade"))
        c = self.customer.select("c_custkey", "c_nationkey")
        n = self.nation.select("n_nationkey", F.col("n_name").alias("chapter"), "n_regionkey")
        r = self.region.select("r_regionkey", F.col("r_name").alias("book"))
        j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        return j.select("doc_id", F.col("n_nationkey").alias("chapter_id"), "chapter", F.col("r_regionkey").alias("book_id"), "book", "total", "grade")


MEMBER = "member AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_partkey AS part_id, l_suppkey AS person_id FROM lineitem)"
EDGE = MEMBER + ", edge AS (SELECT * FROM (SELECT doc_id, pos, person_id AS src, lead(person_id) OVER (PARTITION BY doc_id ORDER BY pos) AS dst FROM member) WHERE dst IS NOT NULL)"
PART_EDGE = MEMBER + ", edge AS (SELECT * FROM (SELECT doc_id, pos, part_id AS src, lead(part_id) OVER (PARTITION BY doc_id ORDER BY pos) AS dst FROM member) WHERE dst IS NOT NULL)"
BOOK = "books AS (SELECT o_orderkey AS doc_id, n_nationkey AS chapter_id, n_name AS chapter, r_regionkey AS book_id, r_name AS book, o_totalprice AS total, o_orderpriority AS grade FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
PAGE = r"page AS (SELECT page_id AS page, cast(regexp_extract(url, '/[a-z]{2}/(\d+)', 1) AS bigint) AS idx FROM pages WHERE regexp_extract(url, '/[a-z]{2}/(\d+)', 1) <> '')"
SPLIT = """g AS (SELECT conv_id, turn, role, text, 1 + coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chain_id,
  max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations),
split AS (SELECT conv_id, cast(chain_id AS bigint) AS chain_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, chain_id ORDER BY turn DESC) - 1 AS pos FROM g WHERE last IS NULL OR turn <= last)"""
