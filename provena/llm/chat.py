r"""Chat formatting of reply trees, by DataFrame operations only.

Messages are nodes with a parent. Self-joins that double the distance of each node's jump pointer (1, 2, 4, ... steps up)
give every node its depth and the sum of scores above it, in a number of rounds that grows with the logarithm of the depth.
The leaves are ranked by their path's score within their tree; the chosen leaves' paths are enumerated by the same pointers
from the longest jump down, each ancestor once, and each path becomes one conversation in a template:

    system    [SYS] text [/SYS]        user   [INST] text [/INST]
    assistant [ANS] text </s>          other  [TURN] role [IS] text [/TURN]

after a leading <s>, turns joined by a line feed. Wherever a text (or another role) holds one of these control strings, with
any number of backslashes after its first character, one more backslash is put there; reading takes one away again.

Defined cases: null texts are empty; a null role is an empty other role; null turns come first, repeated turns in the order
of role and text; a message whose parent is missing starts a tree, replies in a circle are an error; rows without a conversation id form one conversation
with a null id; an empty table gives no conversations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, scratch, table

#: Fixed values of the template.
CONTROL = r"(?:<s>|</s>|\[/?(?:SYS|INST|ANS|TURN)\]|\[IS\])"
_FIRST, _REST = r"([<\[])(\\*)", r"(s>|/s>|/?(?:SYS|INST|ANS|TURN)\]|IS\])"
TURN = r"(?s)(?:\[SYS\] .*? \[/SYS\]|\[INST\] .*? \[/INST\]|\[ANS\] .*? </s>|\[TURN\] .*? \[IS\] .*? \[/TURN\])"
_PART = r"(?s)^(?:\[(?:SYS|INST|ANS)\] |\[TURN\] .*? \[IS\] )(.*) (?:\[/SYS\]|\[/INST\]|</s>|\[/TURN\])$"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, r"$1$2$3")


def render(role: Column, text: Column) -> Column:
    """One turn; role and text aren't null."""
    t = escape(text)
    return (
        F.when(role == "system", F.concat(F.lit("[SYS] "), t, F.lit(" [/SYS]")))
        .when(role == "user", F.concat(F.lit("[INST] "), t, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit("[ANS] "), t, F.lit(" </s>")))
        .otherwise(F.concat(F.lit("[TURN] "), escape(role), F.lit(" [IS] "), t, F.lit(" [/TURN]")))
    )


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""

    def turn(x: Column) -> Column:
        role = (
            F.when(x.startswith("[SYS] "), F.lit("system")).when(x.startswith("[INST] "), F.lit("user")).when(x.startswith("[ANS] "), F.lit("assistant"))
            .otherwise(unescape(F.regexp_extract(x, r"(?s)^\[TURN\] (.*?) \[IS\] ", 1)))
        )
        return F.struct(role.alias("role"), unescape(F.regexp_extract(x, _PART, 1)).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), turn)


def paths(messages: DataFrame, *, tree: str, node: str, parent: str, score: str, best: int = 1) -> DataFrame:
    """tree, leaf, rank, depth, node of the `best` root-to-leaf paths of each tree (ties: the smaller leaf).

    messages: one row for each (tree, node); parent is null or missing at a root. Rounds are written to the shared folder.
    """
    spark, written = messages.sparkSession, []

    def keep(df: DataFrame) -> DataFrame:
        written.append(scratch(spark, "tree"))
        df.write.parquet(written[-1])
        return spark.read.schema(df.schema).parquet(written[-1])

    base = messages.select(F.col(tree).alias("t"), F.col(node).alias("n"), F.col(parent).alias("p"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("s"))
    same = F.col("t").eqNullSafe(F.col("o_t"))
    known = base.select(F.col("t").alias("o_t"), F.col("n").alias("o_n"))
    rooted = base.join(known, same & (F.col("p") == F.col("o_n")), "left").select("t", "n", F.col("o_n").alias("up"), "s")
    # up: the ancestor 2**k steps up; depth and total: steps and scores up to it. Trees that are done leave the rounds, so
    # that a round costs what the trees of at least 2**k steps hold.
    state = keep(rooted.select("t", "n", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.col("s").alias("total")))
    first, jumps, done = state, [], []
    while True:
        active = state.where(F.col("up").isNotNull())
        if active.isEmpty():
            done.append(state)
            break
        if len(jumps) > 40:  # 2**40 steps up and no root
            raise ValueError("replies go in a circle")
        jumps.append(active.select("t", "n", "up"))
        trees = active.select(F.col("t").alias("o_t")).distinct()
        done.append(state.join(trees, same, "left_anti"))
        now = state.join(trees, same, "left_semi")
        above = now.toDF("o_t", "b_n", "b_up", "b_depth", "b_total")
        on = same & (F.col("up") == F.col("b_n"))
        state = keep(now.join(above, on, "left").select("t", "n", F.col("b_up").alias("up"), (F.col("depth") + F.coalesce("b_depth", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("b_total", F.lit(0.0))).alias("total")))
    known = reduce(DataFrame.union, done)
    parents = first.where(F.col("up").isNotNull()).select(F.col("t").alias("o_t"), F.col("up").alias("o_n")).distinct()
    leaves = known.join(parents, same & (F.col("n") == F.col("o_n")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("t").orderBy(F.col("total").desc(), "n"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= best).select("t", F.col("n").alias("leaf"), "rank", "depth", F.col("n").alias("at"))
    for k in range(len(jumps) - 1, -1, -1):
        j = jumps[k].select(F.col("t").alias("o_t"), F.col("n").alias("o_n"), "up")
        above = chosen.join(j, same & (F.col("at") == F.col("o_n"))).select("t", "leaf", "rank", (F.col("depth") - (1 << k)).alias("depth"), F.col("up").alias("at"))
        chosen = keep(chosen.union(above))  # written: a plan that has itself twice would double every round
    return chosen.select(F.col("t").alias(tree), "leaf", "rank", "depth", F.col("at").alias(node))


def format_paths(enumerated: DataFrame, messages: DataFrame, *, tree: str, node: str, role: str = "role", text: str = "text") -> DataFrame:
    """tree, leaf, rank, n_turns, formatted and loss_spans (start and length in code points of assistant texts, escaped as they stand)."""
    m = messages.select(F.col(tree).alias("m_t"), F.col(node).alias("m_n"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    turns = enumerated.join(m, F.col(tree).eqNullSafe(F.col("m_t")) & (F.col(node) == F.col("m_n"))).select(F.col(tree).alias("t"), "leaf", "rank", "depth", F.col("role") == "assistant", render(F.col("role"), F.col("text")))
    turns = turns.toDF("t", "leaf", "rank", "depth", "loss", "piece")
    rows = turns.groupBy("t", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "loss", "piece"))).alias("x"))
    ends = F.aggregate("x", F.struct(F.lit(4).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans")), lambda a, x: F.struct((a["at"] + F.length(x["piece"]) + 1).alias("at"), F.when(x["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + 6).alias("start"), (F.length(x["piece"]) - 11).cast("long").alias("length"))))).otherwise(a["spans"]).alias("spans")))
    return rows.select(F.col("t").alias(tree), "leaf", "rank", F.size("x").cast("long").alias("n_turns"), F.concat(F.lit("<s>\n"), F.array_join(F.transform("x", lambda x: x["piece"]), "\n")).alias("formatted"), ends["spans"].alias("loss_spans"))


def conversations(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations stored as rows by turn: each row replies to the one before it, so every tree has one path."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    nodes = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).withColumn("node", F.row_number().over(order))
    path = scratch(rows.sparkSession, "messages")
    nodes.withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)}).write.parquet(path)
    messages = rows.sparkSession.read.parquet(path)
    return format_paths(paths(messages, tree="conv", node="node", parent="parent", score="score"), messages, tree="conv", node="node").withColumnRenamed("conv", conv)


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The contract's columns, read back from the formatted texts and their loss spans."""
    turns = parse(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda x: unescape(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int")))), "")
    read = formatted.select(conv, F.size(turns).cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(conv, "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ours = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    return digests(conversations(reduce(DataFrame.unionByName, [rows, ours])))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(s>|/s>|/?(?:SYS|INST|ANS|TURN)\]|IS\])', '\1\\\2\3', 'g') AS e FROM turns),
sized AS (
  SELECT *, length(e) + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11
    ELSE 22 + length(regexp_replace(role, '([<\[])(\\*)(s>|/s>|/?(?:SYS|INST|ANS|TURN)\]|IS\])', '\1\\\2\3', 'g')) END AS n FROM marked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(3 + sum(n + 1) AS bigint) AS formatted_chars
FROM sized GROUP BY conv_id
"""
