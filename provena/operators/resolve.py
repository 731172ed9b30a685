"""Entity resolution: exact keys, collisions, context, rules given as a table, progressive prefixes, text keys.

Lookups are equi-joins on normalised keys that are computed once on either side; no mention is compared with all names.
Joins that may meet a very common name leave the strategy to adaptive execution, which broadcasts a small side by its measured
size and splits skewed partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import token_prefixes

#: Characters of the pieces by which contexts meet the patterns of rules; shorter patterns are met by themselves.
GRAM = 3


def exact_lookup(names: DataFrame, key: str = "key", id_col: str = "person_id") -> DataFrame:
    """key, n_ids, and person_id where the key has one id only; variants: all ids, sorted."""
    ids = F.array_sort(F.collect_set(id_col))
    return names.where(F.col(key) != "").groupBy(key).agg(ids.alias("ids")).select(F.col(key).alias("key"), F.size("ids").cast("long").alias("n_ids"), F.when(F.size("ids") == 1, F.col("ids")[0]).alias("person_id"), "ids")


def match_exact(mentions: DataFrame, lookup: DataFrame, key: str = "key") -> DataFrame:
    """Adds person_id and ambiguous (the key has several ids)."""
    side = lookup.select(F.col("key").alias("l_key"), "n_ids", F.col("person_id").alias("l_id"))
    out = mentions.join(side, F.col(key) == F.col("l_key"), "left")
    return out.withColumns({"person_id": F.col("l_id"), "ambiguous": F.coalesce(F.col("n_ids") > 1, F.lit(False))}).drop("l_key", "l_id", "n_ids")


def cascade(mentions: DataFrame, passes: list[tuple[str, DataFrame, list[str]]], existing: str | None = None) -> DataFrame:
    """The first pass that knows a mention gives its id: passes are (tag, table of key columns and person_id, key columns).

    Adds person_id and resolution (the tag; exact_match for an existing id; null where none applies). Each table has unique keys.
    """
    found: list[tuple[Column, Column]] = []
    out = mentions
    if existing:
        found.append((F.col(existing), F.lit("exact_match")))
    drop = []
    for k, (tag, rules, keys) in enumerate(passes):
        side = rules.select(*[F.col(c).alias(f"k{k}_{c}") for c in keys], F.col("person_id").alias(f"p{k}_"))
        on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"k{k}_{c}") for c in keys])
        out = out.join(side, on, "left")
        found.append((F.col(f"p{k}_"), F.lit(tag)))
        drop += [f"p{k}_", *[f"k{k}_{c}" for c in keys]]
    tag = reduce(lambda acc, x: F.when(x[0].isNotNull(), x[1]).otherwise(acc), reversed(found), F.lit(None).cast("string"))
    return out.withColumns({"new_id_": F.coalesce(*[c for c, _ in found]), "resolution": tag}).drop(*drop, *([existing] if existing == "person_id" else [])).withColumnRenamed("new_id_", "person_id")


def apply_rules(mentions: DataFrame, rules: DataFrame, name: str = "name", context: str = "context", work: dict | None = None) -> DataFrame:
    """Ordered rules as data: kind, name, pattern, value, priority (smaller first; equal ones by kind, pattern and value).

    exact: the name alone; context: the pattern is a substring of the context; default: where no context rule of the name
    holds; pair: name and context are equal to name and pattern (kinship, say). A null value stops with no result, a value
    marked ambiguous=true gives status ambiguous and no value. Adds value and status (resolved, ambiguous, unresolved).

    A pair rule is met by name and pattern, of a name's exact and default rules only the first counts, and a context rule is met
    by name and one q-gram of its pattern, the one that fewest patterns of the name have: a context meets the rules whose
    gram it contains, never all rules of its name, and those met are verified. work, a dict, gets pairs (distinct name and
    context) and candidates (context rules met).
    """
    from .state import materialize

    fields = ["kind", "name", "pattern", "value", "priority", "ambiguous"]
    r = rules.select(*[F.col(c).alias(f"r_{c}") for c in fields])
    verdict = F.struct("r_priority", "r_kind", "r_pattern", "r_value", "r_ambiguous").alias("v")
    pairs = materialize(mentions.select(F.col(name).alias("m_name"), F.col(context).alias("m_context")).distinct(), "rule-pairs")
    ctx = F.coalesce("m_context", F.lit(""))

    plain = r.where(F.col("r_kind").isin("exact", "default") | ((F.col("r_kind") == "context") & (F.col("r_pattern") == "")))
    plain = plain.groupBy("r_name").agg(F.min(verdict).alias("v"))
    found = pairs.join(plain, F.col("m_name") == F.col("r_name")).select("m_name", "m_context", "v")
    twins = r.where("r_kind = 'pair'").select("r_name", F.col("r_pattern").alias("r_at"), verdict)
    found = found.unionByName(pairs.join(twins, (F.col("m_name") == F.col("r_name")) & (ctx == F.col("r_at"))).select("m_name", "m_context", "v"))

    grams = lambda text, q: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(text, i, q)))
    size = F.least(F.length("r_pattern"), F.lit(GRAM))
    ordered = r.where("r_kind = 'context' AND r_pattern <> ''").withColumn("v", verdict)
    each = ordered.select("r_name", "r_pattern", F.explode(grams(F.col("r_pattern"), size)).alias("gram")).distinct()
    common = each.groupBy("r_name", "gram").agg(F.count("*").alias("n"))
    rarest = each.join(common, ["r_name", "gram"]).groupBy("r_name", "r_pattern").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    index = materialize(ordered.join(rarest, ["r_name", "r_pattern"]).select("r_name", "gram", "r_pattern", "v"), "rule-index")
    lengths = [x["q"] for x in index.select(F.length("gram").alias("q")).distinct().collect()]  # GRAM numbers at most
    if lengths:
        asked = pairs.where("m_context <> ''").join(index.select(F.col("r_name").alias("m_name")).distinct(), "m_name", "left_semi")
        own = F.concat(*[F.when(F.length("m_context") >= q, grams(F.col("m_context"), F.lit(q))).otherwise(F.array().cast("array<string>")) for q in lengths])
        met = asked.select("m_name", "m_context", F.explode(own).alias("gram")).join(index.withColumnRenamed("r_name", "m_name"), ["m_name", "gram"])
        if work is not None:
            work |= {"pairs": pairs.count(), "candidates": met.count()}
        found = found.unionByName(met.where(F.col("m_context").contains(F.col("r_pattern"))).select("m_name", "m_context", "v"))
    best = found.groupBy("m_name", "m_context").agg(F.min("v").alias("b")).withColumn("hit", F.lit(True))
    out = mentions.join(best, F.col(name).eqNullSafe(F.col("m_name")) & F.col(context).eqNullSafe(F.col("m_context")), "left")
    vague = F.coalesce(F.col("b.r_ambiguous"), F.lit(False))
    value = F.when(~vague, F.col("b.r_value"))
    status = F.when(vague, F.lit("ambiguous")).when(value.isNotNull(), F.lit("resolved")).otherwise(F.lit("unresolved"))
    return out.withColumns({"value": value, "status": status}).drop("m_name", "m_context", "b", "hit")


def open_prefixes(names: DataFrame, known: DataFrame, parts: int | None = None) -> DataFrame:
    """key, rank, prefix: the known prefixes of each name, by whole tokens, as far as the first sure one, the longest first; rank is the tokens left out.

    names: key; known: key, sure; both distinct and not empty. Both sides are sorted together, so that what a key is a prefix of follows it
    directly, and one pass keeps the stack of keys that are still open. Nothing but names and keys is shuffled, no prefix is made
    that nobody knows. A range may begin inside a key's names: the known prefixes of its first row, one row for each range, are
    looked up apart and given to those names that share them.
    """
    from .state import materialize

    spark = names.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = known.select("key", F.when(F.col("sure"), 2).otherwise(1).alias("kind")).union(names.select("key", F.lit(0)))
    order = F.concat("key", F.lit(" "))
    rows = rows.repartitionByRange(parts, order).sortWithinPartitions(order, F.col("kind").desc())

    def walk(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, first, open_ = TaskContext.get().partitionId(), None, []  # open_: (key, sure) of the keys that begin the present row
        for batch in batches:
            keys, cuts, shared, firsts = [], [], [], []
            for key, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                begins = first is None
                first = key if begins else first
                while open_ and key != open_[-1][0] and not key.startswith(open_[-1][0] + " "):
                    open_.pop()
                if kind:
                    open_.append((key, kind == 2))
                if kind and not begins:
                    continue
                mine = []
                for k, sure in reversed(open_) if not kind else ():
                    mine.append(len(k))
                    if sure:
                        break
                common = 0  # characters of the first row's tokens that this name begins with
                a, b = first + " ", key + " "
                if not (mine and open_[-len(mine)][1]):
                    while (end := a.find(" ", common)) >= 0 and a[: end + 1] == b[: end + 1]:
                        common = end + 1
                if mine or common or begins:
                    keys.append(key)
                    cuts.append(mine)
                    shared.append(-1 if kind else common - 1)
                    firsts.append(begins)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.string()), pa.array(cuts, pa.list_(pa.int32())), pa.array(shared, pa.int32()), pa.array(firsts)], names=["part", "key", "cuts", "shared", "first"])

    found = materialize(rows.mapInArrow(walk, "part int, key string, cuts array<int>, shared int, first boolean"), "open-prefixes")
    begin = found.where("first").select("part", F.explode(token_prefixes(F.split("key", " "))).alias("prefix"))  # a row for each range and token
    before = begin.join(known.select(F.col("key").alias("prefix")), "prefix").groupBy("part").agg(F.collect_set(F.length("prefix")).alias("before"))
    out = found.where("shared >= 0 OR size(cuts) > 0").join(before, "part", "left")
    # a first name's own stack has it alone, so what lies before a range is never in the stacks of the range
    lens = F.concat("cuts", F.filter(F.coalesce("before", F.array().cast("array<int>")), lambda n: n <= F.col("shared")))
    out = out.select("key", F.explode(F.array_distinct(lens)).alias("n")).select("key", F.substring(F.col("key"), F.lit(1), F.col("n")).alias("prefix"))
    spaces = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit(" "), F.lit("")))
    return out.select("key", (spaces("key") - spaces("prefix")).alias("rank"), "prefix")


def match_prefix(mentions: DataFrame, primary: DataFrame, secondary: DataFrame, variants: DataFrame, key: str = "key") -> DataFrame:
    """Longest known prefix of a normalised name: key, person_id, matched.

    primary and secondary are lookups (key, n_ids, person_id); the full name is tried first, then ever shorter prefixes; for one
    prefix primary, then secondary, then (where secondary's key is shared) its variants: the one id with a longer variant that
    the name starts with, else the one id without a longer variant that contradicts it. variants: key, person_id.
    """
    names = mentions.select(F.col(key).alias("key")).where("key <> ''").distinct()
    known = primary.where("n_ids = 1").select("key", F.lit(True).alias("sure")).union(secondary.select("key", F.col("n_ids") == 1))
    tries = open_prefixes(names, known.where("key <> ''").groupBy("key").agg(F.max("sure").alias("sure")))
    a = primary.where("n_ids = 1").select(F.col("key").alias("prefix"), F.col("person_id").alias("a_id"))
    b = secondary.select(F.col("key").alias("prefix"), F.col("person_id").alias("b_id"), (F.col("n_ids") > 1).alias("shared"))
    tried = tries.join(a, "prefix", "left").join(b, "prefix", "left")
    owners = variants.select(F.col("key").alias("prefix"), F.col("person_id").alias("o_id")).distinct()
    forms = variants.groupBy("person_id").agg(F.collect_set("key").alias("forms")).withColumnRenamed("person_id", "o_id")
    longer = F.filter("forms", lambda v: (F.length(v) > F.length("prefix")))
    fits = F.exists(longer, lambda v: F.col("key").startswith(v))
    conflict = F.exists(longer, lambda v: v.startswith(F.col("prefix")) & ~F.col("key").startswith(v))
    cand = tried.where("shared AND rank > 0").select("key", "rank", "prefix").join(owners, "prefix").join(forms, "o_id")
    picked = cand.groupBy("key", "rank").agg(F.collect_set(F.when(fits, F.col("o_id"))).alias("pos"), F.collect_set(F.when(~conflict, F.col("o_id"))).alias("free"))
    picked = picked.select("key", "rank", F.when(F.size("pos") == 1, F.col("pos")[0]).when(F.size("free") == 1, F.col("free")[0]).alias("c_id"))
    best = tried.join(picked, ["key", "rank"], "left").withColumn("id", F.coalesce("a_id", "b_id", "c_id")).where("id IS NOT NULL")
    return best.groupBy("key").agg(F.min_by("id", "rank").alias("person_id"), F.min_by("prefix", "rank").alias("matched"))


def match_text_key(docs: DataFrame, blocks: DataFrame, *, text: str = "text", size: int = 100, least: int = 15, in_order: bool = False) -> DataFrame:
    """Fill open slots of documents from the one block with the same text start.

    docs: doc_id, text, ids array (known and null, in reading order); blocks: text, ids. The block's ids that the document
    lacks are given to the open slots, sorted (or as they come with in_order), if there are as many. Gives doc_id, slot, person_id.
    """
    key = lambda c: F.left(F.col(c), F.lit(size))
    unique = blocks.where(F.length(F.col(text)) >= least).groupBy(key(text).alias("k")).agg(F.count("*").alias("n"), F.first("ids").alias("b_ids")).where("n = 1")
    joined = docs.withColumn("k", key(text)).join(unique, "k")
    free = F.array_except("b_ids", F.filter("ids", lambda x: x.isNotNull()))
    slots = F.filter(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.try_element_at("ids", i + 1).isNull())
    out = joined.select("doc_id", (free if in_order else F.array_sort(free)).alias("free"), slots.alias("slots")).where("size(free) = size(slots) AND size(slots) > 0")
    return out.select("doc_id", F.inline(F.arrays_zip("slots", "free"))).toDF("doc_id", "slot", "person_id")


def resolution_type(mentions: DataFrame, key: str, kinds: list[tuple[str, Column]], default: str = "remaining") -> DataFrame:
    """Adds type: unambiguous where no other row has the key, else the first kind that holds, else the default."""
    single = mentions.groupBy(F.col(key).alias("u_")).agg(F.count("*").alias("c_")).where("c_ = 1").drop("c_")
    kind = F.when(F.col("u_").isNotNull(), F.lit("unambiguous"))
    for name, holds in kinds:
        kind = kind.when(holds, F.lit(name))
    return mentions.join(single, F.col(key) == F.col("u_"), "left").withColumn("type", kind.otherwise(F.lit(default))).drop("u_")


def context_coverage(resolved: DataFrame, name: str = "name", frequency: str = "frequency") -> DataFrame:
    """Per name: pairs and mentions, how many of them are resolved, and that share in percent. resolved: as apply_rules gives it, with a frequency."""
    hit = F.col("status") == "resolved"
    g = resolved.groupBy(name).agg(F.count("*").alias("pairs"), F.count_if(hit).alias("resolved_pairs"), F.sum(frequency).alias("mentions"), F.sum(F.when(hit, F.col(frequency)).otherwise(0)).alias("resolved_mentions"))
    return g.withColumn("percent", F.round(F.lit(100.0) * F.col("resolved_mentions") / F.col("mentions"), 1))


def unmapped(mentions: DataFrame, mapping: DataFrame, name: str, key: str) -> DataFrame:
    """Raw names whose key no mapping has, by frequency."""
    return mentions.join(mapping.select(F.col("key").alias("m_key")), F.col(key) == F.col("m_key"), "left_anti").groupBy(name).agg(F.count("*").alias("frequency"))


def context_pairs(members: DataFrame, by: list[str], name: str, pos: str, sentinel: str, least: int = 2) -> DataFrame:
    """name, previous, frequency of pairs seen at least `least` times, with the name's total."""
    prev = F.lag(name, 1, sentinel).over(Window.partitionBy(*by).orderBy(pos))
    pairs = members.select(F.col(name).alias("name"), prev.alias("previous")).groupBy("name", "previous").agg(F.count("*").alias("frequency"))
    return pairs.withColumn("total", F.sum("frequency").over(Window.partitionBy("name"))).where(F.col("frequency") >= least)


def totals(resolved: DataFrame, tag: str = "resolution") -> DataFrame:
    """Mentions by tag and their share in percent."""
    counts = resolved.groupBy(F.coalesce(tag, F.lit("unresolved")).alias("resolution")).agg(F.count("*").alias("mentions"))
    return counts.withColumn("percent", F.round(F.lit(100.0) * F.col("mentions") / F.sum("mentions").over(Window.partitionBy(F.lit(1))), 1))


def with_overrides(resolved: DataFrame, overrides: DataFrame, keys: list[str], confidence: float = 0.8) -> DataFrame:
    """Manual ids (keys, manual_id) go before rules; needs_review marks resolutions of less confidence."""
    out = resolved.join(overrides, keys, "left")
    sure = F.when(F.col("manual_id").isNotNull(), 1.0).when(F.col("resolution") == "exact_match", 0.95).when(F.col("person_id").isNotNull(), 0.7).otherwise(0.0)
    return out.withColumns({"person_id": F.coalesce("manual_id", "person_id"), "resolution": F.when(F.col("manual_id").isNotNull(), F.lit("manual")).otherwise(F.col("resolution")), "confidence": sure}).withColumn("needs_review", F.col("confidence") < confidence).drop("manual_id")
