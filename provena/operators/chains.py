"""Chains: ordered sequences of members, split, reversed, paired and aggregated with windows.

A member table has one row for each place of a sequence; the columns that name the sequence are `by`, the place is `pos`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def split_by_marker(rows: DataFrame, by: list[str], pos: str, marker: Column, *, name: str | None = None, reverse: bool = True) -> DataFrame:
    """Close a chain after each marked row; rows after the last mark are dropped, a sequence without marks is one chain.

    Adds chain_id (from 1) and chain_pos (from 0, reversed by default). With name, rows of null or empty name are dropped first.
    """
    if name:
        rows = rows.where(F.coalesce(F.col(name), F.lit("")) != "")
    w = Window.partitionBy(*by)
    seen = w.orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(marker, 1).otherwise(0)
    out = rows.withColumns({"chain_id": (F.coalesce(F.sum(mark).over(seen), F.lit(0)) + 1).cast("long"), "last_": F.max(F.when(marker, F.col(pos))).over(w)})
    out = out.where(F.col("last_").isNull() | (F.col(pos) <= F.col("last_"))).drop("last_")
    order = F.col(pos).desc() if reverse else F.col(pos).asc()
    return out.withColumn("chain_pos", (F.row_number().over(Window.partitionBy(*by, "chain_id").orderBy(order)) - 1).cast("long"))


def number_members(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """pos from 0 by a total order."""
    return rows.withColumn("pos", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def consecutive_edges(members: DataFrame, by: list[str], member: str, pos: str = "pos") -> DataFrame:
    """by, pos, src, dst for each pair of neighbours."""
    nxt = F.lead(member).over(Window.partitionBy(*by).orderBy(pos))
    return members.select(*by, F.col(pos).alias("pos"), F.col(member).alias("src"), nxt.alias("dst")).where("dst IS NOT NULL AND src IS NOT NULL")


def terminal_members(members: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """The last row of each sequence; a lone member is its sequence's last at place 0."""
    return members.withColumn("n_", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(pos).desc()))).where("n_ = 1").drop("n_")


def edge_aggregate(edges: DataFrame, doc: str, order: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """by, src, dst, n_docs (distinct) and doc_ids in order of first appearance (order, or the document). by: what document numbers are unique within, such as the source."""
    first = edges.groupBy(*by, "src", "dst", doc).agg(F.min(order or doc).alias("o_"))
    return first.groupBy(*by, "src", "dst").agg(F.count("*").alias("n_docs"), F.transform(F.array_sort(F.collect_list(F.struct("o_", F.col(doc).alias("d_")))), lambda x: x["d_"]).alias("doc_ids"))


def first_occurrence(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key by the order columns (nulls first), with occurrence_count. Partial minima and counts go before the shuffle, so that a hot key is no task's sort."""
    rest = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first_"), F.count("*").alias("occurrence_count"))
    return first.select(*[F.col(f"first_.`{c}`").alias(c) if c in rest else F.col(c) for c in rows.columns], "occurrence_count")


def variants_per_id(rows: DataFrame, id_col: str, name: str) -> DataFrame:
    """person_id and its distinct names, sorted."""
    return rows.groupBy(F.col(id_col).alias("person_id")).agg(F.array_sort(F.collect_set(name)).alias("names"))


def mention_counts(rows: DataFrame, name: str, doc: str) -> DataFrame:
    """name, mention_count and n_docs (distinct) of every name."""
    return rows.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("mention_count"), F.count_distinct(doc).alias("n_docs"))


def occurrence_export(members: DataFrame, name: str, order: list[str]) -> DataFrame:
    """name, the place of its first occurrence and how often it occurs; blank names are left out."""
    from ..functions.text import trim_ws

    return first_occurrence(members.withColumn(name, trim_ws(name)).where(F.col(name) != ""), [name], order)


def hadith_page(blocks: DataFrame, text: str, fallback: str | None = None) -> DataFrame:
    """Adds number (leading digits, else the fallback), body (without the number) and plain (without marks) to each block of a page."""
    from ..functions.text import extract_number, strip_marks, strip_number

    number = extract_number(text) if fallback is None else F.coalesce(extract_number(text), F.col(fallback).cast("int"))
    return blocks.withColumns({"number": number, "body": strip_number(text), "plain": strip_marks(strip_number(text))})


def nested_documents(members: DataFrame, doc: str, chain: str, pos: str, name: str) -> DataFrame:
    """doc, n_chains, n_members, chains (named, in order) and unique members, each chain read from its last place to its first."""
    from ..functions.text import unique_lead_first

    one = members.groupBy(doc, chain).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(name).alias("name")))), lambda x: F.struct(x["name"].alias("name"))).alias("m"))
    g = one.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(chain).alias("c"), "m"))).alias("x"))
    chains = F.transform("x", lambda x: x["m"])
    named = F.transform("x", lambda x: F.struct(F.concat(F.lit("chain_"), x["c"].cast("string")).alias("chain_id"), F.transform(x["m"], lambda m: m["name"]).alias("names")))
    return g.select(doc, F.size("x").cast("long").alias("n_chains"), F.size(F.flatten(chains)).cast("long").alias("n_members"), named.alias("chains"), F.transform(unique_lead_first(chains), lambda m: m["name"]).alias("unique_names"))


def previous_member(members: DataFrame, by: list[str], member: str, sentinel: str | None, pos: str = "pos") -> DataFrame:
    """previous: the member before, the sentinel (or null) for the first."""
    return members.withColumn("previous", F.lag(member, 1, sentinel).over(Window.partitionBy(*by).orderBy(pos)))


def promote_roles(members: DataFrame, by: list[str], member: str, pos: str = "pos", high: str = "lead", low: str = "narrator") -> DataFrame:
    """member, role (high if it ever ends a sequence) and occurrences."""
    last = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(pos).desc())) == 1
    rows = members.select(F.col(member).alias("member"), last.alias("is_last"))
    return rows.groupBy("member").agg(F.when(F.max("is_last"), F.lit(high)).otherwise(F.lit(low)).alias("role"), F.count("*").alias("occurrences"))


def chain_table(members: DataFrame, by: list[str], name: str, pos: str = "pos") -> DataFrame:
    """by, length (all places), n_named, formatted names in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(name).alias("m")))), lambda x: x["m"])
    return members.groupBy(*by).agg(F.count("*").alias("length"), F.count(name).alias("n_named"), F.array_join(ordered, " → ").alias("formatted"))


def ingest(docs: DataFrame) -> dict[str, DataFrame]:
    """Tables of a role-tagged source: docs has source, doc_index, text, members array<struct<name, role>>.

    Gives persons (first form of each normalised name), docs, chains, members, edges, edge_counts, leads and errors (records
    without an index or without members, with the reason); null arrays are empty.
    """
    from ..functions.text import normalize_arabic

    size = F.coalesce(F.size("members"), F.lit(0))
    reason = F.when(F.col("doc_index").isNull(), F.lit("missing index")).when(size == 0, F.lit("no chains"))
    errors = docs.where(reason.isNotNull()).select("source", "doc_index", reason.alias("reason"))
    good = docs.where(reason.isNull())
    rows = good.select("source", "doc_index", F.posexplode("members").alias("at", "m")).select("source", "doc_index", "at", F.col("m.name").alias("name"), F.col("m.role").alias("role"))
    by = ["source", "doc_index"]
    split = split_by_marker(rows, by, "at", F.col("role") == "lead", name="name").withColumn("norm", normalize_arabic("name"))
    key = [*by, "chain_id"]
    edges = consecutive_edges(split, key, "norm", "chain_pos").withColumn("pos", F.col("pos") + 1)
    return {
        "persons": first_occurrence(split, ["source", "norm"], ["doc_index", "chain_id", "chain_pos"]).select("source", "norm", "name", "occurrence_count"),
        "docs": good.select("source", "doc_index", F.coalesce("text", F.lit("")).alias("text")),
        "chains": chain_table(split, key, "name", "chain_pos"),
        "members": split.select(*key, F.col("chain_pos").alias("pos"), "norm"),
        "edges": edges,
        "edge_counts": edge_aggregate(edges, "doc_index", by=("source",)),
        "leads": split.where("chain_pos = 0").select(*key, "norm"),
        "errors": errors,
    }


def validate(extractions: DataFrame, chains: str = "chains") -> DataFrame:
    """ok and the first failing reason of array<struct<chain_id, type, narrators array<struct<name, role>>>>."""
    from ..functions.text import normalize_whitespace

    bad_mark = lambda n: F.lit("رسول الله|النبي|محمد صلى الله عليه وسلم|رسولِ الله")
    name = lambda n: normalize_whitespace(n["name"])

    def problem(ch: Column) -> Column:
        people = ch["narrators"]
        each = F.filter(F.transform(people, lambda n: F.when(name(n) == "", F.lit("empty name")).when(F.regexp_like(name(n), bad_mark(n)), F.lit("prophet among narrators")).when(F.coalesce(n["role"], F.lit("")) == "", F.lit("missing role"))), lambda x: x.isNotNull())
        return (
            F.when(~F.coalesce(ch["chain_id"], F.lit("")).rlike(r"^chain_\d+$"), F.lit("bad chain id")).when(~F.coalesce(ch["type"], F.lit("")).isin("primary", "follow_up", "nested"), F.lit("bad type"))
            .when(F.coalesce(F.size(people), F.lit(0)) == 0, F.lit("no narrators")).when(F.size(each) > 0, F.try_element_at(each, F.lit(1)))
            .when(F.try_element_at(people, F.lit(-1))["role"] != "lead", F.lit("last is no lead"))
        )

    first = F.try_element_at(F.filter(F.transform(F.coalesce(F.col(chains), F.array().cast(extractions.schema[chains].dataType)), problem), lambda x: x.isNotNull()), F.lit(1))
    return extractions.withColumns({"ok": first.isNull(), "reason": F.coalesce(first, F.lit("ok"))})


def parse_pages(pages: DataFrame) -> DataFrame:
    """One row for each block of page_log rows of status success: hierarchy ids from breadcrumbs and plain texts."""
    from ..functions.text import breadcrumb, section_id, strip_marks

    ok = pages.where("status = 'success'").select("page_number", "book_id", "breadcrumb_links", F.posexplode("hadith_blocks").alias("block_no", "b"))
    book, chapter = breadcrumb(F.col("breadcrumb_links"), 1), breadcrumb(F.col("breadcrumb_links"), 2)
    return ok.select(
        F.concat_ws("_", F.col("book_id").cast("string"), F.col("page_number").cast("string")).alias("doc_id"), "block_no", "page_number", "book_id",
        section_id(book["href"]).alias("book_section_id"), book["text"].alias("book_name"), section_id(chapter["href"]).alias("chapter_section_id"), chapter["text"].alias("chapter_name"),
        F.col("b.full_text").alias("full_text"), F.col("b.matn").alias("matn"), strip_marks("b.full_text").alias("full_text_plain"), strip_marks("b.matn").alias("matn_plain"), F.col("b.narrators").alias("narrators"),
    )


def person_dimension(ids: DataFrame, bios: DataFrame, variants: DataFrame) -> DataFrame:
    """person_id, name (biography, else first variant, else a placeholder) and original_names of ids, biographies and variants together."""
    keys = ids.select("person_id").union(bios.select("person_id")).union(variants.select("person_id")).distinct()
    out = keys.join(bios, "person_id", "left").join(variants.select("person_id", F.col("names").alias("original_names")), "person_id", "left")
    first = F.try_element_at("original_names", F.lit(1))
    return out.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), first, F.concat(F.lit("narrator_"), "person_id")))
