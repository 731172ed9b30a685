"""The named queries and the SQL that checks each; names start with the inventory line that they cover."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window, functions as F

from ..functions import text as T
from ..operators import chains, graph, html, quality, resolve, search
from ..operators.state import materialize
from ..sources import sinks
from .adapter import BOOK, EDGE, MEMBER, PAGE, PART_EDGE, SPLIT, Tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = partial(_run, f)
        if sql:
            SQL[name] = sql
        return f

    return add


def _run(f, spark, sf_dir):
    return f(Tables(spark, sf_dir))


# chains


@query("q_chain_reconstruction", f"WITH {MEMBER} SELECT doc_id, count(*) AS length, string_agg(cast(person_id AS varchar), ' → ' ORDER BY pos) AS chain FROM member GROUP BY doc_id")
def chain_reconstruction(t):
    m = t.members()
    return chains.chain_table(m.withColumn("name", F.col("person_id").cast("string")), ["doc_id"], "name").select("doc_id", "length", F.col("formatted").alias("chain"))


@query("win01_chn12_edges", f"WITH {EDGE} SELECT doc_id, pos, src, dst FROM edge")
def win01(t):
    return t.edges()


@query("win02_previous", f"WITH {MEMBER} SELECT doc_id, pos, person_id, lag(cast(person_id AS varchar), 1, 'start') OVER (PARTITION BY doc_id ORDER BY pos) AS previous FROM member")
def win02(t):
    m = t.members().withColumn("name", F.col("person_id").cast("string"))
    return chains.previous_member(m, ["doc_id"], "name", "start").select("doc_id", "pos", "person_id", "previous")


@query("win03_win05_chn01_split_by_lead", f"WITH {SPLIT} SELECT conv_id, chain_id, pos, turn, role FROM split")
def chn01(t):
    s = chains.split_by_marker(t.turns(), ["conv_id"], "turn", F.col("role") == "assistant")
    return s.select("conv_id", "chain_id", F.col("chain_pos").alias("pos"), "turn", "role")


@query("chn03_formatted_chains", f"WITH {SPLIT} SELECT conv_id, chain_id, count(*) AS length, string_agg(role, ' → ' ORDER BY pos) AS formatted FROM split GROUP BY conv_id, chain_id")
def chn03(t):
    s = chains.split_by_marker(t.turns(), ["conv_id"], "turn", F.col("role") == "assistant")
    return chains.chain_table(s, ["conv_id", "chain_id"], "role", "chain_pos").select("conv_id", "chain_id", "length", "formatted")


@query("win06_agg14_first_occurrence", f"WITH {MEMBER}, f AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY doc_id, pos) AS n, count(*) OVER (PARTITION BY person_id) AS c FROM member) SELECT person_id, doc_id, pos, c AS occurrence_count FROM f WHERE n = 1")
def win06(t):
    return chains.first_occurrence(t.members(), ["person_id"], ["doc_id", "pos"]).select("person_id", "doc_id", "pos", "occurrence_count")


@query("win07_latest_status", "SELECT user_id, arg_max(event_type, ts) AS status FROM events GROUP BY user_id")
def win07(t):
    return quality.latest_status(t.log(), "user_id", "status", ["ts", "event_id"])


@query("win08_cov07_dominant_status", "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'success' ELSE 'failed' END AS status, CASE WHEN NOT bool_or(event_type = 'purchase') THEN arg_max(coalesce(nullif(props, ''), 'unknown'), ts) END AS reason FROM events GROUP BY user_id")
def win08(t):
    return quality.dominant_status(t.log(), "user_id", F.col("status") == "purchase", F.col("reason"), ["ts", "event_id"])


@query("win09_last_members", f"WITH {MEMBER}, n AS (SELECT doc_id, count(*) AS length FROM member GROUP BY doc_id) SELECT m.doc_id, m.person_id, n.length FROM member m JOIN n ON m.doc_id = n.doc_id AND m.pos = n.length - 1")
def win09(t):
    m = t.members()
    n = m.groupBy("doc_id").agg(F.count("*").alias("length"))
    return m.join(n, "doc_id").where("pos = length - 1").select("doc_id", "person_id", "length")


@query("win10_first_members", f"WITH {MEMBER} SELECT person_id, count(*) AS n_docs FROM member WHERE pos = 0 GROUP BY person_id")
def win10(t):
    return t.members().where("pos = 0").groupBy("person_id").agg(F.count("*").alias("n_docs"))


@query("win11_renumber", f"WITH {SPLIT} SELECT conv_id, chain_id, 'chain_' || cast(row_number() OVER (PARTITION BY conv_id ORDER BY chain_id) AS varchar) AS name FROM (SELECT DISTINCT conv_id, chain_id FROM split)")
def win11(t):
    s = chains.split_by_marker(t.turns(), ["conv_id"], "turn", F.col("role") == "assistant").select("conv_id", "chain_id").distinct()
    return s.withColumn("name", F.concat(F.lit("chain_"), F.row_number().over(Window.partitionBy("conv_id").orderBy("chain_id")).cast("string")))


@query("win12_txt20_dedup_lines", r"""WITH l AS (SELECT doc_id, i, trim(x, ' ' || chr(9) || chr(10) || chr(13)) AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
p AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l WHERE x <> '')
SELECT d.doc_id, coalesce(n, 0) AS n_lines, coalesce(c, 0) AS n_chars FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT doc_id, count(*) AS n, cast(sum(length(x)) AS bigint) AS c FROM p WHERE before IS NULL OR before <> x GROUP BY doc_id) k ON d.doc_id = k.doc_id""")
def win12(t):
    lines = F.split(T.dedup_lines("text"), "\n")
    lines = F.filter(lines, lambda x: x != "")
    return t.documents.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x)).cast("long").alias("n_chars"))


@query("agg10_chn07_edge_counts", f"WITH {EDGE}, d AS (SELECT DISTINCT src, dst, doc_id FROM edge) SELECT src, dst, count(*) AS n_docs, string_agg(cast(doc_id AS varchar), ',' ORDER BY doc_id) AS doc_ids FROM d GROUP BY src, dst")
def agg10(t):
    a = chains.edge_aggregate(t.edges(), "doc_id")
    return a.select("src", "dst", "n_docs", F.array_join("doc_ids", ",").alias("doc_ids"))


@query("agg20_chn04_roles", f"WITH {MEMBER}, l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) = 1 AS is_last FROM member) SELECT person_id AS member, CASE WHEN bool_or(is_last) THEN 'lead' ELSE 'narrator' END AS role, count(*) AS occurrences FROM l GROUP BY person_id")
def agg20(t):
    return chains.promote_roles(t.members(), ["doc_id"], "person_id")


@query("chn08_error_rows", "SELECT o_orderkey AS doc_id, 'no chains' AS reason FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def chn08(t):
    d = t.orders.select(F.col("o_orderkey").alias("doc_id"))
    return quality.orphans(d, t.lineitem, "doc_id", "l_orderkey").withColumn("reason", F.lit("no chains"))


@query("chn10_first_per_section", "SELECT n_regionkey AS section_id, arg_min(n_name, n_nationkey) AS name FROM nation WHERE n_regionkey IS NOT NULL GROUP BY n_regionkey")
def chn10(t):
    return chains.first_occurrence(t.nation.where("n_regionkey IS NOT NULL"), ["n_regionkey"], ["n_nationkey"]).select(F.col("n_regionkey").alias("section_id"), F.col("n_name").alias("name"))


@query("chn12_terminal_edges", f"WITH {MEMBER}, l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS n FROM member) SELECT doc_id, pos, person_id FROM l WHERE n = 1")
def chn12(t):
    return chains.terminal_members(t.members(), ["doc_id"]).select("doc_id", "pos", "person_id")


@query("chn17_variants_per_id", "SELECT n_regionkey AS person_id, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def chn17(t):
    return chains.variants_per_id(t.nation, "n_regionkey", "n_name").withColumn("names", F.array_join("names", ","))


@query("chn18_distinct_ids", "SELECT DISTINCT l_suppkey AS person_id FROM lineitem WHERE l_returnflag = 'N'")
def chn18(t):
    return t.lineitem.where("l_returnflag = 'N'").select(F.col("l_suppkey").alias("person_id")).distinct()


@query("chn19_mention_counts", "SELECT p_name AS name, count(*) AS mention_count, count(DISTINCT l_orderkey) AS n_docs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name")
def chn19(t):
    j = t.lineitem.select("l_orderkey", "l_partkey").join(t.part.select("p_partkey", F.col("p_name").alias("name")), F.col("l_partkey") == F.col("p_partkey"))
    return chains.mention_counts(j, "name", "l_orderkey")


# filters and projections


@query("flt01_equality", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 7")
def flt01(t):
    return t.supplier.where("s_suppkey = 7").select("s_suppkey", "s_name")


@query("flt02_srch01_contains", "SELECT doc_id, length(text) AS n FROM documents WHERE contains(text, 'The ')")
def flt02(t):
    return t.documents.where(search.contains("text", "The ")).select("doc_id", F.length("text").cast("long").alias("n"))


@query("flt03_flt04_optional_filters", "SELECT doc_id FROM documents WHERE lang = 'en' AND contains(coalesce(text, ''), 'ing')")
def flt03(t):
    return search.optional_filters(t.documents, {"lang": "en", "source": "all"}, ("text", "ing")).select("doc_id")


@query("flt05_flt06_conflicting", "SELECT p_partkey FROM part WHERE p_type IS NOT NULL AND contains(p_type, 'STEEL') AND NOT contains(p_type, 'SMALL')")
def flt06(t):
    p = F.col("p_type")
    return t.part.where(p.isNotNull() & p.contains("STEEL") & ~p.contains("SMALL")).select("p_partkey")


@query("flt07_set04_label_union", "SELECT kind, count(*) AS n FROM (SELECT 'person' AS kind FROM supplier UNION ALL SELECT 'doc' FROM orders UNION ALL SELECT 'book' FROM region) WHERE kind = 'person' OR kind = 'doc' GROUP BY kind")
def flt07(t):
    u = t.supplier.select(F.lit("person").alias("kind")).unionByName(t.orders.select(F.lit("doc").alias("kind"))).unionByName(t.region.select(F.lit("book").alias("kind")))
    return u.where("kind = 'person' OR kind = 'doc'").groupBy("kind").agg(F.count("*").alias("n"))


@query("flt08_regex", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)apache license')")
def flt08(t):
    return t.documents.where(F.col("text").rlike("(?i)apache license")).select("doc_id")


@query("flt09_flt10_quantifiers", "SELECT conv_id, bool_or(role = 'system') AS any_system, bool_and(length(text) > 20) AS all_long FROM conversations GROUP BY conv_id")
def flt09(t):
    g = t.turns().groupBy("conv_id").agg(F.collect_list(F.struct("role", "text")).alias("x"))
    return g.select("conv_id", F.exists("x", lambda c: c["role"] == "system").alias("any_system"), F.forall("x", lambda c: F.length(c["text"]) > 20).alias("all_long"))


@query("flt11_jn14_not_exists", f"WITH {EDGE} SELECT DISTINCT src AS person_id FROM edge WHERE src NOT IN (SELECT dst FROM edge WHERE pos = 0)")
def flt11(t):
    e = t.edges()
    return e.select(F.col("src").alias("person_id")).distinct().join(e.where("pos = 0").select(F.col("dst").alias("person_id")), "person_id", "left_anti")


@query("flt12_flt13_case_coalesce", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS class, coalesce(nullif(p_brand, 'Brand#11'), p_name) AS label FROM part")
def flt12(t):
    return t.part.select("p_partkey", F.when(F.col("p_size") > 25, F.lit("large")).otherwise(F.lit("small")).alias("class"), F.coalesce(F.nullif("p_brand", F.lit("Brand#11")), "p_name").alias("label"))


@query("flt14_flt15_range_and_set", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 900 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def flt14(t):
    return t.orders.where(F.col("o_orderkey").between(100, 900)).join(t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey")


@query("prj01_prj04_transform_slice", f"WITH {MEMBER} SELECT doc_id, string_agg(cast(pos AS varchar) || ':' || cast(person_id AS varchar), ' ' ORDER BY pos) AS first_members FROM member WHERE pos < 3 GROUP BY doc_id")
def prj01(t):
    ordered = F.array_sort(F.collect_list(F.struct("pos", "person_id")))
    g = t.members().groupBy("doc_id").agg(ordered.alias("x"))
    return g.select("doc_id", F.array_join(F.transform(F.slice("x", 1, 3), lambda m: F.concat_ws(":", m["pos"].cast("string"), m["person_id"].cast("string"))), " ").alias("first_members"))


@query("prj02_prj05_preview", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents")
def prj05(t):
    return t.documents.select("doc_id", T.preview("text").alias("preview"))


# joins


@query("jn01_grf17_hierarchy", f"WITH {BOOK} SELECT doc_id, chapter, book FROM books")
def jn01(t):
    return t.books().select("doc_id", "chapter", "book")


@query("jn02_grf02_optional_hierarchy", "SELECT c_custkey, n_name AS chapter, r_name AS book FROM customer LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA') ON c_nationkey = n_nationkey")
def jn02(t):
    place = t.nation.join(t.region.where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(place, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.col("n_name").alias("chapter"), F.col("r_name").alias("book"))


@query("jn03_grf26_search_with_counts", f"WITH {MEMBER} SELECT o_orderkey AS doc_id, count(DISTINCT m.doc_id) AS n_chains, count(m.pos) AS n_members FROM orders LEFT JOIN member m ON o_orderkey = m.doc_id WHERE contains(o_orderpriority, 'URGENT') GROUP BY o_orderkey")
def jn03(t):
    o = t.orders.where(search.contains("o_orderpriority", "URGENT")).select("o_orderkey")
    j = o.join(t.members(), F.col("o_orderkey") == F.col("doc_id"), "left")
    return j.groupBy(F.col("o_orderkey").alias("d")).agg(F.count_distinct("doc_id").alias("n_chains"), F.count("pos").alias("n_members")).withColumnRenamed("d", "doc_id")


@query("jn04_jn05_named_edges", f"WITH {EDGE} SELECT doc_id, pos, a.s_name AS src_name, b.s_name AS dst_name FROM edge JOIN supplier a ON src = a.s_suppkey JOIN supplier b ON dst = b.s_suppkey")
def jn05(t):
    s = t.supplier
    a, b = s.select(F.col("s_suppkey").alias("src"), F.col("s_name").alias("src_name")), s.select(F.col("s_suppkey").alias("dst"), F.col("s_name").alias("dst_name"))
    return t.edges().join(a, "src").join(b, "dst").select("doc_id", "pos", "src_name", "dst_name")


@query("jn06_last_duplicate_wins", "SELECT o_orderkey AS doc_id, coalesce(f, '') AS flag FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_returnflag, struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey)) AS f FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def jn06(t):
    last = t.lineitem.groupBy("l_orderkey").agg(F.max_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("f"))
    return t.orders.join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("doc_id"), F.coalesce("f", F.lit("")).alias("flag"))


@query("jn12_jn13_positional", f"WITH {MEMBER}, l AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) SELECT doc_id, pos, coalesce(n_name, '') AS line FROM member LEFT JOIN l ON pos = i")
def jn12(t):
    lines = t.nation.select("n_name", (F.row_number().over(Window.orderBy("n_nationkey")) - 1).cast("long").alias("i"))  # a table of 25 rows
    return t.members().join(lines, F.col("pos") == F.col("i"), "left").select("doc_id", "pos", F.coalesce("n_name", F.lit("")).alias("line"))


@query("jn15_grf18_shared_members", f"WITH {MEMBER} SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.person_id FROM member a JOIN member b ON a.person_id = b.person_id AND b.doc_id = a.doc_id + 1")
def jn15(t):
    """Members that each document shares with the next, repeats kept."""
    m = t.members().select("doc_id", "person_id")
    return m.toDF("doc_a", "person_id").join(m.select((F.col("doc_id") - 1).alias("doc_a"), "person_id", F.col("doc_id").alias("doc_b")), ["doc_a", "person_id"]).select("doc_a", "doc_b", "person_id")


@query("jn17_agg02_grf01_stats", f"WITH {EDGE} SELECT (SELECT count(*) FROM supplier) AS persons, (SELECT count(*) FROM orders) AS docs, (SELECT count(*) FROM edge) AS edges, (SELECT count(DISTINCT doc_id) FROM member) AS chains")
def stats(t):
    one = [t.supplier.agg(F.count("*").alias("persons")), t.orders.agg(F.count("*").alias("docs")), t.edges().agg(F.count("*").alias("edges")), t.members().agg(F.count_distinct("doc_id").alias("chains"))]
    out = one[0]
    for x in one[1:]:
        out = out.crossJoin(x)  # one row each
    return out


@query("jn18_grf21_name_pairs", f"WITH {EDGE} SELECT a.s_name AS src_name, b.s_name AS dst_name, count(*) AS n FROM edge JOIN supplier a ON src = a.s_suppkey JOIN supplier b ON dst = b.s_suppkey WHERE contains(a.s_name, '1') AND contains(b.s_name, '7') GROUP BY a.s_name, b.s_name")
def jn18(t):
    s = t.supplier
    a = s.where(search.contains("s_name", "1")).select(F.col("s_suppkey").alias("src"), F.col("s_name").alias("src_name"))
    b = s.where(search.contains("s_name", "7")).select(F.col("s_suppkey").alias("dst"), F.col("s_name").alias("dst_name"))
    return t.edges().join(a, "src").join(b, "dst").groupBy("src_name", "dst_name").agg(F.count("*").alias("n"))


@query("jn19_exploded_docs", f"WITH {EDGE}, d AS (SELECT DISTINCT src, dst, doc_id FROM edge WHERE src = 5) SELECT dst, doc_id, o_orderpriority AS grade FROM d JOIN orders ON doc_id = o_orderkey")
def jn19(t):
    a = chains.edge_aggregate(t.edges().where("src = 5"), "doc_id").select("dst", F.explode("doc_ids").alias("doc_id"))
    return a.join(t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("grade")), "doc_id").select("dst", "doc_id", "grade")


@query("jn20_grf21_neighbours", f"WITH {EDGE} SELECT other, direction, count(*) AS n FROM (SELECT src AS node, dst AS other, 'out' AS direction FROM edge UNION ALL SELECT dst, src, 'in' FROM edge) WHERE node = 3 GROUP BY other, direction")
def jn20(t):
    return graph.undirected(t.edges()).where("node = 3").groupBy("other", "direction").agg(F.count("*").alias("n"))


@query("jn21_docs_of_person", f"WITH {EDGE} SELECT DISTINCT doc_id FROM (SELECT doc_id FROM edge WHERE src = 9 UNION ALL SELECT doc_id FROM member WHERE person_id = 9)")
def jn21(t):
    return t.edges().where("src = 9").select("doc_id").union(t.members().where("person_id = 9").select("doc_id")).distinct()


# aggregates, order, sets


@query("agg01_grf20_counts", "SELECT 'customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")
def agg01(t):
    out = None
    for n in ("customer", "nation", "part", "supplier"):
        one = getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("label"), "n")
        out = one if out is None else out.union(one)
    return out


@query("agg03_grf18_top_pairs", f"WITH {EDGE} SELECT src, dst, count(*) AS n FROM edge GROUP BY src, dst ORDER BY n DESC, src, dst LIMIT 10")
def top_pairs(t):
    return t.edges().groupBy("src", "dst").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "src", "dst").limit(10)


@query("agg04_agg05_distinct_counts", f"WITH {EDGE} SELECT src AS person_id, count(DISTINCT dst) AS students, count(DISTINCT doc_id) AS docs, count(*) AS links FROM edge GROUP BY src")
def agg05(t):
    return t.edges().groupBy(F.col("src").alias("person_id")).agg(F.count_distinct("dst").alias("students"), F.count_distinct("doc_id").alias("docs"), F.count("*").alias("links"))


@query("agg06_grf22_length_stats", f"WITH {MEMBER}, n AS (SELECT doc_id, count(*) AS length FROM member GROUP BY doc_id) SELECT min(length) AS shortest, max(length) AS longest, round(avg(length), 6) AS mean, count(*) AS chains FROM n")
def agg06(t):
    n = t.members().groupBy("doc_id").agg(F.count("*").alias("length"))
    return n.agg(F.min("length").alias("shortest"), F.max("length").alias("longest"), F.round(F.avg("length"), 6).alias("mean"), F.count("*").alias("chains"))


@query("agg07_grf22_length_distribution", f"WITH {MEMBER}, n AS (SELECT doc_id, count(*) AS length FROM member GROUP BY doc_id) SELECT length, count(*) AS chains FROM n GROUP BY length")
def agg07(t):
    return t.members().groupBy("doc_id").agg(F.count("*").alias("length")).groupBy("length").agg(F.count("*").alias("chains"))


@query("agg08_grf19_two_keys", "SELECT p_brand AS grade, p_type AS generation, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand, p_type")
def agg08(t):
    return t.part.where("p_brand IS NOT NULL").groupBy(F.col("p_brand").alias("grade"), F.col("p_type").alias("generation")).agg(F.count("*").alias("n"))


@query("agg09_grf24_weighted_degree", f"WITH {EDGE}, w AS (SELECT src, dst, count(DISTINCT doc_id) AS n FROM edge GROUP BY src, dst) SELECT node, cast(sum(n) AS bigint) AS weight FROM (SELECT src AS node, n FROM w UNION ALL SELECT dst, n FROM w WHERE src <> dst) GROUP BY node")
def agg09(t):
    return graph.weighted_degree(chains.edge_aggregate(t.edges(), "doc_id").select("src", "dst", "n_docs"), "n_docs")


@query("agg11_grf04_ordered_collect", f"WITH {EDGE} SELECT doc_id, string_agg(cast(src AS varchar), ',' ORDER BY pos) AS sources, arg_max(dst, pos) AS last FROM edge GROUP BY doc_id")
def agg11(t):
    p = graph.document_path(t.edges(), "doc_id")
    return p.select("doc_id", F.array_join(F.slice("nodes", F.lit(1), F.size("nodes") - 1), ",").alias("sources"), F.element_at("nodes", -1).alias("last"))


@query("agg12_txt16_first_words", r"SELECT w AS word, count(*) AS n FROM (SELECT string_split_regex(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '\s+')[1] AS w FROM documents) WHERE w <> '' AND NOT regexp_matches(w, '^[0-9]+$') GROUP BY w ORDER BY n DESC, w LIMIT 20")
def agg12(t):
    return t.documents.select(T.first_word("text").alias("word")).where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(20)


@query("agg13_res11_srt04_context_pairs", f"""WITH {MEMBER}, m AS (SELECT doc_id, pos, p_name AS name FROM member JOIN part ON part_id = p_partkey), p AS (SELECT name, lag(name, 1, 'start') OVER (PARTITION BY doc_id ORDER BY pos) AS previous FROM m),
c AS (SELECT name, previous, count(*) AS frequency FROM p GROUP BY name, previous), s AS (SELECT *, cast(sum(frequency) OVER (PARTITION BY name) AS bigint) AS total FROM c) SELECT name, previous, frequency, total FROM s WHERE frequency >= 2""")
def agg13(t):
    m = t.members().join(t.part.select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("name")), "part_id")
    return resolve.context_pairs(m, ["doc_id"], "name", "pos", "start")


@query("agg15_conditional_percent", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS finished, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS percent FROM orders")
def agg15(t):
    n = F.count_if(F.col("o_orderstatus") == "F")
    return t.orders.agg(F.count("*").alias("total"), n.alias("finished"), F.round(F.lit(100.0) * n / F.count("*"), 1).alias("percent"))


@query("agg16_res07_collisions", "SELECT p_name AS key, count(DISTINCT p_partkey) AS n_ids FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1")
def agg16(t):
    return resolve.exact_lookup(t.part.select(F.col("p_name").alias("key"), F.col("p_partkey").alias("person_id"))).where("n_ids > 1").select("key", "n_ids")


@query("agg17_common_to_all_chains", f"WITH {SPLIT}, n AS (SELECT conv_id, count(DISTINCT chain_id) AS n_chains FROM split GROUP BY conv_id), o AS (SELECT conv_id, role, count(DISTINCT chain_id) AS k FROM split GROUP BY conv_id, role) SELECT o.conv_id, role, n_chains FROM o JOIN n ON o.conv_id = n.conv_id WHERE k = n_chains")
def agg17(t):
    s = chains.split_by_marker(t.turns(), ["conv_id"], "turn", F.col("role") == "assistant")
    return graph.shared_by_all(s, "conv_id", "chain_id", "role")


@query("agg18_page_ranges", f"WITH {PAGE} SELECT page, min(idx) AS lo, max(idx) AS hi FROM page GROUP BY page")
def agg18(t):
    return t.page_numbers().groupBy("page").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))


@query("agg19_failure_reasons", "SELECT coalesce(nullif(props, ''), 'unknown') AS reason, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def agg19(t):
    return t.log().where("status = 'error'").groupBy(F.coalesce(F.nullif("reason", F.lit("")), F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))


@query("srt01_srt02_null_order", "SELECT user_id, CASE WHEN user_id % 7 <> 0 THEN value END AS v FROM (SELECT user_id, round(max(value), 6) AS value FROM events GROUP BY user_id) ORDER BY v ASC NULLS LAST, user_id LIMIT 25")
def srt02(t):
    g = t.events.groupBy("user_id").agg(F.round(F.max("value"), 6).alias("value")).select("user_id", F.when(F.col("user_id") % 7 != 0, F.col("value")).alias("v"))
    return g.orderBy(F.col("v").asc_nulls_last(), "user_id").limit(25)


@query("srt03_numeric_then_text", r"SELECT k, row_number() OVER (ORDER BY regexp_matches(k, '^\d+$') DESC, try_cast(k AS bigint), k) AS place FROM (SELECT CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE cast(n_nationkey AS varchar) END AS k FROM nation)")
def srt03(t):
    k = t.nation.select(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.col("n_nationkey").cast("string")).alias("k"))
    w = Window.orderBy(F.col("k").rlike(r"^\d+$").desc(), F.expr("try_cast(k AS bigint)"), "k")  # a table of 25 rows
    return k.select("k", F.row_number().over(w).cast("long").alias("place"))


@query("srt05_grf30_pagination", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def srt05(t):
    return search.page(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 20, 40)


@query("srt06_cov10_retry_queue", "WITH l AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS last FROM events GROUP BY user_id) SELECT e.user_id, count(*) AS n_rerun, count(*) >= 60 AS give_up FROM events e JOIN l ON e.user_id = l.user_id WHERE event_type <> 'purchase' AND (last IS NULL OR ts > last) GROUP BY e.user_id")
def srt06(t):
    return quality.attempts(t.log(), "user_id", F.col("status") == "purchase", ["ts", "event_id"], 60)


@query("srt08_top_per_group", f"WITH {EDGE}, c AS (SELECT src, dst, count(*) AS n FROM edge GROUP BY src, dst), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rank FROM c) SELECT src, dst, n, rank FROM r WHERE rank <= 3")
def srt08(t):
    c = t.edges().groupBy("src", "dst").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.col("n").desc(), "dst")).cast("long")).where("rank <= 3")


@query("set01_set02_set03_sets", "SELECT 'difference' AS op, count(*) AS n FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'intersection', count(*) FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'union', count(*) FROM (SELECT o_orderkey FROM orders UNION SELECT l_orderkey FROM lineitem)")
def sets(t):
    a, b = t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k"))
    parts = {"difference": a.subtract(b), "intersection": a.intersect(b), "union": a.union(b).distinct()}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.union(one)
    return out


@query("set06_cov02_missing_indices", f"WITH {PAGE} SELECT r AS idx FROM (SELECT unnest(range(1, (SELECT max(idx) FROM page) + 1)) AS r) WHERE r NOT IN (SELECT idx FROM page)")
def set06(t):
    return quality.missing_in_range(t.page_numbers(), "idx", 1)


@query("set07_ordered_dedup", "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def set07(t):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return t.turns().groupBy("conv_id").agg(F.array_join(F.array_distinct(ordered), ",").alias("roles"))


@query("set08_set09_per_key_sets", "WITH a AS (SELECT l_suppkey AS k, l_returnflag AS f FROM lineitem WHERE l_linenumber = 1), b AS (SELECT l_suppkey AS k, l_linestatus AS f FROM lineitem WHERE l_linenumber = 2), u AS (SELECT DISTINCT k, f FROM (SELECT * FROM a UNION ALL SELECT * FROM b)), d AS (SELECT DISTINCT k, f FROM a WHERE (k, f) NOT IN (SELECT k, f FROM b)) SELECT s_suppkey AS person_id, coalesce((SELECT string_agg(f, ',' ORDER BY f) FROM d WHERE d.k = s_suppkey), '') AS missing, coalesce((SELECT string_agg(f, ',' ORDER BY f) FROM u WHERE u.k = s_suppkey), '') AS merged FROM supplier")
def set08(t):
    a = t.lineitem.where("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("person_id")).agg(F.collect_set("l_returnflag").alias("a"))
    b = t.lineitem.where("l_linenumber = 2").groupBy(F.col("l_suppkey").alias("person_id")).agg(F.collect_set("l_linestatus").alias("b"))
    none = F.array().cast("array<string>")
    j = t.supplier.select(F.col("s_suppkey").alias("person_id")).join(a, "person_id", "left").join(b, "person_id", "left").withColumns({"a": F.coalesce("a", none), "b": F.coalesce("b", none)})
    return j.select("person_id", F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("missing"), F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("merged"))


# text, hashes, JSON


@query("txt01_txt06_normalize", r"SELECT doc_id, translate(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\s+', ' ', 'g'), 'أإآؤئـ', 'اااوي') AS norm FROM documents")
def txt01(t):
    return t.documents.select("doc_id", T.normalize_arabic("text").alias("norm"))


@query("txt14_txt15_url_ids", r"SELECT page_id, cast(nullif(regexp_extract(url, '/[a-z]{2}/(\d+)', 1), '') AS bigint) AS id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
def txt15(t):
    return t.pages.select("page_id", F.nullif(F.regexp_extract("url", r"/[a-z]{2}/(\d+)", 1), F.lit("")).try_cast("long").alias("id"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"))


@query("txt18_ambiguous_names", "SELECT p_name AS name, len(string_split(trim(p_name), ' ')) = 1 AS ambiguous FROM (SELECT DISTINCT p_name FROM part)")
def txt18(t):
    return t.part.select(F.col("p_name").alias("name")).distinct().withColumn("ambiguous", T.is_ambiguous("name"))


@query("txt24_prefixes", "SELECT p_name AS name, coalesce((SELECT string_agg(array_to_string(w[1:i], ' '), '|' ORDER BY i DESC) FROM range(1, len(w)) t(i)), '') AS prefixes FROM (SELECT DISTINCT p_name, string_split(p_name, ' ') AS w FROM part)")
def txt24(t):
    return t.part.select(F.col("p_name").alias("name")).distinct().select("name", F.array_join(T.token_prefixes(F.split("name", " ")), "|").alias("prefixes"))


@query("hsh01_hash_ids", "SELECT s_suppkey, 'NAR_' || upper(left(sha256(s_name), 12)) AS person_id FROM supplier")
def hsh01(t):
    return t.supplier.select("s_suppkey", T.person_hash_id(F.col("s_name")).alias("person_id"))


@query("jsn01_chn14_chains_json", f"WITH {SPLIT}, c AS (SELECT conv_id, chain_id, string_agg(role, ' → ' ORDER BY pos) AS f FROM split GROUP BY conv_id, chain_id) SELECT conv_id, '{{' || string_agg('\"chain_' || cast(chain_id AS varchar) || '\":\"' || f || '\"', ',' ORDER BY chain_id) || '}}' AS chains FROM c GROUP BY conv_id")
def jsn01(t):
    s = chains.split_by_marker(t.turns(), ["conv_id"], "turn", F.col("role") == "assistant")
    c = chains.chain_table(s, ["conv_id", "chain_id"], "role", "chain_pos")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chain_id", "formatted"))).alias("x"))
    return g.select("conv_id", T.chains_json(F.transform("x", lambda x: F.concat(F.lit("chain_"), x["chain_id"].cast("string"))), F.transform("x", lambda x: x["formatted"])).alias("chains"))


@query("jsn02_json_field", "SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k FROM events")
def jsn02(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("arr03_unique_lead_first", f"WITH {SPLIT} SELECT conv_id, string_agg(role, ',' ORDER BY c, p) AS roles FROM (SELECT conv_id, role, min(struct_pack(c := chain_id, p := pos)).c AS c, min(struct_pack(c := chain_id, p := pos)).p AS p FROM split GROUP BY conv_id, role) GROUP BY conv_id")
def arr03(t):
    s = chains.split_by_marker(t.turns(), ["conv_id"], "turn", F.col("role") == "assistant", reverse=False)
    c = s.groupBy("conv_id", "chain_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chain_pos", F.col("role").alias("name")))), lambda x: F.struct(x["name"].alias("name"))).alias("m"))
    g = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chain_id", "m"))), lambda x: x["m"]).alias("chains"))
    return g.select("conv_id", F.array_join(F.transform(T.unique_lead_first(F.col("chains")), lambda x: x["name"]), ",").alias("roles"))


# resolution


@query("res06_jn07_exact_match", "WITH k AS (SELECT p_name AS key, count(DISTINCT p_partkey) AS n, min(p_partkey) AS id FROM part GROUP BY p_name) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN n = 1 THEN id END AS person_id, n > 1 AS ambiguous FROM lineitem JOIN part ON l_partkey = p_partkey JOIN k ON p_name = key")
def res06(t):
    names = t.part.select(F.col("p_name").alias("key"), F.col("p_partkey").alias("person_id"))
    m = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(names.select("key", F.col("person_id").alias("l_partkey")), "l_partkey")
    return resolve.match_exact(m, resolve.exact_lookup(names)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "person_id", "ambiguous")


@query("res08_res12_cascade_totals", f"""WITH {MEMBER}, m AS (SELECT doc_id, pos, person_id % 10 AS k, lag(person_id % 10) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM member),
r AS (SELECT CASE WHEN k = 1 THEN 'cross_ref' WHEN k = 2 AND prev = 3 THEN 'context_mapping' WHEN k IN (4, 5) THEN 'name_mapping' ELSE 'unresolved' END AS resolution FROM m) SELECT resolution, count(*) AS mentions, round(100.0 * count(*) / (SELECT count(*) FROM r), 1) AS percent FROM r GROUP BY resolution""")
def res08(t):
    m = t.members().withColumn("k", F.col("person_id") % 10)
    m = chains.previous_member(m, ["doc_id"], "k", None).select("doc_id", "pos", "k", F.col("previous").alias("prev"))
    table = lambda rows, cols: t.spark.createDataFrame(rows, cols)
    passes = [("cross_ref", table([(1, "a")], "k long, person_id string"), ["k"]), ("context_mapping", table([(2, 3, "b")], "k long, prev long, person_id string"), ["k", "prev"]), ("name_mapping", table([(4, "c"), (5, "d")], "k long, person_id string"), ["k"])]
    return resolve.totals(resolve.cascade(m, passes))


@query("res10_unmapped", "SELECT p_name AS name, count(*) AS frequency FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size < 3) GROUP BY p_name")
def res10(t):
    m = t.lineitem.select("l_partkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name")), "l_partkey")
    return resolve.unmapped(m, t.part.where("p_size < 3").select(F.col("p_name").alias("key")), "name", "name")


@query("res13_overrides", "SELECT s_suppkey, CASE WHEN s_suppkey = 5 THEN 'manual-5' WHEN s_suppkey % 2 = 0 THEN 'rule-' || cast(s_suppkey AS varchar) END AS person_id, CASE WHEN s_suppkey = 5 THEN 'manual' WHEN s_suppkey % 2 = 0 THEN 'name_mapping' END AS resolution, s_suppkey <> 5 AS needs_review FROM supplier")
def res13(t):
    even = F.col("s_suppkey") % 2 == 0
    s = t.supplier.select("s_suppkey", F.when(even, F.concat(F.lit("rule-"), F.col("s_suppkey").cast("string"))).alias("person_id"), F.when(even, F.lit("name_mapping")).alias("resolution"))
    return resolve.with_overrides(s, t.spark.createDataFrame([(5, "manual-5")], "s_suppkey long, manual_id string"), ["s_suppkey"]).select("s_suppkey", "person_id", "resolution", "needs_review")


# coverage


@query("cov01_status_report", "SELECT c_custkey AS user_id, coalesce(s, 'missing') AS status FROM (SELECT c_custkey FROM customer UNION SELECT user_id FROM events) LEFT JOIN (SELECT user_id, arg_max(event_type, ts) AS s FROM events GROUP BY user_id) ON c_custkey = user_id")
def cov01(t):
    status = quality.latest_status(t.log(), "user_id", "status", ["ts", "event_id"])
    expected = t.customer.select(F.col("c_custkey").alias("user_id")).union(t.events.select("user_id")).distinct()
    return quality.status_report(expected, status, "user_id")


@query("cov03_duplicates", f"WITH {PAGE} SELECT idx, count(*) AS n, string_agg(cast(page AS varchar), ',' ORDER BY page) AS places FROM page GROUP BY idx HAVING count(*) > 1")
def cov03(t):
    return quality.duplicates(t.page_numbers(), "idx", "page").withColumn("places", F.array_join("places", ","))


@query("cov04_without_index", r"SELECT page_id FROM pages WHERE regexp_extract(url, '/[a-z]{2}/(\d+)', 1) = ''")
def cov04(t):
    return t.pages.where(F.regexp_extract("url", r"/[a-z]{2}/(\d+)", 1) == "").select("page_id")


@query("cov06_jn16_brackets", f"""WITH {PAGE}, r AS (SELECT page, min(idx) AS lo, max(idx) AS hi FROM page GROUP BY page), m AS (SELECT x AS idx FROM (SELECT unnest(range(1, (SELECT max(idx) FROM page) + 1)) AS x) WHERE x NOT IN (SELECT idx FROM page))
SELECT idx, (SELECT arg_max(page, struct_pack(a := lo, b := page)) FROM r WHERE hi < idx) AS prev_page, (SELECT arg_min(page, struct_pack(a := lo, b := page)) FROM r WHERE lo > idx) AS next_page FROM m""")
def cov06(t):
    ranges = t.page_numbers().groupBy("page").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    return quality.bracket(quality.missing_in_range(t.page_numbers(), "idx", 1), ranges)


@query("cov08_three_way", "SELECT k AS person_id, bool_or(s = 'a') AS in_suppliers, bool_or(s = 'b') AS in_lineitems, bool_or(s = 'c') AS in_customers FROM (SELECT s_suppkey AS k, 'a' AS s FROM supplier UNION ALL SELECT l_suppkey, 'b' FROM lineitem UNION ALL SELECT c_custkey, 'c' FROM customer) GROUP BY k")
def cov08(t):
    return quality.three_way({"suppliers": t.supplier.select(F.col("s_suppkey").alias("person_id")), "lineitems": t.lineitem.select(F.col("l_suppkey").alias("person_id")), "customers": t.customer.select(F.col("c_custkey").alias("person_id"))}, "person_id")


@query("cov09_retryable", "SELECT user_id FROM events GROUP BY user_id HAVING NOT bool_or(event_type = 'purchase') AND NOT bool_or(event_type = 'signup')")
def cov09(t):
    return quality.retryable(t.log(), "user_id", F.col("status") == "purchase", F.col("status") == "signup")


@query("cov11_snk21_integrity", "SELECT 'duplicate_member' AS problem, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'orphan_order', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'dangling_member', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def cov11(t):
    checks = {"duplicate_member": quality.assert_unique(t.lineitem, ["l_orderkey", "l_linenumber"]), "orphan_order": quality.orphans(t.orders, t.lineitem, "o_orderkey", "l_orderkey"), "dangling_member": quality.orphans(t.lineitem, t.orders, "l_orderkey", "o_orderkey")}
    out = None
    for name, df in checks.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.union(one)
    return out


@query("cov12_page_class", "SELECT page_id, CASE WHEN length(trim(html)) < 100 THEN 'empty_html' WHEN contains(lower(html), 'just a moment') OR contains(lower(html), 'cloudflare') THEN 'api_failure' WHEN NOT contains(lower(html), '<article') THEN 'no_hadith_blocks' WHEN NOT contains(lower(html), 'href=') THEN 'no_narrators' ELSE 'success' END AS class FROM pages")
def cov12(t):
    return t.pages.select("page_id", quality.page_class(F.col("html"), person="href=").alias("class"))


@query("htm01_htm03_page_fields", r"SELECT page_id, len(regexp_extract_all(html, '(?is)<a\b[^>]*href=\"[^\"]*\"[^>]*>.*?</a>')) AS n_links, len(regexp_extract_all(html, '(?i)<p\b')) AS n_blocks, regexp_extract(html, '(?is)<html[^>]*lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def htm03(t):
    h = F.col("html")
    return t.pages.select("page_id", F.size(html.links(h)).cast("long").alias("n_links"), F.size(F.regexp_extract_all(h, F.lit(r"(?i)<p\b"), F.lit(0))).cast("long").alias("n_blocks"), F.regexp_extract(h, r'(?is)<html[^>]*lang="([a-z]+)"', 1).alias("lang"))


# upserts


@query("snk01_insert_only", "SELECT s_suppkey AS k, s_name AS v FROM supplier WHERE s_suppkey <= 50 UNION ALL SELECT s_suppkey, 'new' FROM supplier WHERE s_suppkey > 50")
def snk01(t):
    old = t.supplier.where("s_suppkey <= 50").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return sinks.upsert_keep(old, t.supplier.where("s_suppkey >= 40").select(F.col("s_suppkey").alias("k"), F.lit("new").alias("v")), ["k"])


@query("snk02_snk04_overwrite", "SELECT s_suppkey AS k, CASE WHEN s_suppkey < 40 THEN s_name END AS v FROM supplier")
def snk02(t):
    old = t.supplier.where("s_suppkey <= 50").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return sinks.upsert_replace(old, t.supplier.where("s_suppkey >= 40").select(F.col("s_suppkey").alias("k"), F.lit(None).cast("string").alias("v")), ["k"])


@query("snk03_edge_upsert", f"WITH {EDGE} SELECT DISTINCT src, dst FROM edge WHERE src IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND dst IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def snk03(t):
    known = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("node"))
    return sinks.edges_between(t.edges(), known, known, "src", "dst", "node", ["src", "dst"]).select("src", "dst")


@query("snk06_partial_update", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'set' ELSE s_name END AS a, s_nationkey AS b FROM supplier")
def snk06(t):
    old = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("a"), F.col("s_nationkey").alias("b"))
    new = t.supplier.select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("set")).alias("a"), F.lit(None).cast("int").alias("b"))
    return sinks.upsert_fields(old, new, ["k"])


@query("snk07_patch", "SELECT s_suppkey AS k, s_name AS a, CASE WHEN s_suppkey < 10 THEN 'plain' END AS plain FROM supplier")
def snk07(t):
    old = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("a"))
    return sinks.patch(old, t.spark.range(-5, 10).select(F.col("id").alias("k"), F.lit("plain").alias("plain")), "k")


@query("snk14_txt23_script", "SELECT 'MERGE (n:Person {key: ''' || cast(s_suppkey AS varchar) || '''}) SET n.s_name = ''' || replace(s_name, '''', '\\''') || ''';' AS value FROM supplier")
def snk14(t):
    return sinks.node_script(t.supplier.select(F.col("s_suppkey").alias("key"), "s_name"), "Person", ["key"])


@query("snk18_drop_failed_rows", "SELECT event_id FROM events WHERE NOT (user_id < 20 AND event_type = 'error')")
def snk18(t):
    keys = t.events.where("user_id < 20").select("user_id")
    return sinks.drop_failed(t.events, keys, "user_id", F.col("event_type") == "error").select("event_id")


@query("snk19_sim04_backlog", "SELECT count(*) AS todo FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def snk19(t):
    return search.backlog(t.documents.select("doc_id"), t.labels, "doc_id").agg(F.count("*").alias("todo"))


# graph


@query("grf06_document_paths", f"WITH {EDGE}, p AS (SELECT doc_id, string_agg(cast(src AS varchar), ',' ORDER BY pos) || ',' || cast(arg_max(dst, pos) AS varchar) AS nodes, count(*) AS n_edges FROM edge GROUP BY doc_id) SELECT o_orderkey AS doc_id, nodes, n_edges FROM orders LEFT JOIN p ON o_orderkey = doc_id")
def grf06(t):
    p = graph.document_path(t.edges(), "doc_id").select("doc_id", F.array_join("nodes", ",").alias("nodes"), "n_edges")
    return t.orders.select(F.col("o_orderkey").alias("doc_id")).join(p, "doc_id", "left")


@query("grf08_subgraph", f"WITH {EDGE} SELECT 'node' AS kind, person_id AS a, NULL AS b FROM (SELECT DISTINCT person_id FROM member WHERE doc_id = 33) UNION ALL SELECT DISTINCT 'edge', src, dst FROM edge WHERE doc_id = 33")
def grf08(t):
    nodes = t.members().where("doc_id = 33").select(F.lit("node").alias("kind"), F.col("person_id").alias("a"), F.lit(None).cast("long").alias("b")).distinct()
    return nodes.union(t.edges().where("doc_id = 33").select(F.lit("edge"), "src", "dst").distinct())


@query("grf09_snk16_side_by_side", f"WITH {SPLIT} SELECT conv_id, pos, string_agg(cast(chain_id AS varchar) || ':' || role, ' ' ORDER BY chain_id) AS chains FROM split GROUP BY conv_id, pos")
def grf09(t):
    s = chains.split_by_marker(t.turns(), ["conv_id"], "turn", F.col("role") == "assistant").withColumn("pos", F.col("chain_pos"))
    row = graph.side_by_side(s, "conv_id", "chain_id", "pos", "role")
    return row.select("conv_id", "pos", F.array_join(F.transform(F.map_entries("chains"), lambda x: F.concat_ws(":", x["key"].cast("string"), x["value"])), " ").alias("chains"))


@query("grf10_visual_nodes", f"WITH {SPLIT} SELECT 'n_' || cast(conv_id AS varchar) || '_' || cast(chain_id AS varchar) || '_' || cast(pos AS varchar) AS node_id, role AS label, CASE WHEN pos = 0 THEN 'lead' ELSE 'narrator' END AS role, pos AS level, CASE chain_id % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'blue' END AS colour FROM split")
def grf10(t):
    s = chains.split_by_marker(t.turns(), ["conv_id"], "turn", F.col("role") == "assistant").withColumn("pos", F.col("chain_pos"))
    return graph.visual_nodes(s, "conv_id", "chain_id", "pos", "role", ["red", "green", "blue"])


@query("grf11_two_hop_network", f"WITH {PART_EDGE}, one AS (SELECT dst AS n FROM edge WHERE src = 1 UNION SELECT src FROM edge WHERE dst = 1 UNION SELECT 1) SELECT doc_id, pos, src, dst FROM edge WHERE src IN (SELECT n FROM one) OR dst IN (SELECT n FROM one)")
def grf11(t):
    start = t.spark.range(1, 2).toDF("node")
    return graph.hop_edges(materialize(t.edges("part_id"), "edges"), start, 2).select("doc_id", "pos", "src", "dst")


@query("grf12_connected_within_two", f"WITH {PART_EDGE}, u AS (SELECT doc_id, pos, src AS a, dst AS b FROM edge UNION ALL SELECT doc_id, pos, dst, src FROM edge WHERE src <> dst), one AS (SELECT * FROM u WHERE a = 1) SELECT DISTINCT node FROM (SELECT b AS node FROM one UNION ALL SELECT u.b FROM one JOIN u ON one.b = u.a WHERE NOT (one.doc_id = u.doc_id AND one.pos = u.pos))")
def grf12(t):
    e = materialize(t.edges("part_id").withColumn("eid", F.concat_ws("-", "doc_id", "pos")), "edges")
    both = e.select("eid", "src", "dst").union(e.where("src <> dst").select("eid", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.bounded_paths(both, t.spark.range(1, 2).toDF("node"), 2).select(F.col("end").alias("node")).distinct()


@query("grf13_bounded_paths", f"""WITH {PART_EDGE}, s AS (SELECT src AS start, dst AS "end", 1 AS length, cast(src AS varchar) || ',' || cast(dst AS varchar) AS nodes, [cast(doc_id AS varchar) || '-' || cast(pos AS varchar)] AS eids FROM edge WHERE src = 1),
b AS (SELECT start, dst AS "end", 2 AS length, nodes || ',' || cast(dst AS varchar) AS nodes, list_append(eids, cast(doc_id AS varchar) || '-' || cast(pos AS varchar)) AS eids FROM s JOIN edge ON "end" = src WHERE NOT list_contains(eids, cast(doc_id AS varchar) || '-' || cast(pos AS varchar))),
c AS (SELECT start, dst AS "end", 3 AS length, nodes || ',' || cast(dst AS varchar) AS nodes FROM b JOIN edge ON "end" = src WHERE NOT list_contains(eids, cast(doc_id AS varchar) || '-' || cast(pos AS varchar)))
SELECT p.start, p."end", p.length, p.nodes FROM (SELECT start, "end", length, nodes FROM s UNION ALL SELECT start, "end", length, nodes FROM b UNION ALL SELECT * FROM c) p JOIN part ON p."end" = p_partkey WHERE contains(p_name, 'ring')""")
def grf13(t):
    """Trails of one to three edges from one node to the nodes whose name has a pattern."""
    e = materialize(t.edges("part_id").withColumn("eid", F.concat_ws("-", "doc_id", "pos")), "edges")
    named = t.part.where(search.contains("p_name", "ring")).select(F.col("p_partkey").alias("end"))
    p = graph.bounded_paths(e, t.spark.range(1, 2).toDF("node"), 3).join(named, "end", "left_semi")
    return p.select("start", "end", "length", F.array_join("nodes", ",").alias("nodes"))


@query("grf13_paths_between_names", f"""WITH RECURSIVE {PART_EDGE}, live AS (SELECT doc_id * 1000 + pos AS eid, src, dst FROM edge JOIN orders ON doc_id = o_orderkey WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')),
walk AS (SELECT p_partkey AS start, p_partkey AS last, 0 AS length, cast(p_partkey AS varchar) AS nodes, cast([] AS bigint[]) AS eids FROM part WHERE contains(p_name, 'old anvil')
  UNION ALL SELECT start, dst, length + 1, nodes || ',' || cast(dst AS varchar), list_append(eids, eid) FROM walk JOIN live ON last = src WHERE length < 8 AND NOT list_contains(eids, eid))
SELECT start, last AS "end", length, nodes, array_to_string(list_transform(eids, lambda x: cast(x AS varchar)), ',') AS eids FROM walk JOIN part ON last = p_partkey WHERE contains(p_name, 'hot ring') AND length > 0""")
def grf13_names(t):
    """Paths of up to 8 edges between two name patterns, all edges of finished orders of the two highest priorities."""
    docs = t.orders.where("o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')").select(F.col("o_orderkey").alias("doc_id"))
    e = t.edges("part_id").join(docs, "doc_id", "left_semi").select((F.col("doc_id") * 1000 + F.col("pos")).alias("eid"), "src", "dst")
    named = lambda x: t.part.where(search.contains("p_name", x)).select(F.col("p_partkey").alias("node"))
    p = graph.paths_between(e, named("old anvil"), named("hot ring"), 8)
    return p.select("start", "end", "length", F.array_join("nodes", ",").alias("nodes"), F.array_join("eids", ",").alias("eids"))


@query("grf14_bios", f"WITH {MEMBER} SELECT doc_id, pos, s_name, s_acctbal FROM member JOIN supplier ON person_id = s_suppkey")
def grf14(t):
    s = t.supplier.select(F.col("s_suppkey").alias("person_id"), "s_name", "s_acctbal")
    return t.members().join(s, "person_id").select("doc_id", "pos", "s_name", "s_acctbal")


@query("grf15_person_search", "SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE contains(s_name, '00001') AND s_nationkey IS NOT NULL")
def grf15(t):
    return t.supplier.where(search.contains("s_name", "00001") & F.col("s_nationkey").isNotNull()).select("s_suppkey", "s_name", "s_nationkey")


@query("grf16_frequent_by_name", "SELECT p_name AS name, count(*) AS links, count(DISTINCT l_orderkey) AS docs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name ORDER BY links DESC, name LIMIT 20")
def grf16(t):
    j = t.lineitem.select("l_orderkey", "l_partkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name")), "l_partkey")
    return graph.frequent(j, "name", "l_orderkey", 20)


@query("grf17_books_with_counts", f"WITH {BOOK} SELECT book, chapter, count(*) AS docs, round(avg(total), 2) AS mean FROM books GROUP BY book, chapter")
def grf17(t):
    return t.books().groupBy("book", "chapter").agg(F.count("*").alias("docs"), F.round(F.avg("total"), 2).alias("mean"))


@query("grf18_collectors_terminators", f"WITH {MEMBER}, l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS n FROM member) SELECT person_id, count(*) FILTER (pos = 0) AS collects, count(*) FILTER (n = 1) AS ends FROM l GROUP BY person_id")
def grf18(t):
    m = t.members()
    last = chains.terminal_members(m, ["doc_id"]).groupBy("person_id").agg(F.count("*").alias("ends"))
    first = m.groupBy("person_id").agg(F.count_if(F.col("pos") == 0).alias("collects"))
    return first.join(last, "person_id", "left").select("person_id", "collects", F.coalesce("ends", F.lit(0)).alias("ends"))


@query("grf19_grade_distribution", f"WITH {BOOK} SELECT grade, count(*) AS docs FROM books WHERE grade IS NOT NULL GROUP BY grade")
def grf19(t):
    return t.books().where("grade IS NOT NULL").groupBy("grade").agg(F.count("*").alias("docs"))


@query("grf23_degree_centrality", f"WITH {EDGE}, o AS (SELECT src AS n, count(*) AS c FROM edge GROUP BY src), i AS (SELECT dst AS n, count(*) AS c FROM edge GROUP BY dst) SELECT s_suppkey AS node, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) + coalesce(o.c, 0) AS degree FROM supplier LEFT JOIN i ON s_suppkey = i.n LEFT JOIN o ON s_suppkey = o.n")
def grf23(t):
    return graph.degrees(t.edges(), t.supplier.select(F.col("s_suppkey").alias("node")))


@query("grf25_search_with_connections", f"WITH {EDGE}, d AS (SELECT n, count(*) AS k FROM (SELECT src AS n FROM edge UNION ALL SELECT dst FROM edge WHERE src <> dst UNION ALL SELECT dst FROM edge) GROUP BY n) SELECT s_name AS name, coalesce(k, 0) AS connections FROM supplier LEFT JOIN d ON s_suppkey = n WHERE contains(s_name, '3')")
def grf25(t):
    e = t.edges()
    ends = e.select(F.col("src").alias("n")).union(e.where("src <> dst").select("dst")).union(e.select("dst"))
    d = ends.groupBy("n").agg(F.count("*").alias("k"))
    return t.supplier.where(search.contains("s_name", "3")).join(d, F.col("s_suppkey") == F.col("n"), "left").select(F.col("s_name").alias("name"), F.coalesce("k", F.lit(0)).alias("connections"))


@query("grf27_samples_per_person", f"WITH {MEMBER}, d AS (SELECT DISTINCT person_id, doc_id FROM member), r AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY doc_id) AS n FROM d) SELECT s_suppkey AS person_id, coalesce(string_agg(cast(doc_id AS varchar), ',' ORDER BY doc_id), '') AS sample FROM supplier LEFT JOIN r ON s_suppkey = person_id AND n <= 10 GROUP BY s_suppkey")
def grf27(t):
    d = t.members().select("person_id", "doc_id").distinct()
    r = d.withColumn("n", F.row_number().over(Window.partitionBy("person_id").orderBy("doc_id"))).where("n <= 10")
    g = r.groupBy("person_id").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("sample"))
    return t.supplier.select(F.col("s_suppkey").alias("person_id")).join(g, "person_id", "left").select("person_id", F.coalesce("sample", F.lit("")).alias("sample"))


@query("grf29_two_roles", f"WITH {MEMBER} SELECT person_id, count(DISTINCT doc_id) FILTER (pos = 0) AS as_first, count(DISTINCT doc_id) FILTER (pos > 0) AS as_later FROM member GROUP BY person_id HAVING count(*) FILTER (pos = 0) > 0 AND count(*) FILTER (pos > 0) > 0")
def grf29(t):
    g = t.members().groupBy("person_id").agg(F.count_distinct(F.when(F.col("pos") == 0, F.col("doc_id"))).alias("as_first"), F.count_distinct(F.when(F.col("pos") > 0, F.col("doc_id"))).alias("as_later"))
    return g.where("as_first > 0 AND as_later > 0")


@query("crw01_discovery", f"WITH RECURSIVE {PART_EDGE}, link AS (SELECT DISTINCT src, dst FROM edge), w AS (SELECT cast(1 AS bigint) AS id UNION SELECT dst FROM w JOIN link ON src = id) SELECT id FROM w")
def crw01(t):
    """All that is reached from one seed; the tests hold rounds and origins."""
    links = t.edges("part_id").select("src", "dst").distinct()
    return graph.crawl(links, t.spark.range(1, 2)).select("id")


# search and similarity


@query("srch02_bm25", r"""WITH t AS (SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS n, len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x = 'license')) AS a, len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x = 'apache')) AS b FROM documents),
s AS (SELECT count(*) AS d, avg(n) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM t)
SELECT doc_id AS id, round(CASE WHEN a > 0 THEN ln(1 + (d - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) ELSE 0 END + CASE WHEN b > 0 THEN ln(1 + (d - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)) ELSE 0 END, 6) AS score,
  cast((a > 0)::int + (b > 0)::int AS bigint) AS matched FROM t, s WHERE a > 0 OR b > 0""")
def srch02(t):
    return search.bm25(t.documents, "Apache License", "doc_id", ["text"]).select("id", F.round("score", 6).alias("score"), "matched")


@query("sim01_cosine_top_k", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 1) SELECT vec_id, round(list_cosine_similarity(cast(embedding AS double[]), cast(e AS double[])), 6) AS score FROM embeddings, q WHERE vec_id <> 1 AND list_cosine_similarity(cast(embedding AS double[]), cast(e AS double[])) >= 0.1 ORDER BY score DESC, vec_id LIMIT 10")
def sim01(t):
    return search.similar_to(t.embeddings, 1, "vec_id", "embedding", 10, 0.1)


@query("sim03_combined_graph", f"WITH {EDGE} SELECT DISTINCT src, dst FROM edge WHERE doc_id IN (3, 5, 7, 8)")
def sim03(t):
    return t.edges().where(F.col("doc_id").isin(3, 5, 7, 8)).select("src", "dst").distinct()


# the rest of the inventory


def _conversation_docs(t):
    member = F.struct("turn", F.struct(F.col("role").alias("name"), F.when(F.col("role") == "assistant", F.lit("lead")).otherwise(F.lit("narrator")).alias("role")).alias("m"))
    g = t.turns().groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(member)), lambda x: x["m"]).alias("members"))
    return g.select(F.lit("conv").alias("source"), F.col("conv_id").alias("doc_index"), F.lit(None).cast("string").alias("text"), "members")


@query("chn05_ingest_edges", f"WITH {SPLIT}, e AS (SELECT conv_id AS doc_index, chain_id, pos + 1 AS pos, role AS src, lead(role) OVER (PARTITION BY conv_id, chain_id ORDER BY pos) AS dst FROM split) SELECT 'conv' AS source, doc_index, chain_id, pos, src, dst FROM e WHERE dst IS NOT NULL")
def chn05(t):
    return chains.ingest(_conversation_docs(t))["edges"]


@query("chn06_positions", f"WITH {SPLIT} SELECT 'conv' AS source, conv_id AS doc_index, chain_id, pos, role AS norm FROM split")
def chn06(t):
    return chains.ingest(_conversation_docs(t))["members"]


@query("chn05_snk17_persons", f"WITH {SPLIT}, f AS (SELECT role, count(*) OVER (PARTITION BY role) AS c FROM split) SELECT DISTINCT 'conv' AS source, role AS norm, role AS name, c AS occurrence_count FROM f")
def chn05_persons(t):
    return chains.ingest(_conversation_docs(t))["persons"]


@query("chn11_person_dimension", "SELECT cast(s_suppkey AS varchar) AS person_id, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN 'v' || cast(s_suppkey AS varchar) ELSE 'narrator_' || cast(s_suppkey AS varchar) END AS name FROM supplier")
def chn11(t):
    ids = t.supplier.select(F.col("s_suppkey").cast("string").alias("person_id"), "s_name", (F.col("s_suppkey") % 3).alias("k"))
    bios, variants = ids.where("k = 0").select("person_id", F.col("s_name").alias("name")), ids.where("k = 1").select("person_id", F.array(F.concat(F.lit("v"), "person_id")).alias("names"))
    return chains.person_dimension(ids.select("person_id"), bios, variants).select("person_id", "name")


@query("chn20_typed_edges", f"WITH {SPLIT} SELECT conv_id, chain_id, role AS first_member, CASE WHEN chain_id = 1 THEN 'primary' ELSE 'follow_up' END AS chain_type FROM split WHERE pos = 0")
def chn20(t):
    s = chains.split_by_marker(t.turns(), ["conv_id"], "turn", F.col("role") == "assistant").where("chain_pos = 0")
    return s.select("conv_id", "chain_id", F.col("role").alias("first_member"), F.when(F.col("chain_id") == 1, F.lit("primary")).otherwise(F.lit("follow_up")).alias("chain_type"))


@query("chn21_chn23_validation", f"WITH {SPLIT}, c AS (SELECT conv_id, chain_id, min(role) FILTER (pos = 0) AS last FROM split GROUP BY conv_id, chain_id), b AS (SELECT conv_id, bool_and(last = 'assistant') AS ok FROM c GROUP BY conv_id) SELECT conv_id, ok, CASE WHEN ok THEN 'ok' ELSE 'last is no lead' END AS reason FROM b")
def chn23(t):
    s = chains.split_by_marker(t.turns(), ["conv_id"], "turn", F.col("role") == "assistant", reverse=False)
    person = F.struct("chain_pos", F.struct(F.col("role").alias("name"), F.when(F.col("role") == "assistant", F.lit("lead")).otherwise(F.lit("narrator")).alias("role")).alias("n"))
    c = s.groupBy("conv_id", "chain_id").agg(F.transform(F.array_sort(F.collect_list(person)), lambda x: x["n"]).alias("narrators"))
    c = c.select("conv_id", F.struct(F.concat(F.lit("chain_"), F.col("chain_id").cast("string")).alias("chain_id"), F.lit("primary").alias("type"), "narrators").alias("c"))
    return chains.validate(c.groupBy("conv_id").agg(F.collect_list("c").alias("chains"))).select("conv_id", "ok", "reason")


@query("jn08_context_key", f"WITH {MEMBER}, m AS (SELECT doc_id, pos, person_id, lag(person_id) OVER (PARTITION BY doc_id ORDER BY pos) AS previous FROM member), r AS (SELECT person_id, previous FROM m WHERE previous IS NOT NULL GROUP BY person_id, previous HAVING count(*) >= 5) SELECT m.doc_id, m.pos FROM m JOIN r ON m.person_id = r.person_id AND m.previous = r.previous")
def jn08(t):
    m = chains.previous_member(t.members(), ["doc_id"], "person_id", None).select("doc_id", "pos", "person_id", "previous")
    return m.join(m.where("previous IS NOT NULL").groupBy("person_id", "previous").agg(F.count("*").alias("n")).where("n >= 5"), ["person_id", "previous"]).select("doc_id", "pos")


@query("jn09_first_mapping_wins", "WITH f AS (SELECT n_regionkey AS k, arg_min(n_name, n_nationkey) AS v FROM nation GROUP BY n_regionkey) SELECT r_regionkey, v AS name FROM region LEFT JOIN f ON r_regionkey = k")
def jn09(t):
    first = chains.first_occurrence(t.nation, ["n_regionkey"], ["n_nationkey"]).select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("name"))
    return t.region.join(first, F.col("r_regionkey") == F.col("k"), "left").select("r_regionkey", "name")


@query("res02_resolution_type", "WITH u AS (SELECT p_name FROM part GROUP BY p_name HAVING count(*) = 1) SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM u) THEN 'unambiguous' WHEN p_size < 10 THEN 'context' WHEN p_size < 20 THEN 'pronoun' ELSE 'remaining' END AS type FROM part")
def res02(t):
    return resolve.resolution_type(t.part, "p_name", [("context", F.col("p_size") < 10), ("pronoun", F.col("p_size") < 20)]).select("p_partkey", "type")


@query("res04_four_steps", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'context' WHEN p_size % 3 = 0 THEN 'rule' WHEN p_size % 5 = 0 THEN 'static' ELSE 'identity' END AS method, CASE WHEN p_size % 4 = 0 THEN 'c' WHEN p_size % 3 = 0 THEN 'r' WHEN p_size % 5 = 0 THEN 's' ELSE p_name END AS resolved, 'NAR_' || upper(left(sha256(CASE WHEN p_size % 4 = 0 THEN 'c' WHEN p_size % 3 = 0 THEN 'r' WHEN p_size % 5 = 0 THEN 's' ELSE p_name END), 12)) AS person_id FROM part")
def res04(t):
    p = t.part.select("p_partkey", "p_name", F.col("p_size").cast("long").alias("size"))
    sizes = t.part.select(F.col("p_size").cast("long").alias("size")).distinct()
    rule = lambda k, v: sizes.where(F.col("size") % k == 0).select("size", F.lit(v).alias("person_id"))
    r = resolve.cascade(p, [("context", rule(4, "c"), ["size"]), ("rule", rule(3, "r"), ["size"]), ("static", rule(5, "s"), ["size"])])
    r = r.select("p_partkey", F.coalesce("resolution", F.lit("identity")).alias("method"), F.coalesce("person_id", "p_name").alias("resolved"))
    return r.withColumn("person_id", T.person_hash_id(F.col("resolved")))


@query("grf03_grf07_ordered_edges", f"WITH {EDGE} SELECT doc_id, string_agg(cast(src AS varchar) || '>' || cast(dst AS varchar), ' ' ORDER BY pos) AS links FROM edge GROUP BY doc_id")
def grf07(t):
    g = t.edges().groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "src", "dst"))).alias("x"))
    return g.select("doc_id", F.array_join(F.transform("x", lambda e: F.concat_ws(">", e["src"].cast("string"), e["dst"].cast("string"))), " ").alias("links"))


@query("grf05_suffix_paths", f"WITH {EDGE} SELECT a.doc_id, a.pos, a.src AS start, b.dst AS last, b.pos - a.pos + 1 AS length FROM edge a JOIN edge b ON a.doc_id = b.doc_id AND a.pos <= b.pos AND b.pos = (SELECT max(pos) FROM edge c WHERE c.doc_id = a.doc_id)")
def grf05(t):
    e = t.edges()
    last = e.groupBy("doc_id").agg(F.max("pos").alias("end"), F.max_by("dst", "pos").alias("last"))
    return e.join(last, "doc_id").select("doc_id", "pos", F.col("src").alias("start"), "last", (F.col("end") - F.col("pos") + 1).alias("length"))


@query("grf28_top_leads", f"WITH {MEMBER} SELECT s_name AS lead, count(DISTINCT doc_id) AS docs FROM member JOIN supplier ON person_id = s_suppkey WHERE pos = 0 GROUP BY s_name ORDER BY docs DESC, lead LIMIT 15")
def grf28(t):
    m = t.members().where("pos = 0").join(t.supplier.select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("lead")), "person_id")
    return m.groupBy("lead").agg(F.count_distinct("doc_id").alias("docs")).orderBy(F.col("docs").desc(), "lead").limit(15)


@query("htm02_breadcrumbs", r"SELECT page_id, regexp_extract(html, '(?s)<nav>.*?<a href=\"([^\"]*)\"', 1) AS first_href FROM pages")
def htm02(t):
    return t.pages.select("page_id", F.coalesce(F.try_element_at(html.breadcrumbs(F.col("html")), F.lit(1))["href"], F.lit("")).alias("first_href"))


@query("crw02_discovered_ids", f"WITH {PAGE} SELECT DISTINCT idx AS id FROM page")
def crw02(t):
    return t.pages.select(F.explode(F.regexp_extract_all("url", F.lit(r"/[a-z]{2}/(\d+)"), F.lit(1))).alias("i")).select(F.col("i").cast("long").alias("id")).distinct()


@query("sim02_enriched_neighbours", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 3) SELECT vec_id, label, round(list_cosine_similarity(cast(embedding AS double[]), cast(e AS double[])), 6) AS score FROM embeddings, q WHERE vec_id <> 3 AND list_cosine_similarity(cast(embedding AS double[]), cast(e AS double[])) >= 0.05 ORDER BY score DESC, vec_id LIMIT 5")
def sim02(t):
    near = search.similar_to(t.embeddings, 3, "vec_id", "embedding", 5, 0.05)
    return near.join(t.embeddings.select("vec_id", "label"), "vec_id").select("vec_id", "label", "score")


@query("snk05_edge_ids", f"WITH {EDGE} SELECT doc_id, pos, left(sha256(cast(src AS varchar) || '|' || cast(dst AS varchar) || '|' || cast(doc_id AS varchar) || '|' || cast(pos AS varchar)), 16) AS edge_id FROM edge")
def snk05(t):
    return t.edges().select("doc_id", "pos", sinks.edge_id("src", "dst", "doc_id", "pos").alias("edge_id"))


@query("snk08_delete_by_source", "SELECT doc_id FROM documents WHERE source IS DISTINCT FROM 'src3'")
def snk08(t):
    return sinks.delete_source(t.documents, "src3").select("doc_id")


@query("snk12_snk13_graph_round_trip", f"WITH {EDGE} SELECT doc_id, pos, src, dst FROM edge")
def snk12(t):
    import uuid

    from ..operators.state import shared_folder

    path = f"{shared_folder(t.spark)}/graph-{uuid.uuid4().hex}"
    sinks.write_graph({"edges": t.edges()}, path)
    return sinks.read_graph(t.spark, path)["edges"]
