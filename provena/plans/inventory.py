"""More named queries: text functions, readers, writers, page documents and name resolution over whole tables.

Latin words of the tables are turned into Arabic letters, marks and digits by one fixed translation, the same in Spark and in
SQL. Readers are asked over files that the query itself has written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chains, graph, html, quality, resolve
from ..operators.state import read_state, scratch, write_state
from ..sources import readers, sinks
from ..streaming import status
from .adapter import MEMBER, SPLIT
from .catalog import query

#: Letter by letter: carriers of hamza, marks of all classes, punctuation and digits among common Latin letters.
_PAIRS = dict(zip("aeiouyhtnsdrlmgwkbpc.,-0123456789", "أإآؤئىةونَـٰلمۖۤkٕٖص.،–٠١٢٣٤٥٦٧٨٩"))
_FROM, _TO = "".join(_PAIRS), "".join(_PAIRS.values())
WIDE = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06DC}\x{06DF}-\x{06E4}\x{06E7}\x{06E8}\x{06EA}-\x{06ED}]"
NARROW = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}]"


def _arabic(c):
    return F.translate(c, _FROM, _TO)


def _sql_arabic(c: str) -> str:
    return f"translate({c}, '{_FROM}', '{_TO}')"


def _digits(c):
    return F.translate(c.cast("string"), "0123456789", T.ARABIC_DIGITS)


def _sql_digits(c: str) -> str:
    return f"translate(cast({c} AS varchar), '0123456789', '{T.ARABIC_DIGITS}')"


def _collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _path(t, what: str) -> str:
    return scratch(t.spark, what)


# text functions


@query("txt02_txt03_txt04_marks", rf"""WITH a AS (SELECT doc_id, {_sql_arabic("coalesce(text, '')")} AS x FROM documents),
n AS (SELECT doc_id, x, translate({_collapse("x")}, 'أإآؤئـ', 'اااوي') AS y FROM a)
SELECT doc_id, md5(regexp_replace(y, '[\x{{064B}}-\x{{0655}}]', '', 'g')) AS search, md5(regexp_replace(x, '{WIDE}', '', 'g')) AS wide, md5(regexp_replace(x, '{NARROW}', '', 'g')) AS narrow FROM n""")
def txt02(t):
    x = _arabic(F.coalesce("text", F.lit("")))
    return t.documents.select("doc_id", F.md5(T.normalize_for_search(x)).alias("search"), F.md5(T.strip_marks(x)).alias("wide"), F.md5(T.strip_marks(x, wide=False)).alias("narrow"))


@query("txt05_name_keys", rf"""WITH a AS (SELECT p_partkey, 'w ' || p_name || ' (' || p_brand || ') «' || p_type || '»' AS raw FROM part), b AS (SELECT p_partkey, raw, {_sql_arabic("raw")} AS x FROM a),
c AS (SELECT p_partkey, raw, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '{WIDE}', '', 'g'), '\p{{Mn}}', '', 'g'), '\(.*?\)', '', 'g'), '[.,،؛;:؟?!"''«»\-_/\\]', '', 'g') AS y FROM b)
SELECT p_partkey, {_collapse(r"regexp_replace(translate(y, 'أإآئؤةى', 'ااايوهي'), '^و\s*', '')")} AS key FROM c""")
def txt05(t):
    raw = F.concat(F.lit("w "), "p_name", F.lit(" ("), "p_brand", F.lit(") «"), "p_type", F.lit("»"))
    return t.part.select("p_partkey", T.normalize_name(_arabic(raw)).alias("key"))


@query("txt07_clean_person_names", rf"SELECT p_partkey, {_collapse('p_name')} AS name FROM part")
def txt07(t):
    """Names between a transmission word and an honorific give the name back."""
    k = F.col("p_partkey") % 4
    opened = F.when(k == 0, F.concat(F.lit("  حدثنا  "), "p_name")).when(k == 1, F.concat(F.lit("أخبرني عن "), "p_name")).when(k == 2, F.concat(F.lit("قال "), "p_name")).otherwise(F.col("p_name"))
    closed = F.when(F.col("p_size") % 3 == 0, F.concat(opened, F.lit("  رضي الله عنه بعد"))).when(F.col("p_size") % 3 == 1, F.concat(opened, F.lit(" عليه السلام"))).otherwise(opened)
    return t.part.select("p_partkey", T.clean_person_name(closed).alias("name"))


@query("txt08_txt09_edges_of_names", r"SELECT s_suppkey, rtrim(trim(' ' || s_name || ',،: ,'), '،:,') AS tail, ltrim(': :' || s_name || ': ', ': ') AS head FROM supplier")
def txt08(t):
    return t.supplier.select("s_suppkey", T.trim_name_tail(F.concat(F.lit(" "), "s_name", F.lit(",،: ,"))).alias("tail"), T.strip_leading(F.concat(F.lit(": :"), "s_name", F.lit(": "))).alias("head"))


@query("txt10_txt11_txt12_numbers", """SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_partkey END AS number, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS arabic, p_name AS rest FROM part""")
def txt10(t):
    k = F.col("p_partkey") % 3
    head = F.when(k == 0, F.concat(_digits(F.col("p_partkey")), F.lit(" – "))).when(k == 1, F.concat(F.col("p_partkey").cast("string"), F.lit(" - "))).otherwise(F.lit(" "))
    x = F.concat(head, "p_name")
    return t.part.select("p_partkey", T.extract_number(x).cast("long").alias("number"), T.arabic_index(x).cast("long").alias("arabic"), T.strip_number(x).alias("rest"))


@query("txt13_all_indices", f"""WITH x AS (SELECT p_partkey, {_sql_digits("p_partkey + 1")} || ' - ' || p_name || ' ' || {_sql_digits("p_size")} || ' (' || p_type || ') –' || CASE WHEN p_size % 2 = 0 THEN ' 99999-' ELSE ' none' END AS s FROM part),
i AS (SELECT p_partkey, list_filter(list_transform(regexp_extract_all(s, '([0-9{T.ARABIC_DIGITS}]+)\\s*(?:\\([^)]*\\)\\s*)?[-–—]', 1), lambda d: cast(translate(d, '{T.ARABIC_DIGITS}', '0123456789') AS integer)), lambda v: v BETWEEN 1 AND 7563) AS v FROM x)
SELECT p_partkey, array_to_string(CASE WHEN len(v) = 0 THEN [-1] ELSE v END, ',') AS indices FROM i""")
def txt13(t):
    s = F.concat(_digits(F.col("p_partkey") + 1), F.lit(" - "), "p_name", F.lit(" "), _digits(F.col("p_size")), F.lit(" ("), "p_type", F.lit(") –"), F.when(F.col("p_size") % 2 == 0, F.lit(" 99999-")).otherwise(F.lit(" none")))
    return t.part.select("p_partkey", F.array_join(T.all_indices(s, F.lit(-1), most=7563), ",").alias("indices"))


@query("txt17_arabic_heavy", rf"SELECT doc_id, length(regexp_replace({_sql_arabic('text')}, '[^\x{{0600}}-\x{{06FF}}]', '', 'g')) > 20 AS heavy FROM documents WHERE text IS NOT NULL")
def txt17(t):
    return t.documents.where("text IS NOT NULL").select("doc_id", T.is_arabic_heavy(_arabic(F.col("text"))).alias("heavy"))


@query("txt19_clean_keys", rf"SELECT p_partkey, trim({_collapse('p_type')} || CASE WHEN p_size % 2 = 0 THEN ' ' || p_brand ELSE '' END) AS key FROM part")
def txt19(t):
    x = F.concat("p_type", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("  "), "p_brand")).otherwise(F.lit("")), F.when(F.col("p_size") % 3 == 0, F.lit("：")).when(F.col("p_size") % 3 == 1, F.lit(":")).otherwise(F.lit("")))
    return t.part.select("p_partkey", T.clean_key(x).alias("key"))


@query("txt21_absolute_urls", r"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://host.example' || regexp_extract(url, '^https?://[^/]+(/.*)$', 1) ELSE url END AS url FROM pages")
def txt21(t):
    u = F.when(F.col("page_id") % 2 == 0, F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1)).otherwise(F.col("url"))
    return t.pages.select("page_id", F.when(u == "", F.lit("https://host.example")).otherwise(T.absolute_url(u, "https://host.example/")).alias("url"))


@query("txt22_formatted_names", f"WITH {MEMBER} SELECT doc_id, string_agg(s_name, ' ← ' ORDER BY pos) AS formatted FROM member JOIN supplier ON person_id = s_suppkey GROUP BY doc_id")
def txt22(t):
    m = t.members().join(t.supplier.select(F.col("s_suppkey").alias("person_id"), "s_name"), "person_id")
    g = m.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "s_name"))).alias("x"))
    return g.select("doc_id", T.format_chain(F.transform("x", lambda x: x["s_name"]), " ← ").alias("formatted"))


@query("hsh02_prefixed_ids", "SELECT doc_id, 'HAD_' || source || '_' || cast(doc_id AS varchar) AS id FROM documents WHERE source IS NOT NULL")
def hsh02(t):
    return t.documents.where("source IS NOT NULL").select("doc_id", T.prefixed_id("HAD", F.col("source"), F.col("doc_id").cast("string")).alias("id"))


@query("jsn03_hrefs_of_json", r"""SELECT page_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"[^>]*>.*?</a>', 1))), '|'), '') AS hrefs FROM pages WHERE html IS NOT NULL""")
def jsn03(t):
    nested = F.to_json(F.struct(F.array(F.struct(html.links(F.col("html")).alias("links"))).alias("body")))
    return t.pages.where("html IS NOT NULL").select("page_id", F.array_join(F.array_sort(T.hrefs(nested)), "|").alias("hrefs"))


@query("arr01_nested_places", f"WITH {SPLIT} SELECT conv_id, chain_id - 1 AS chain_at, pos AS at, role FROM split")
def arr01(t):
    """Chains nested in documents, unnested again with both places."""
    s = chains.split_by_marker(t.turns(), ["conv_id"], "turn", F.col("role") == "assistant")
    c = s.groupBy("conv_id", "chain_id").agg(F.array_sort(F.collect_list(F.struct("chain_pos", "role"))).alias("m"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chain_id", "m"))).alias("x"))
    one = g.select("conv_id", F.posexplode("x").alias("chain_at", "c"))
    two = one.select("conv_id", "chain_at", F.posexplode("c.m").alias("at", "m"))
    return two.select("conv_id", F.col("chain_at").cast("long").alias("chain_at"), F.col("at").cast("long").alias("at"), "m.role")


@query("arr02_breadcrumb_places", r"""WITH n AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav\b[^>]*>(.*?)</nav>', 1), '<a\b[^>]*href="([^"]*)"[^>]*>', 1) AS h FROM pages WHERE html IS NOT NULL)
SELECT page_id, h[2] AS book, h[3] AS chapter, h[50] AS none FROM n""")
def arr02(t):
    links = html.breadcrumbs(F.col("html"))
    return t.pages.where("html IS NOT NULL").select("page_id", *[T.breadcrumb(links, k)["href"].alias(c) for k, c in ((1, "book"), (2, "chapter"), (49, "none"))])


@query("arr04_arr05_filled_lines", r"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(x) AS n_lines, len(list_filter(x, lambda v: v <> '')) AS n_filled, md5(array_to_string(list_filter(x, lambda v: v <> ''), '|')) AS filled FROM l")
def arr04(t):
    lines = F.split("text", "\n")
    return t.documents.where("text IS NOT NULL").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(T.drop_empty(lines)).cast("long").alias("n_filled"), F.md5(F.array_join(T.drop_empty(lines), "|")).alias("filled"))


@query("dat01_iso_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def dat01(t):
    return t.events.select("event_id", T.iso_utc(F.col("ts").cast("timestamp")).alias("at"))


@query("prj03_flattened_struct", "SELECT o_orderkey, o_orderstatus AS status, c_name AS name, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey")
def prj03(t):
    c = t.customer.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("who"))
    nested = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), "who").alias("o"))
    return nested.select("o_orderkey", "o.status", "o.who.*")


# order and sets


@query("srt07_first_by_key", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 5")
def srt07(t):
    """A limit without an order is given one, by key."""
    return t.supplier.select("s_suppkey", "s_name").orderBy("s_suppkey").limit(5)


@query("set05_distinct_rows", "SELECT DISTINCT p_brand, p_type FROM part")
def set05(t):
    return t.part.select("p_brand", "p_type").distinct()


# chains and page documents


@query("win04_dropped_tails", "WITH m AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS last FROM conversations GROUP BY conv_id) SELECT conv_id, count(*) AS kept FROM conversations JOIN m USING (conv_id) WHERE last IS NULL OR turn <= last GROUP BY conv_id")
def win04(t):
    s = chains.split_by_marker(t.turns(), ["conv_id"], "turn", F.col("role") == "assistant", reverse=False)
    return s.groupBy("conv_id").agg(F.count("*").alias("kept"))


@query("chn02_chains_with_unnamed", f"WITH {SPLIT} SELECT conv_id, chain_id, count(*) AS length, count(nullif(role, 'user')) AS n_named FROM split GROUP BY conv_id, chain_id")
def chn02(t):
    """Members without a name keep their places."""
    s = chains.split_by_marker(t.turns(), ["conv_id"], "turn", F.col("role") == "assistant").withColumn("name", F.nullif("role", F.lit("user")))
    return chains.chain_table(s, ["conv_id", "chain_id"], "name", "chain_pos").select("conv_id", "chain_id", "length", "n_named")


def _page_log(t):
    """Pages as a log of fetched pages: success where there is an article."""
    h = F.col("html")
    body = F.try_element_at(html.elements(h, "article"), F.lit(1))
    links = F.transform(html.breadcrumbs(h), lambda x: F.struct(F.concat(F.lit("/book/1/"), F.length(x["href"]).cast("string")).alias("href"), x["href"].alias("text")))
    return t.pages.where("html IS NOT NULL").select(
        F.col("page_id").alias("page_number"), F.lit(1).alias("book_id"), F.when(body.isNotNull(), F.lit("success")).otherwise(F.lit("failed")).alias("status"),
        links.alias("breadcrumb_links"), html.text_blocks(F.coalesce(body, F.lit(""))).alias("hadith_blocks"),
    )


@query("chn09_page_blocks", r"""WITH n AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav\b[^>]*>(.*?)</nav>', 1), '<a\b[^>]*href="([^"]*)"[^>]*>.*?</a>', 1) AS h, regexp_extract_all(regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1), '(?is)<p\b[^>]*>(.*?)</p>', 1) AS b FROM pages WHERE html IS NOT NULL)
SELECT '1_' || cast(page_id AS varchar) AS doc_id, unnest(range(0, len(b))) AS block_no, length(h[2]) AS book_section_id, h[2] AS book_name, length(h[3]) AS chapter_section_id, h[3] AS chapter_name FROM n""")
def chn09(t):
    return chains.parse_pages(_page_log(t)).select("doc_id", F.col("block_no").cast("long").alias("block_no"), F.col("book_section_id").cast("long").alias("book_section_id"), "book_name", F.col("chapter_section_id").cast("long").alias("chapter_section_id"), "chapter_name")


@query("chn13_occurrence_export", "WITH m AS (SELECT trim(p_name) AS name, l_orderkey AS doc_id, l_linenumber AS line, l_partkey AS part FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT name, min(struct_pack(a := doc_id, b := line, c := part)).a AS doc_id, min(struct_pack(a := doc_id, b := line, c := part)).b AS line, count(*) AS occurrence_count FROM m WHERE name <> '' GROUP BY name")
def chn13(t):
    m = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), "l_partkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name")), "l_partkey")
    return chains.occurrence_export(m, "name", ["doc_id", "line", "l_partkey"]).select("name", "doc_id", "line", "occurrence_count")


@query("chn15_numbered_blocks", rf"""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN {_sql_digits("doc_id")} || ' - ' ELSE '' END || {_sql_arabic("coalesce(text, '')")} AS block FROM documents),
x AS (SELECT doc_id, block, regexp_replace(regexp_replace(regexp_replace(block, '^[{T.ARABIC_DIGITS}0-9\s]+{T.DASH}+\s*', ''), '^\s+', ''), '\s+$', '') AS body FROM b)
SELECT doc_id, coalesce(try_cast(translate(regexp_extract(regexp_replace(block, '^\s+', ''), '^([{T.ARABIC_DIGITS}0-9]+)', 1), '{T.ARABIC_DIGITS}', '0123456789') AS int)::bigint, CASE WHEN doc_id % 2 = 0 THEN doc_id END) AS number,
  md5(body) AS body, md5(regexp_replace(body, '{WIDE}', '', 'g')) AS plain FROM x""")
def chn15(t):
    """Numbered page blocks of all texts: odd ids as Arabic digits before the text, the others as the page's fallback."""
    head = F.when(F.col("doc_id") % 2 == 1, F.concat(_digits(F.col("doc_id")), F.lit(" - "))).otherwise(F.lit(""))
    blocks = t.documents.select("doc_id", F.concat(head, _arabic(F.coalesce("text", F.lit("")))).alias("block"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("page_number"))
    x = chains.hadith_page(blocks, "block", "page_number")
    return x.select("doc_id", F.col("number").cast("long").alias("number"), F.md5("body").alias("body"), F.md5("plain").alias("plain"))


@query("chn16_nested_documents", f"""WITH {SPLIT}, o AS (SELECT conv_id, role, min(struct_pack(c := chain_id, p := -pos)) AS k FROM split GROUP BY conv_id, role), u AS (SELECT conv_id, string_agg(role, ',' ORDER BY k) AS names FROM o GROUP BY conv_id),
c AS (SELECT conv_id, chain_id, 'chain_' || cast(chain_id AS varchar) || ':' || string_agg(role, '>' ORDER BY pos) AS f, count(*) AS n FROM split GROUP BY conv_id, chain_id)
SELECT conv_id, count(*) AS n_chains, cast(sum(n) AS bigint) AS n_members, string_agg(f, ' ' ORDER BY chain_id) AS chains, any_value(names) AS unique_names FROM c JOIN u USING (conv_id) GROUP BY conv_id""")
def chn16(t):
    s = chains.split_by_marker(t.turns(), ["conv_id"], "turn", F.col("role") == "assistant")
    d = chains.nested_documents(s, "conv_id", "chain_id", "chain_pos", "role")
    line = F.array_join(F.transform("chains", lambda c: F.concat(c["chain_id"], F.lit(":"), F.array_join(c["names"], ">"))), " ")
    return d.select("conv_id", "n_chains", "n_members", line.alias("chains"), F.array_join("unique_names", ",").alias("unique_names"))


@query("cov05_manual_minus_done", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def cov05(t):
    done = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("id"))
    return sinks.resume(t.customer.select(F.col("c_custkey").alias("id")), done, "id")


# resolution


@query("res01_rules_over_mentions", f"""WITH {MEMBER}, n AS (SELECT m.doc_id, m.pos, p_name AS name, lag(p_name) OVER (PARTITION BY m.doc_id ORDER BY m.pos) AS context FROM member m JOIN part ON part_id = p_partkey),
w AS (SELECT *, string_split(name, ' ')[1] AS first, coalesce(context, '') AS c FROM n)
SELECT doc_id, pos, CASE WHEN first = 'small' THEN 'exact ' || name WHEN first = 'large' AND contains(c, 'ring') THEN 'ring of ' || name WHEN first = 'red' AND c = name THEN 'twin of ' || name END AS value,
  CASE WHEN first = 'small' OR (first = 'large' AND contains(c, 'ring')) OR (first = 'red' AND c = name) THEN 'resolved' WHEN first = 'large' THEN 'ambiguous' ELSE 'unresolved' END AS status FROM w""")
def res01(t):
    """A dictionary, ordered context tests with an ambiguous default, and pairs, as rules made of the table's own names."""
    return resolve.apply_rules(_mentions(t), _rules(t)).select("doc_id", "pos", "value", "status")


def _mentions(t):
    m = t.members().join(t.part.select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("name")), "part_id")
    return chains.previous_member(m, ["doc_id"], "name", None).select("doc_id", "pos", "name", F.col("previous").alias("context"))


def _rules(t):
    n, first = t.part.select(F.col("p_name").alias("name")).distinct(), F.split("name", " ")[0]
    none = F.lit(None).cast("string")
    rule = lambda kind, word, pattern, value, priority, vague: n.where(first == word).select(F.lit(kind).alias("kind"), "name", pattern.alias("pattern"), value.alias("value"), F.lit(priority).alias("priority"), F.lit(vague).alias("ambiguous"))
    value = lambda head: F.concat(F.lit(head), "name")
    return (
        rule("exact", "small", none, value("exact "), 1, False).union(rule("context", "large", F.lit("ring"), value("ring of "), 2, False))
        .union(rule("default", "large", none, none, 9, True)).union(rule("pair", "red", F.col("name"), value("twin of "), 3, False))
    )


@query("res03_context_coverage", f"""WITH {MEMBER}, n AS (SELECT p_name AS name, lag(p_name) OVER (PARTITION BY m.doc_id ORDER BY m.pos) AS context FROM member m JOIN part ON part_id = p_partkey),
f AS (SELECT name, context, count(*) AS frequency FROM n GROUP BY name, context),
s AS (SELECT *, string_split(name, ' ')[1] AS first, coalesce(context, '') AS c FROM f),
r AS (SELECT *, first = 'small' OR (first = 'large' AND contains(c, 'ring')) OR (first = 'red' AND c = name) AS hit FROM s)
SELECT name, count(*) AS pairs, count(*) FILTER (hit) AS resolved_pairs, cast(sum(frequency) AS bigint) AS mentions, cast(coalesce(sum(frequency) FILTER (hit), 0) AS bigint) AS resolved_mentions, round(100.0 * coalesce(sum(frequency) FILTER (hit), 0) / sum(frequency), 1) AS percent FROM r GROUP BY name""")
def res03(t):
    pairs = _mentions(t).groupBy("name", "context").agg(F.count("*").alias("frequency"))
    return resolve.context_coverage(resolve.apply_rules(pairs, _rules(t)))


@query("res05_jn10_prefixes", """WITH owner AS (SELECT p_name || ' ' || p_brand || ' ' || cast(p_size AS varchar) AS key, count(DISTINCT p_partkey) AS n, min(p_partkey) AS id FROM part GROUP BY 1),
second AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS key, 'first ' || string_split(p_name, ' ')[1] AS id FROM part WHERE p_size > 20), s AS (SELECT key, count(*) AS n, min(id) AS id FROM second GROUP BY key),
m AS (SELECT DISTINCT p_name || ' ' || p_brand || ' ' || cast(p_size AS varchar) || ' ' || p_type AS key FROM part), w AS (SELECT key, string_split(key, ' ') AS t FROM m),
tries AS (SELECT key, len(t) - i AS rank, array_to_string(t[1:i], ' ') AS prefix FROM w, LATERAL unnest(range(1, len(t) + 1)) u(i)),
hit AS (SELECT tries.key, rank, prefix, coalesce(CASE WHEN o.n = 1 THEN cast(o.id AS varchar) END, CASE WHEN s.n = 1 THEN s.id END) AS id FROM tries LEFT JOIN owner o ON prefix = o.key LEFT JOIN s ON prefix = s.key)
SELECT key, arg_min(id, rank) AS person_id, arg_min(prefix, rank) AS matched FROM hit WHERE id IS NOT NULL GROUP BY key""")
def res05(t):
    """Full names and ever shorter prefixes of them against two lookups; the tests hold the choice among shared prefixes."""
    full = F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string"))
    primary = resolve.exact_lookup(t.part.select(full.alias("key"), F.col("p_partkey").cast("string").alias("person_id")))
    word = F.split("p_name", " ")[0]
    first = t.part.where("p_size > 20").select(word.alias("key"), F.concat(F.lit("first "), word).alias("person_id")).distinct()
    names = t.part.select(F.concat_ws(" ", full, "p_type").alias("key"))
    return resolve.match_prefix(names, primary, resolve.exact_lookup(first), t.part.limit(0).select(F.col("p_name").alias("key"), F.col("p_brand").alias("person_id")))


@query("jn11_res09_text_keys", f"""WITH {MEMBER}, d AS (SELECT doc_id, list(CASE WHEN pos % 2 = 0 THEN cast(part_id AS varchar) END ORDER BY pos) AS ids, list(cast(part_id AS varchar) ORDER BY pos) AS all_ids FROM member GROUP BY doc_id),
x AS (SELECT doc_id, 'text of the order ' || cast(doc_id - doc_id % 2 * (doc_id % 3 // 2) AS varchar) AS text, ids, all_ids FROM d),
b AS (SELECT left(text, 100) AS k, count(*) AS n, any_value(all_ids) AS b_ids FROM x GROUP BY 1),
j AS (SELECT x.doc_id, list_sort(list_filter(list_distinct(b_ids), lambda v: NOT list_contains(ids, v))) AS free, list_filter(range(0, len(ids)), lambda i: ids[i + 1] IS NULL) AS slots FROM x JOIN b ON left(x.text, 100) = k WHERE n = 1)
SELECT doc_id, unnest(slots) AS slot, unnest(free) AS person_id FROM j WHERE len(free) = len(slots) AND len(slots) > 0""")
def res09(t):
    """Open slots of chains are filled from the one block of the same text start; a text that two documents share fills none."""
    m = t.members()
    id_ = F.col("part_id").cast("string")
    g = m.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("pos") % 2 == 0, id_).alias("known"), id_.alias("id")))).alias("x"))
    text = F.concat(F.lit("text of the order "), (F.col("doc_id") - F.col("doc_id") % 2 * F.floor(F.col("doc_id") % 3 / 2)).cast("string"))
    d = g.select("doc_id", text.alias("text"), F.transform("x", lambda x: x["known"]).alias("ids"), F.transform("x", lambda x: x["id"]).alias("all_ids"))
    found = resolve.match_text_key(d.select("doc_id", "text", "ids"), d.select("text", F.col("all_ids").alias("ids")))
    return found.select("doc_id", F.col("slot").cast("long").alias("slot"), "person_id")


# pages of persons


def _person_html():
    """A person page of each part: heading, labelled fields, quotes under headings."""
    part = lambda *x: F.concat(*[F.lit(c) if c.startswith("<") or not c.startswith("p_") else F.col(c).cast("string") for c in x])
    return part("<html><h1> ", "p_name", "</h1><dl><dt>Brand:</dt><dd><b>", "p_brand", "</b></dd><dt>Size</dt> <dd>", "p_size", "</dd><dt>Brand</dt><dd>other</dd></dl><h2>Type</h2><p>", "p_type", "</p><p>said &quot;", "p_brand", "&quot;</p><h2>Last</h2><ul><li><a href=\"<>", "p_size", "\">x</a></li></ul></html>")


@query("htm04_htm05_person_pages", """SELECT p_partkey, p_name AS name, p_brand AS brand, cast(p_size AS varchar) AS size, p_type || '|said "' || p_brand || '"' AS quotes, 2 AS n_sections FROM part""")
def htm04(t):
    page = html.person_page(t.part.select("p_partkey", F.replace(_person_html(), F.lit("<>"), F.lit("/people/")).alias("html")))
    return page.select("p_partkey", "name", F.col("fields")["Brand"].alias("brand"), F.col("fields")["Size"].alias("size"), F.array_join(F.element_at("sections", 1)["items"], "|").alias("quotes"), F.size("sections").alias("n_sections"))


# readers and writers


@query("src01_json_array", "SELECT n_nationkey, n_name FROM nation")
def src01(t):
    """A file of one JSON array, whole."""
    path = _path(t, "array")
    sinks.write_json_arrays(t.nation.select(F.lit(1).alias("file"), "n_nationkey", "n_name"), path, "file")  # a table of 25 rows
    return readers.json_array(t.spark, path, "n_nationkey int, n_name string")


def _jsonl(t) -> str:
    """Customers as JSON lines, every seventh broken."""
    path = _path(t, "lines")
    status = F.when(F.col("c_custkey") % 3 == 0, F.lit("failed")).otherwise(F.lit("success"))
    line = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), status.alias("status")))
    t.customer.select(F.when(F.col("c_custkey") % 7 == 3, F.concat(F.lit("{\"id\": "), "c_name")).otherwise(line).alias("value")).write.text(path)
    return path


@query("src02_tolerant_lines", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 7 <> 3 AND c_custkey % 3 <> 0")
def src02(t):
    return readers.jsonl(t.spark, _jsonl(t), "id long, name string, status string", success=True).select("id", "name")


@query("src03_counted_lines", "SELECT count(*) FILTER (c_custkey % 7 <> 3) AS kept, count(*) FILTER (c_custkey % 7 = 3) AS skipped FROM customer")
def src03(t):
    return readers.kept_and_skipped(readers.jsonl(t.spark, _jsonl(t), "id long, name string, status string", mode="count"))


@query("src04_strict_lines", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def src04(t):
    path = _path(t, "strict")
    t.orders.select(F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))).alias("value")).write.text(path)
    return readers.jsonl(t.spark, path, "id long, status string", mode="strict")


@query("src05_biographies", "SELECT cast(o_custkey AS varchar) AS person_id, arg_max(o_orderpriority, o_orderkey) AS name, nullif(arg_max(CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END, o_orderkey), '') AS bio FROM orders GROUP BY o_custkey")
def src05(t):
    rows = t.orders.select(F.col("o_custkey").cast("string").alias("person_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit(": :"), "o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") == "F", F.lit("")).otherwise(F.col("o_orderstatus")).alias("bio"))
    return readers.biographies(rows, "seq")


@query("src06_src16_json_map", "SELECT r_name AS key, string_agg(n_name, ',' ORDER BY n_name) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def src06(t):
    path = _path(t, "map")
    names = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("key")).agg(F.array_sort(F.collect_list("n_name")).alias("value"))
    names = names.union(t.region.where("r_regionkey = 0").select(F.lit("_comment_1"), F.array(F.lit("left out"))))
    names.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("value")).write.text(path)  # one object of 6 keys
    missing = readers.json_map(t.spark, f"{path}-none")
    return readers.json_map(t.spark, path).union(missing).select("key", F.array_join("value", ",").alias("names"))


def _csv(df, path: str) -> str:
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return path


@query("src07_src08_csv_texts", "SELECT 'first' AS way, trim(p_name) AS text FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT 'named', trim(p_type) || ', \"' || p_brand || '\"' FROM part")
def src07(t):
    p = t.part.select(F.when(F.col("p_partkey") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name")).alias("a"), F.concat("p_type", F.lit(', "'), "p_brand", F.lit('"')).alias("b"))
    path = _csv(p, _path(t, "csv"))
    first, named = readers.csv_text(t.spark, path), readers.csv_text(t.spark, path, "b")
    return first.select(F.lit("first").alias("way"), "text").union(named.select(F.lit("named"), "text"))


@query("src09_sniffed_csv", "SELECT p_partkey AS doc_index, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS text FROM part")
def src09(t):
    p = t.part.select(F.col("p_partkey").alias("Index"), F.col("p_type").alias("other"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.lit(" ")).alias("Text"))
    return readers.csv_sniffed(t.spark, _csv(p.select("other", "Index", "Text"), _path(t, "sniffed")))


@query("src10_csv_shape", "SELECT row_number() OVER (ORDER BY s_suppkey) AS id, s_name AS full_text, s_nationkey AS place FROM supplier")
def src10(t):
    """Files without ids, by their names and in the order of their rows: renamed, with a sequential id."""
    path = _path(t, "shape")
    parts = t.supplier.repartitionByRange(4, "s_suppkey").sortWithinPartitions("s_suppkey").select(F.col("s_name").alias("text"), F.col("s_nationkey").alias("place"))
    df = readers.csv_shape(t.spark, _csv(parts, path), {"text": "full_text"})
    return df.select("id", "full_text", F.col("place").cast("int").alias("place"))


@query("src11_positional_lines", "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS ordinal, s_name AS line FROM supplier")
def src11(t):
    """Lines of several files, each with a header, with blank lines between them."""
    path = _path(t, "raw")
    lines = t.supplier.select("s_suppkey", F.explode(F.array("s_name", F.lit(None))).alias("header"))
    lines.repartitionByRange(4, "s_suppkey").sortWithinPartitions("s_suppkey").select("header").write.option("header", True).option("nullValue", "").csv(path)
    return readers.raw_lines(t.spark, path)


@query("src12_src14_first_format", "SELECT 'chains' AS format, count(*) AS n FROM region")
def src12(t):
    """The first path that exists, and the format that its keys tell."""
    path = _path(t, "format")
    t.region.select(F.col("r_name").alias("text"), F.array("r_regionkey").alias("chains"), F.array("r_name").alias("narrators")).write.json(path)
    found = readers.first_existing(t.spark, [f"{path}-none", path])
    kind = readers.format_of(set(t.spark.read.json(found).columns))
    return t.spark.read.schema("text string").json(found).agg(F.count("*").alias("n")).select(F.lit(kind).alias("format"), "n")


@query("src13_names_of_sources", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN lower(o_orderstatus) || 'x' WHEN o_orderkey % 4 = 1 THEN NULL WHEN o_orderkey % 4 = 2 THEN 'results_' || cast(o_orderkey AS varchar) ELSE 'o' || cast(o_orderkey AS varchar) END AS source FROM orders")
def src13(t):
    k, key = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    name = F.when(k == 0, F.concat(F.lower("o_orderstatus"), F.lit("x_texts.json"))).when(k == 1, F.lit("narrator_chains.json")).when(k == 2, F.concat(F.lit("results_"), key, F.lit(".json"))).otherwise(F.concat(F.lit("o"), key, F.lit(".jsonl")))
    return t.orders.select("o_orderkey", readers.source_of_file(F.concat(F.lit("/data/some_folder/"), name)).alias("source"))


@query("src15_id_lines", "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 4 <> 1")
def src15(t):
    path = _path(t, "ids")
    key = F.col("s_suppkey").cast("string")
    t.supplier.select(F.when(F.col("s_suppkey") % 4 == 1, F.lit("no id here")).when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("id: "), key, F.lit(" of 7"))).otherwise(key).alias("value")).write.text(path)
    return readers.id_lines(t.spark, path)


@query("src19_scan_by_label", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def src19(t):
    path = _path(t, "nodes")
    nodes = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("Person").alias("label")).union(t.part.select("p_partkey", "p_name", F.lit("Part")))
    nodes.write.partitionBy("label").parquet(path)
    return readers.label_tables(t.spark, path, "Person").select("id", "name")


@query("src20_csv_to_parquet", "SELECT cast(c_custkey AS varchar) AS c_custkey, c_name, c_mktsegment FROM customer")
def src20(t):
    path = _csv(t.customer.select("c_custkey", "c_name", "c_mktsegment"), _path(t, "customers"))
    readers.csv_to_parquet(t.spark, path, f"{path}-parquet")
    return t.spark.read.parquet(f"{path}-parquet")


@query("snk09_json_arrays", "SELECT n_regionkey AS region, n_name AS name FROM nation")
def snk09(t):
    """Arrays of non-ASCII text, read back line by line."""
    path = _path(t, "arrays")
    sinks.write_json_arrays(t.nation.select(F.col("n_regionkey").alias("file"), "n_regionkey", F.concat(F.lit("é"), "n_name").alias("name")), path, "file")
    raw = t.spark.read.text(path).where(F.col("value").contains("é"))  # written as it is, not escaped
    items = raw.select(F.explode(F.from_json("value", "array<struct<n_regionkey:int,name:string>>")).alias("x"))
    return items.select(F.col("x.n_regionkey").alias("region"), F.substring("x.name", 2, 100).alias("name"))


@query("snk10_sorted_lines", "SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_type = 'view' THEN NULL ELSE user_id END NULLS LAST, event_id) AS line FROM events")
def snk10(t):
    """Lines in the order of a key, nulls last, read back with their place in the sorted files."""
    path = _path(t, "sorted")
    rows = t.events.select(F.when(F.col("event_type") != "view", F.col("user_id")).alias("k"), "event_id")
    sinks.write_jsonl(rows, path, [F.col("k").asc_nulls_last(), "event_id"])
    back = t.spark.read.schema("k long, event_id long").json(path).select("k", "event_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    numbered = back.withColumn("m", F.monotonically_increasing_id()).withColumn("part", F.shiftright("m", 33))
    size = numbered.groupBy("file", "at", "part").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    starts = sorted(size.collect(), key=lambda r: (r["file"], r["at"]))  # a row for each piece of a file
    before, cells = 0, []
    for r in starts:
        cells += [F.lit(f"{r['file']}/{r['at']}"), F.lit(before - r["first"])]
        before += r["n"]
    return numbered.select("event_id", (F.col("m") + F.element_at(F.create_map(*cells), F.concat_ws("/", "file", F.col("at").cast("string"))) + 1).cast("long").alias("line"))


@query("snk11_csv_cells", "SELECT p_partkey, replace(p_name, ' ', chr(10)) AS words, p_type AS type FROM part")
def snk11(t):
    """Arrays as lines of a cell, quotes and a byte order mark, read back."""
    path = _path(t, "cells")
    sinks.write_csv(t.part.select("p_partkey", F.split("p_name", " ").alias("words"), F.concat(F.lit('"'), "p_type", F.lit('"')).alias("type")), path, bom=True)
    back = t.spark.read.schema("p_partkey long, words string, type string").option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.select("p_partkey", "words", F.replace("type", F.lit('"'), F.lit("")).alias("type"))


@query("snk15_drawn_edges", f"WITH {SPLIT}, e AS (SELECT conv_id, chain_id, pos, lead(role) OVER (PARTITION BY conv_id, chain_id ORDER BY pos) AS nxt FROM split) SELECT 'n_' || conv_id || '_' || chain_id || '_' || pos AS from_id, 'n_' || conv_id || '_' || chain_id || '_' || (pos + 1) AS to_id, CASE chain_id % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'blue' END AS colour FROM e WHERE nxt IS NOT NULL")
def snk15(t):
    s = chains.split_by_marker(t.turns(), ["conv_id"], "turn", F.col("role") == "assistant")
    e = chains.consecutive_edges(s, ["conv_id", "chain_id"], "role", "chain_pos")
    return graph.visual_edges(e, "conv_id", "chain_id", "pos", ["red", "green", "blue"])


@query("snk20_atomic_state", "SELECT user_id, count(*) AS attempts FROM events WHERE event_type = 'error' GROUP BY user_id")
def snk20(t):
    """A state table that is replaced whole: the second version is what is read."""
    path = _path(t, "state")
    n = t.events.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("attempts"))
    write_state(t.events.select("user_id", F.lit(0).cast("long").alias("attempts")).distinct(), path)
    write_state(n, path)
    return read_state(t.spark, path)


@query("grf20_schema_of_rows", "SELECT 'supplier' AS label, s_nationkey % 2 = 0 AS even, count(*) AS n, count(s_name) AS names, count(s_acctbal) AS balances FROM supplier GROUP BY ALL")
def grf20(t):
    """Which properties the rows of a label fill."""
    return t.supplier.groupBy((F.col("s_nationkey") % 2 == 0).alias("even")).agg(F.count("*").alias("n"), F.count("s_name").alias("names"), F.count("s_acctbal").alias("balances")).withColumn("label", F.lit("supplier"))


@query("cov02_expected_numbers", "SELECT unnest(range(0, (SELECT max(user_id) FROM events) + 1)) AS user_id")
def cov02(t):
    return quality.expected_range(t.events, "user_id")


# an extension: the append log as a stream


@query("str01_streamed_status", "SELECT user_id AS k, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def str01(t):
    """The log as JSON files, read as a stream in several batches into a table of the latest status of each key."""
    path = _path(t, "log")
    t.events.select(F.col("user_id").alias("k"), F.col("event_type").alias("status"), F.col("event_id").alias("seq")).repartition(4).write.json(path)
    log = status.read_log(t.spark, path, "k long, status string, seq long", 2)
    status.keep_latest(log, "k", "status", "seq", f"{path}-table", f"{path}-checkpoint").awaitTermination()
    return status.current(t.spark, f"{path}-table").select("k", "status")
