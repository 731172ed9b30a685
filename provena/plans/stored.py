"""Named queries over stored tables that batches keep up, checked against one pass over the tables, and over signatures and page trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counts, discovery, neighbourhoods, neighbours, page_tree
from ..operators.pages import Paged
from ..operators.state import scratch
from ..operators.store import Store
from ..operators.text_index import TextIndex
from ..streaming import retries
from .adapter import EDGE, PART_EDGE
from .catalog import query

_WORDS = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _bm25(weights: list[float], asked: list[str]) -> str:
    """Scores of all documents in SQL, fields f0 (first line) and f1 (text)."""
    head, body = _WORDS.format(r"string_split(text, chr(10))[1]"), _WORDS.format("text")
    part = lambda k, w: f"CASE WHEN tf{k}{w} > 0 THEN {weights[k]} * ln(1 + (d - df{k}{w} + 0.5) / (df{k}{w} + 0.5)) * tf{k}{w} * 2.2 / (tf{k}{w} + 1.2 * (0.25 + 0.75 * n{k} / m{k})) ELSE 0 END"
    at = [(k, w) for k in range(2) for w in range(len(asked))]
    tf = ", ".join(f"len(list_filter(f{k}, lambda x: x = '{asked[w]}')) AS tf{k}{w}" for k, w in at)
    df = ", ".join(f"count(*) FILTER (tf{k}{w} > 0) AS df{k}{w}" for k, w in at)
    hit = " + ".join(f"(tf0{w} + tf1{w} > 0)::int" for w in range(len(asked)))
    return f"""WITH f AS (SELECT doc_id AS id, {head} AS f0, {body} AS f1 FROM documents), t AS (SELECT id, len(f0) AS n0, len(f1) AS n1, {tf} FROM f),
s AS (SELECT count(*) AS d, avg(n0) AS m0, avg(n1) AS m1, {df} FROM t),
r AS (SELECT id, round({" + ".join(part(k, w) for k, w in at)}, 9) AS score, cast({hit} AS bigint) AS matched FROM t, s WHERE {hit} > 0)
SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, round(score, 6) AS score, matched FROM r ORDER BY score DESC, id LIMIT 50"""


@query("srch02_two_field_index", _bm25([2.0, 1.0], ["license", "the", "version"]).replace("row_number() OVER (ORDER BY score DESC, id) AS rank", "cast(row_number() OVER (ORDER BY score DESC, id) AS int) AS rank"))
def srch02_index(t):
    """The 50 best documents for a question in two weighted fields, from an index that two batches built, one of them bringing documents again."""
    docs = t.documents.withColumn("head", F.substring_index("text", "\n", 1))
    index = TextIndex(Store(t.spark, scratch(t.spark, "text-index")), ["head", "text"])
    index.add("first", docs.where("coalesce(lang, '') <> 'de'"), "doc_id")
    index.add("second", docs.where("coalesce(lang, '') IN ('de', 'fr')"), "doc_id")
    return index.search("License: the VERSION", 50, [2.0, 1.0]).withColumn("score", F.round("score", 6))


@query("snk01_snk06_stored_upserts", """WITH o AS (SELECT o_custkey AS k, max(o_totalprice) AS top FROM orders GROUP BY o_custkey)
SELECT cast(c_custkey AS bigint) AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_name END AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'replaced' ELSE c_mktsegment END AS segment, top
FROM customer LEFT JOIN o ON c_custkey = k WHERE c_mktsegment <> 'MACHINERY'""")
def stored_upserts(t):
    """A node table after an insert, a repeat that changes nothing, a replacement, a partial update and a deletion, each of the buckets that it touches."""
    store, keys = Store(t.spark, scratch(t.spark, "nodes")), ["id"]
    c = t.customer.select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit(None).cast("double").alias("top"))
    store.upsert("nodes", "insert", c, keys, "keep", 16)
    store.upsert("nodes", "insert", c.withColumn("name", F.lit("never")), keys, "replace", 16)  # the same batch id
    store.upsert("nodes", "keep", c.withColumn("name", F.lit("never")), keys, "keep", 16)
    store.upsert("nodes", "replace", c.where("segment = 'BUILDING'").withColumns({"name": F.lit(None).cast("string"), "segment": F.lit("replaced")}), keys, "replace", 16)
    store.upsert("nodes", "fields", t.orders.groupBy(F.col("o_custkey").cast("long").alias("id")).agg(F.max("o_totalprice").alias("top")), keys, "fields", 16)
    store.upsert("nodes", "delete", c.where("segment = 'MACHINERY'"), keys, "delete", 16)
    store.vacuum()
    return store.read("nodes")


@query("agg10_chn07_stored_counts", f"WITH {EDGE} SELECT o_orderstatus AS source, src, dst, count(DISTINCT doc_id) AS n_docs, count(*) AS n_links FROM edge JOIN orders ON doc_id = o_orderkey WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2, 3")
def stored_counts(t):
    """Pair counts by source after two appends, a repeat and a deletion, moved by differences and never recounted."""
    docs = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("priority"))
    e = t.edges().join(docs, "doc_id").select("source", "src", "dst", F.col("doc_id").alias("doc"), "priority", F.lit(1).alias("change"))
    store = Store(t.spark, scratch(t.spark, "pair-counts"))
    urgent = F.col("priority").isin("1-URGENT", "5-LOW")
    for batch, rows in (("urgent", e.where(urgent)), ("others", e.where(~urgent)), ("urgent", e.where(urgent)), ("gone", e.where("priority = '5-LOW'").withColumn("change", F.lit(-1)))):
        counts.apply(store, batch, rows, 16)
    return counts.pairs(store)


@query("srt05_grf30_page_with_total", """WITH p AS (SELECT o_orderdate, o_orderkey, o_orderpriority FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 740),
n AS (SELECT o_orderdate, o_orderkey, o_orderpriority FROM orders WHERE (o_orderdate, o_orderkey) > (SELECT max((o_orderdate, o_orderkey)) FROM p) ORDER BY o_orderdate, o_orderkey LIMIT 20)
SELECT 'page 38' AS page, (SELECT count(*) FROM orders) AS total, * FROM p UNION ALL SELECT 'after', (SELECT count(*) FROM orders), * FROM n""")
def pages_with_total(t):
    """A page by its number and the next one by the last key, each with the total, from ranges whose counts and bounds are stored."""
    paged = Paged(t.orders.select("o_orderdate", "o_orderkey", "o_orderpriority"), ["o_orderdate", "o_orderkey"], 16)
    page, total = paged.page(38, 20)
    last = page.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).select("o_orderdate", "o_orderkey").first()
    named = lambda df, what: df.select(F.lit(what).alias("page"), F.lit(total).cast("long").alias("total"), "*")
    return named(page, "page 38").union(named(paged.after(tuple(last), 20)[0], "after"))


@query("cov10_streamed_retries", "WITH l AS (SELECT user_id, max(struct_pack(t := ts, e := event_id)) FILTER (event_type = 'purchase') AS last FROM events GROUP BY user_id) SELECT e.user_id AS item, count(*) AS n_rerun, count(*) >= 60 AS give_up FROM events e JOIN l ON e.user_id = l.user_id WHERE event_type <> 'purchase' AND (last IS NULL OR struct_pack(t := ts, e := event_id) > last) GROUP BY 1")
def streamed_retries(t):
    """The retry state of a log that comes as a stream of files, and in part twice: the answer of one pass over the log."""
    path = scratch(t.spark, "retries")
    rows = t.events.select(F.col("user_id").alias("item"), F.struct("ts", "event_id").alias("seq"), (F.col("event_type") == "purchase").alias("ok"))
    rows.union(rows.where("ok")).repartition(4).write.parquet(f"{path}/log")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/log")
    retries.keep(stream, f"{path}/store", f"{path}/checkpoint", buckets=8).awaitTermination()
    return retries.queue(Store(t.spark, f"{path}/store"), 60)


_BLEND = """e AS (SELECT vec_id, cast(embedding AS double[]) AS v FROM embeddings), x AS (SELECT 2 * vec_id AS id, v FROM e UNION ALL
SELECT 2 * a.vec_id + 1, list_transform(list_zip(a.v, b.v), lambda p: p[1] + 0.6 * p[2]) FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 UNION ALL SELECT -1 - vec_id, v FROM e WHERE vec_id % 7 = 0)"""


@query("sim01_all_neighbours", f"""WITH {_BLEND}, f AS (SELECT v, min(id) AS class_id, count(*) AS copies FROM x GROUP BY v),
n AS (SELECT a.class_id, sum(b.copies) AS near FROM f a JOIN f b ON a.class_id <> b.class_id AND list_cosine_similarity(a.v, b.v) >= 0.85 GROUP BY 1)
SELECT id, f.class_id, cast(copies - 1 + coalesce(near, 0) AS bigint) AS n_links FROM x JOIN f ON x.v = f.v LEFT JOIN n ON n.class_id = f.class_id""")
def all_neighbours(t):
    """Every vector, its blend with the next (which lies about the threshold of 0.85) and some copies: class and number of neighbours."""
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    blend = e.join(after, "vec_id").select((2 * F.col("vec_id") + 1).alias("id"), F.zip_with("v", "w", lambda x, y: x + 0.6 * y).alias("v"))
    copies = e.where("vec_id % 7 = 0").select((-1 - F.col("vec_id")).alias("id"), "v")
    x = e.select((2 * F.col("vec_id")).alias("id"), "v").union(blend).union(copies)
    return neighbours.similar_rows(x, "id", "v", 0.85)[0]


@query("crw01_stored_discovery", f"""WITH RECURSIVE {PART_EDGE}, link AS (SELECT DISTINCT src, dst FROM edge), w AS (SELECT DISTINCT src AS id, 0 AS round FROM link WHERE src % 97 = 1 UNION SELECT dst, round + 1 FROM w JOIN link ON src = id WHERE round < 40),
f AS (SELECT id, min(round) AS round FROM w GROUP BY id)
SELECT f.id, min(g.id) AS discovered_from, cast(f.round AS int) AS round FROM f LEFT JOIN link ON dst = f.id LEFT JOIN f g ON g.id = src AND g.round = f.round - 1 GROUP BY f.id, f.round""")
def stored_discovery(t):
    """What links reach from some seeds, with source and round: two rounds, a stop, and the rest from the store."""
    store, links = Store(t.spark, scratch(t.spark, "discovery")), t.edges("part_id").select("src", "dst")
    discovery.start(store, links, links.where("src % 97 = 1").select(F.col("src").alias("id")), 16)
    discovery.discover(store, rounds=2)
    return discovery.discover(store)


@query("htm02_htm05_nested_pages", """SELECT p_partkey AS id, '/part/' || p_partkey AS second_href, p_name || ' ' || p_type AS outer_text, p_name AS inner_text, cast(2 AS bigint) AS n_blocks, p_brand || ' ' || p_name AS first_block, p_name AS matn, p_type AS last_block, '<b>' || p_brand || '</b><p>' || p_size AS box, p_brand || ' ' || p_size AS maker FROM part""")
def nested_pages(t):
    """Fields of pages whose blocks nest, and whose paragraphs, items and terms are left open: one page for each part."""
    p = [F.col(c) for c in ("p_partkey", "p_name", "p_type", "p_brand", "p_type", "p_brand", "p_size")]
    html = F.format_string('<ul class="breadcrumb"><li><a href="/">all</a><li><a href="/part/%1$s">it</a></ul><div class="a"><div class="b"><b>%2$s</b></div>%3$s</div><p>%4$s <span class="c2 x"><i>%2$s</i></span><p>%5$s<dl><dt>Maker:<dd><b>%6$s</b><p>%7$s<dt>Maker<dd>none</dl>', *p)
    pages = t.part.select(F.col("p_partkey").alias("id"), html.alias("html")).withColumn("t", page_tree.tree(F.col("html")))
    tree, first = F.col("t"), lambda *tags, cls=None: F.try_element_at(page_tree.elements(F.col("t"), *tags, cls=cls), F.lit(1))
    blocks = F.slice(page_tree.text_blocks(tree), 1, 2)
    return pages.select("id", page_tree.breadcrumbs(tree)[1]["href"].alias("second_href"), page_tree.text(tree, first("div", cls="a")).alias("outer_text"), page_tree.text(tree, first("div", cls="b")).alias("inner_text"),
        F.size(blocks).cast("long").alias("n_blocks"), blocks[0]["full_text"].alias("first_block"), blocks[0]["matn"].alias("matn"), blocks[1]["full_text"].alias("last_block"),
        page_tree.inner(F.col("html"), first("dd")).alias("box"), page_tree.labelled_fields(tree)["Maker"].alias("maker"))


@query("grf12_sizes_of_all", f"""WITH {PART_EDGE}, u AS (SELECT src AS a, dst AS b FROM edge UNION SELECT dst, src FROM edge UNION SELECT src, src FROM edge UNION SELECT dst, dst FROM edge),
two AS (SELECT DISTINCT x.a, y.b FROM u x JOIN u y ON x.b = y.a)
SELECT a AS node, cast(1 AS int) AS hop, count(*) - 1 AS size, count(*) <= 4096 AS exact FROM u GROUP BY a UNION ALL SELECT a, 2, count(*) - 1, count(*) <= 4096 FROM two GROUP BY a""")
def sizes_of_all(t):
    """How many other nodes lie within one and two undirected steps of every node; exact for up to 4,095."""
    return neighbourhoods.sizes(t.edges("part_id"), 2, 4096)
