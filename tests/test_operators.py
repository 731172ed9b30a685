"""Chains, resolution, graph, coverage, sinks and sources on small tables."""

import json
import random

import pytest
from provena.operators import chains, graph, html, quality, resolve, search
from provena.sources import readers, sinks
from pyspark.sql import functions as F


def split(spark, roles):
    rows = [(1, i, n, r) for i, (n, r) in enumerate(roles)]
    df = spark.createDataFrame(rows, "doc int, at int, name string, role string")
    out = chains.split_by_marker(df, ["doc"], "at", F.col("role") == "lead", name="name").orderBy("chain_id", "chain_pos").collect()
    got = {}
    for r in out:
        got.setdefault(r["chain_id"], []).append(r["name"])
    return list(got.values())


def test_split_by_marker(spark):
    assert split(spark, [("A", "narrator"), ("B", "narrator"), ("C", "lead")]) == [["C", "B", "A"]]
    assert split(spark, [("A", "n"), ("B", "lead"), ("C", "n"), ("D", "lead"), ("E", "n")]) == [["B", "A"], ["D", "C"]]
    assert split(spark, [("A", "n"), ("B", "n"), ("C", "n")]) == [["C", "B", "A"]]
    assert split(spark, [("A", "n"), (None, "n"), ("", "n"), ("C", "lead")]) == [["C", "A"]]


def test_ingest(spark):
    member = "array<struct<name:string,role:string>>"
    rows = [("s", 1, "t1", [("أبو بكر", "narrator"), ("عمر", "lead")]), ("s", 2, None, [("ابو بكر", "lead")]), ("s", None, "x", [("a", "lead")]), ("s", 4, "y", None), ("s", 5, "y", [])]
    t = chains.ingest(spark.createDataFrame(rows, f"source string, doc_index int, text string, members {member}"))
    assert sorted((r["norm"], r["name"], r["occurrence_count"]) for r in t["persons"].collect()) == [("ابو بكر", "أبو بكر", 2), ("عمر", "عمر", 1)]
    assert sorted((str(r["doc_index"]), r["reason"]) for r in t["errors"].collect()) == [("4", "no chains"), ("5", "no chains"), ("None", "missing index")]
    assert [(r["pos"], r["src"], r["dst"]) for r in t["edges"].collect()] == [(1, "عمر", "ابو بكر")]
    assert {(r["doc_index"], r["formatted"]) for r in t["chains"].collect()} == {(1, "عمر → أبو بكر"), (2, "ابو بكر")}
    assert t["leads"].count() == 2 and t["edge_counts"].count() == 1
    other = chains.ingest(spark.createDataFrame([*rows, ("z", 1, "t1", rows[0][3]), ("z", 2, "t2", rows[0][3])], f"source string, doc_index int, text string, members {member}"))
    assert sorted((r["source"], r["n_docs"], r["doc_ids"]) for r in other["edge_counts"].collect()) == [("s", 1, [1]), ("z", 2, [1, 2])]


def test_validation(spark):
    kind = "chains array<struct<chain_id:string,type:string,narrators:array<struct<name:string,role:string>>>>"
    good = [("chain_1", "primary", [("a", "narrator"), ("b", "lead")])]
    cases = [(good, "ok"), ([("x", "primary", good[0][2])], "bad chain id"), ([("chain_1", "odd", good[0][2])], "bad type"), ([("chain_1", "primary", [])], "no narrators"), ([("chain_1", "nested", [(" ", "lead")])], "empty name"), ([("chain_1", "nested", [("النبي", "lead")])], "prophet among narrators"), ([("chain_1", "nested", [("a", None)])], "missing role"), ([("chain_1", "nested", [("a", "narrator")])], "last is no lead"), (None, "ok")]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], f"i int, {kind}")
    assert [r["reason"] for r in chains.validate(df).orderBy("i").collect()] == [r for _, r in cases]


def test_pages_and_persons(spark):
    schema = "status string, page_number long, book_id long, breadcrumb_links array<struct<text:string,href:string>>, hadith_blocks array<struct<full_text:string,matn:string,narrators:array<struct<id:string,name:string,url:string>>>>"
    links = [("home", "/"), ("B", "/book/1/7"), ("C", "/book/1/8")]
    rows = [("success", 3, 1, links, [("حَدَّثَ", "مَ", [("9", "n", "/narrator/9")]), ("b", None, [])]), ("failed", 4, 1, links, [("x", "y", [])]), ("success", 5, 1, links[:1], [("z", "", [])])]
    got = chains.parse_pages(spark.createDataFrame(rows, schema)).orderBy("page_number", "block_no").collect()
    assert [(r["page_number"], r["block_no"], r["book_section_id"], r["chapter_section_id"], r["full_text_plain"]) for r in got] == [(3, 0, 7, 8, "حدث"), (3, 1, 7, 8, "b"), (5, 0, None, None, "z")]
    ids, bios = spark.createDataFrame([("1",), ("2",)], "person_id string"), spark.createDataFrame([("1", "N"), ("3", "")], "person_id string, name string")
    p = chains.person_dimension(ids, bios, spark.createDataFrame([("2", ["v", "w"])], "person_id string, names array<string>"))
    assert sorted((r["person_id"], r["name"]) for r in p.collect()) == [("1", "N"), ("2", "v"), ("3", "narrator_3")]


def trails(edges, start, depth):
    out, stack = [], [([start], [])]
    while stack:
        nodes, used = stack.pop()
        for i, a, b in edges:
            if a == nodes[-1] and i not in used and len(used) < depth:
                out.append((tuple(nodes + [b]), tuple(used + [i])))
                stack.append((nodes + [b], used + [i]))
    return sorted(out)


def test_paths_and_hops(spark):
    rng = random.Random(2)
    for _ in range(3):
        edges = [(i, rng.randrange(6), rng.randrange(6)) for i in range(9)]
        df = spark.createDataFrame(edges, "eid int, src int, dst int")
        start = spark.createDataFrame([(1,)], "node int")
        got = sorted((tuple(r["nodes"]), tuple(r["eids"])) for r in graph.bounded_paths(df, start, 3).collect())
        assert got == trails(edges, 1, 3)
        both = edges + [(i, b, a) for i, a, b in edges if a != b]
        for k in (1, 2, 3):
            used = {e for _, es in trails(both, 1, k) for e in es}
            assert {r["eid"] for r in graph.hop_edges(df, start, k).collect()} == used
    cyc = spark.createDataFrame([("a", 1, 2), ("b", 2, 3), ("c", 3, 1), ("d", 3, 4)], "eid string, src int, dst int")
    nodes = {tuple(r["nodes"]) for r in graph.bounded_paths(cyc, spark.createDataFrame([(1,)], "node int"), 3).collect()}
    assert nodes == {(1, 2), (1, 2, 3), (1, 2, 3, 1), (1, 2, 3, 4)}
    with pytest.raises(ValueError):
        graph.bounded_paths(cyc, cyc, 0)


def test_crawl(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4)], "src long, dst long")
    got = {(r["id"], r["discovered_from"], r["round"]) for r in graph.crawl(links, spark.createDataFrame([(1,)], "id long")).collect()}
    assert got == {(1, None, 0), (2, 1, 1), (3, 2, 2), (4, 2, 2)}


def test_crawl_of_a_long_chain(spark):
    """Discovery ends with the frontier; rounds and max_ids end it where they are given."""
    links = spark.range(1, 24).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    seed = spark.range(1, 2)
    assert sorted((r["id"], r["round"]) for r in graph.crawl(links, seed).collect()) == [(k + 1, k) for k in range(24)]
    assert graph.crawl(links, seed, rounds=2).count() == 3 and graph.crawl(links, seed, max_ids=3).count() == 3


def test_status_windows(spark):
    log = spark.createDataFrame([("k1", 1, "failed"), ("k1", 2, "success"), ("k1", 3, "failed"), ("k2", 4, "failed")], "k string, seq int, status string")
    keys = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "k string")
    latest = quality.status_report(keys, quality.latest_status(log, "k", "status", ["seq"]), "k")
    assert [r["status"] for r in latest.orderBy("k").collect()] == ["failed", "failed", "missing"]
    dom = quality.dominant_status(log.withColumn("r", F.lit("")), "k", F.col("status") == "success", F.col("r"), ["seq"])
    assert sorted(tuple(r) for r in dom.collect()) == [("k1", "success", None), ("k2", "failed", "unknown")]
    tries = quality.attempts(log, "k", F.col("status") == "success", ["seq"], 1)
    assert sorted(tuple(r) for r in tries.collect()) == [("k1", 1, True), ("k2", 1, True)]


def test_brackets(spark):
    rng = random.Random(3)
    ranges = [(p, lo, lo + rng.randrange(6)) for p, lo in enumerate(sorted(rng.sample(range(1, 90), 14)))]
    rng.shuffle(ranges)
    df = spark.createDataFrame(ranges, "page long, lo long, hi long")
    want = {}
    for idx in range(1, 100):
        prev = nxt = None
        for page, lo, hi in sorted(ranges, key=lambda r: r[1]):
            if hi < idx:
                prev = page
            elif lo > idx and nxt is None:
                nxt = page
                break
        want[idx] = (prev, nxt)
    for width in (7, 10_000):
        got = {r["idx"]: (r["prev_page"], r["next_page"]) for r in quality.bracket(spark.range(1, 100).toDF("idx"), df, width).collect()}
        assert got == want
    pages = quality.gap_pages(spark.createDataFrame([(1, 2, 5), (2, 4, 5), (3, None, 4)], "idx long, prev_page long, next_page long"))
    assert sorted(r["page"] for r in pages.collect()) == [3, 4]


def test_text_key_and_prefix(spark):
    docs = spark.createDataFrame([("d1", "abcdefghijklmnop", ["9", None, None]), ("d2", "short", [None]), ("d3", "zzzzzzzzzzzzzzzzzz", [None])], "doc_id string, text string, ids array<string>")
    blocks = spark.createDataFrame([("abcdefghijklmnop", ["9", "5", "12"]), ("zzzzzzzzzzzzzzzzzz", ["1"]), ("zzzzzzzzzzzzzzzzzz", ["2"])], "text string, ids array<string>")
    assert sorted(tuple(r) for r in resolve.match_text_key(docs, blocks).collect()) == [("d1", 1, "12"), ("d1", 2, "5")]


def test_rules(spark):
    """Ordered rules as data: context before default, pairs, a marked default, no rule."""
    rules = [("context", "سفيان", "الحميدي", "سفيان بن عيينة", 1, False), ("default", "سفيان", "", None, 9, True), ("pair", "أبيه", "سالم", "عبد الله بن عمر", 2, False), ("context", "هشام", "أبو أسامة", "هشام بن عروة", 1, False), ("default", "عبد الله", "", None, 9, True)]
    mentions = [("سفيان", "الحميدي"), ("أبيه", "سالم"), ("هشام", "أبو أسامة"), ("عبد الله", "x"), ("رجل", "x"), ("سفيان", "x"), (None, None), ("أبيه", None)]
    r = spark.createDataFrame(rules, "kind string, name string, pattern string, value string, priority int, ambiguous boolean")
    got = resolve.apply_rules(spark.createDataFrame(mentions, "name string, context string"), r)
    assert {(x["name"], x["context"]): (x["value"], x["status"]) for x in got.collect()} == {
        ("سفيان", "الحميدي"): ("سفيان بن عيينة", "resolved"), ("أبيه", "سالم"): ("عبد الله بن عمر", "resolved"), ("هشام", "أبو أسامة"): ("هشام بن عروة", "resolved"),
        ("عبد الله", "x"): (None, "ambiguous"), ("رجل", "x"): (None, "unresolved"), ("سفيان", "x"): (None, "ambiguous"), (None, None): (None, "unresolved"), ("أبيه", None): (None, "unresolved"),
    }
    share = resolve.context_coverage(got.withColumn("frequency", F.lit(2))).where("name = 'سفيان'").first()
    assert (share["pairs"], share["resolved_pairs"], share["mentions"], share["resolved_mentions"], share["percent"]) == (2, 1, 4, 2, 50.0)


def test_prefixes(spark):
    mk = lambda rows: spark.createDataFrame(rows, "key string, person_id string")
    variants = mk([("عايشه", "3026"), ("عايشه", "3027"), ("عايشه بنت سعد", "3027")])
    primary = mk([("سفيان بن عيينه", "7"), ("سفيان", "7"), ("سفيان", "8")])
    names = spark.createDataFrame([("عايشه بنت ابي بكر",), ("سفيان بن عيينه الكوفي",), ("مجهول",), ("",), (None,)], "key string")
    got = resolve.match_prefix(names, resolve.exact_lookup(primary), resolve.exact_lookup(variants), variants)
    assert {tuple(r) for r in got.collect()} == {("عايشه بنت ابي بكر", "3026", "عايشه"), ("سفيان بن عيينه الكوفي", "7", "سفيان بن عيينه")}


def test_first_occurrence(spark):
    rows = [("a", 2, 1, "x"), ("a", 1, 9, "y"), ("b", None, 3, "z"), ("b", 1, 1, None), ("a", 1, 8, None), (None, 5, 5, "n")]
    df = spark.createDataFrame(rows, "k string, p int, q int, v string")
    got = chains.first_occurrence(df, ["k"], ["p", "q"])
    assert got.columns == ["k", "p", "q", "v", "occurrence_count"]
    assert {tuple(r) for r in got.collect()} == {("a", 1, 8, None, 3), ("b", None, 3, "z", 2), (None, 5, 5, "n", 1)}
    export = chains.occurrence_export(spark.createDataFrame([(" a ", 2), ("a", 1), (" ", 0), (None, 0)], "name string, at int"), "name", ["at"])
    assert [tuple(r) for r in export.collect()] == [("a", 1, 2)]


def test_page_blocks_and_nested_documents(spark):
    blocks = spark.createDataFrame([("٧ - حَدَّثَ", 3), ("b", 4), (None, 5)], "t string, page int")
    assert [(r["number"], r["body"], r["plain"]) for r in chains.hadith_page(blocks, "t", "page").collect()] == [(7, "حَدَّثَ", "حدث"), (4, "b", "b"), (5, "", "")]
    rows = [(1, 1, 0, "L"), (1, 1, 1, "a"), (1, 2, 0, "M"), (1, 2, 1, "a"), (2, 1, 0, None)]
    d = {r["doc"]: r for r in chains.nested_documents(spark.createDataFrame(rows, "doc int, chain int, pos int, name string"), "doc", "chain", "pos", "name").collect()}
    assert (d[1]["n_chains"], d[1]["n_members"], d[1]["unique_names"]) == (2, 4, ["a", "L", "M"])
    assert [(c["chain_id"], c["names"]) for c in d[1]["chains"]] == [("chain_1", ["L", "a"]), ("chain_2", ["M", "a"])] and d[2]["n_members"] == 1


def test_state_tables(spark, tmp_path):
    from provena.operators.state import read_state, write_state

    for k in (1, 2):
        write_state(spark.createDataFrame([(k, "é")], "k int, v string"), f"{tmp_path}/state")
        assert [tuple(r) for r in read_state(spark, f"{tmp_path}/state").collect()] == [(k, "é")]


def test_numbered_rows(spark, tmp_path):
    """Numbers follow the file through all its splits."""
    (tmp_path / "n.txt").write_text("".join(f"line {k}\n" for k in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = readers.raw_lines(spark, f"{tmp_path}/n.txt", header=False)
        assert lines.rdd.getNumPartitions() > 3
        assert sorted(tuple(r) for r in lines.collect()) == [(k, f"line {k}") for k in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "none.txt").write_text("")
    assert readers.raw_lines(spark, f"{tmp_path}/none.txt").collect() == []
    (tmp_path / "c.csv").write_text("a,b\nx,1\ny,2\n")
    got = readers.csv_shape(spark, f"{tmp_path}/c.csv", {"a": "text"})
    assert got.columns == ["id", "text", "b"] and [tuple(r) for r in got.collect()] == [(1, "x", "1"), (2, "y", "2")]
    assert readers.csv_shape(spark, f"{tmp_path}/c.csv", {"_c0": "text", "_c1": "id"}, header=False).columns == ["text", "id"]


def test_numbered_rows_of_several_files(spark, tmp_path):
    """Files count on by name, whatever their sizes; each has its header, and one has nothing else."""
    (tmp_path / "t").mkdir()
    want = []
    for name, n in (("a", 3), ("b", 4000), ("c", 0), ("d", 900)):
        lines = [f"{name} {k}" for k in range(n)]
        want += lines
        (tmp_path / "t" / f"{name}.txt").write_text("\n \nhead\n" + "".join(f"{x}\n\n" for x in lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert sorted(tuple(r) for r in readers.raw_lines(spark, f"{tmp_path}/t").collect()) == list(enumerate(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "c").mkdir()
    for name, rows in (("1", "x,1\n"), ("2", "y,2\nz,3\n" * 50), ("3", "w,4\n")):
        (tmp_path / "c" / f"{name}.csv").write_text("a b,row_no\n" + rows)
    got = readers.csv_shape(spark, f"{tmp_path}/c", {}).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(k + 1, *r) for k, r in enumerate([("x", "1"), *[("y", "2"), ("z", "3")] * 50, ("w", "4")])]


def test_expected_numbers(spark):
    seen = spark.createDataFrame([(1,), (4,)], "k long")
    assert [r["k"] for r in quality.missing_in_range(seen, "k", 1).orderBy("k").collect()] == [2, 3]
    assert [r["k"] for r in quality.expected_range(seen, "k").orderBy("k").collect()] == [0, 1, 2, 3, 4]
    assert quality.missing_in_range(seen.limit(0), "k", 1).collect() == quality.expected_range(seen.limit(0), "k").collect() == []


def test_upserts(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "x"), (3, None)], "k int, v string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(sinks.upsert_keep(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, None)]
    once = sinks.upsert_replace(old, new, ["k"])
    assert rows(once) == [(1, "a"), (2, "x"), (3, None)] == rows(sinks.upsert_replace(once, new, ["k"]))
    part = spark.createDataFrame([(1, None, 5)], "k int, v string, w int")
    assert rows(sinks.upsert_fields(old, part, ["k"])) == [(1, "a", 5), (2, "b", None)]
    assert tuple(sinks.upsert_counts(old, new, ["k"]).first()) == (1, 1)
    assert rows(sinks.patch(old, spark.createDataFrame([(2, "p"), (9, "q")], "k int, plain string"), "k")) == [(1, "a", None), (2, "b", "p")]
    assert rows(sinks.resume(old, new, "k")) == [(1, "a")]


def test_scripts_and_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "o'x\ny")], "key string, text string")
    assert sinks.node_script(nodes, "Doc", ["key"], ["text"]).first()["value"] == "MERGE (n:Doc {key: 'a'}) SET n.text = 'o\\'x\\ny';"
    tables = {"nodes": nodes, "edges": spark.createDataFrame([("a", "b", 2)], "src string, dst string, n long")}
    sinks.write_graph(tables, f"{tmp_path}/g")
    back = sinks.read_graph(spark, f"{tmp_path}/g")
    assert {n: [tuple(r) for r in df.collect()] for n, df in back.items()} == {n: [tuple(r) for r in df.collect()] for n, df in tables.items()}
    sinks.write_csv(spark.createDataFrame([("x", ["p", "q"])], "a string, b array<string>"), f"{tmp_path}/c", bom=True)
    text = max((tmp_path / "c").glob("part-*"), key=lambda f: f.stat().st_size).read_text()  # the others hold a header
    assert text == '﻿"a","b"\n"x","p\nq"\n' or text == '"﻿a","b"\n"x","p\nq"\n'


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "narrators": []}, {"id": 2}]))
    (tmp_path / "o.json").write_text("{}")
    assert readers.json_array(spark, f"{tmp_path}/a.json", "id int").count() == 2
    with pytest.raises(ValueError):
        readers.json_array(spark, f"{tmp_path}/o.json", "id int")
    assert readers.detect_format(spark, f"{tmp_path}/a.json") == "result" and readers.format_of({"chains", "x"}) == "chains"
    with pytest.raises(ValueError):
        readers.format_of({"x"})
    (tmp_path / "l.jsonl").write_text('{"status":"success","k":1}\nbad\n\n{"status":"failed","k":2}\n')
    schema = "status string, k int"
    assert [r["k"] for r in readers.jsonl(spark, f"{tmp_path}/l.jsonl", schema, success=True).collect()] == [1]
    counted = readers.jsonl(spark, f"{tmp_path}/l.jsonl", schema, "count")
    assert tuple(readers.kept_and_skipped(counted).first()) == (2, 1)
    with pytest.raises(Exception):
        readers.jsonl(spark, f"{tmp_path}/l.jsonl", schema, "strict").collect()
    (tmp_path / "m.json").write_text(json.dumps({"_comment": ["x"], "1": ["a", "b"]}))
    assert [tuple(r) for r in readers.json_map(spark, f"{tmp_path}/m.json").collect()] == [("1", ["a", "b"])]
    assert readers.json_map(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "t.csv").write_text('id,hadith_id,text_ar\n1,5,"a ""q"", b"\n2,x,\n3,7, c \n')
    assert [r["text"] for r in readers.csv_text(spark, f"{tmp_path}/t.csv", "text_ar").collect()] == ['a "q", b', "c"]
    with pytest.raises(ValueError):
        readers.csv_text(spark, f"{tmp_path}/t.csv", "nope")
    (tmp_path / "s.csv").write_text("hadith_index,hadith_text\n7,a\nx,b\n9,\n")
    assert [tuple(r) for r in readers.csv_sniffed(spark, f"{tmp_path}/s.csv").collect()] == [(7, "a"), (2, "b"), (9, "9")]
    assert [tuple(r) for r in readers.raw_lines(spark, f"{tmp_path}/s.csv").collect()] == [(0, "7,a"), (1, "x,b"), (2, "9,")]
    (tmp_path / "ids.txt").write_text("person 12 x\nnone\n7\n")
    assert [r["id"] for r in readers.id_lines(spark, f"{tmp_path}/ids.txt").collect()] == [12, 7]
    assert readers.first_existing(spark, [f"{tmp_path}/zz", f"{tmp_path}/ids.txt"]).endswith("ids.txt")
    names = spark.createDataFrame([("/x/bukhari_hadiths.json",), ("muslim.json",), ("results.json",), ("narrator_chains_x.json",)], "p string")
    assert [r[0] for r in names.select(readers.source_of_file(F.col("p"))).collect()] == ["bukhari", "muslim", None, "narrator"]
    bios = spark.createDataFrame([("1", ": old", 1), ("1", ": new", 2), ("2", "", 1)], "person_id string, name string, seq int")
    assert sorted((r["person_id"], r["name"]) for r in readers.biographies(bios, "seq").collect()) == [("1", "new"), ("2", None)]


def test_html_fields(spark):
    page = '<ol class="breadcrumb"><a href="/">H</a><a href="/book/1/2">B</a></ol><input type="hidden" name="n" value="42"><p>x <span class="c2">m&amp;n</span> <a href="/narrator/5">P</a></p><dl><dt>Name:</dt><dd>N</dd><dt>Name</dt><dd>O</dd></dl><h1>T</h1><h2>S1</h2><ul><li>q</li></ul><h2>S2</h2><p>r</p>'
    df = spark.createDataFrame([(page,), (None,)], "html string")
    h = F.col("html")
    r = df.select(html.hidden_number(h, "n").alias("n"), html.breadcrumbs(h).alias("b"), html.text_blocks(h).alias("t")).first()
    assert r["n"] == 42 and [x["href"] for x in r["b"]] == ["/", "/book/1/2"]
    assert (r["t"][0]["matn"], r["t"][0]["full_text"], r["t"][0]["narrators"][0]["id"]) == ("m&n", "x m&n P", "5")
    p = html.person_page(df).collect()
    assert p[0]["name"] == "T" and p[0]["fields"] == {"Name": "N"} and [(s["heading"], s["items"]) for s in p[0]["sections"]] == [("S1", ["q"]), ("S2", ["r"])]
    assert p[1]["name"] == "" and p[1]["hrefs"] == []


def test_search(spark):
    docs = spark.createDataFrame([(1, "red fox", "x"), (2, "blue fox fox", "y"), (3, None, "z")], "id int, a string, b string")
    got = {r["id"]: (r["score"], r["matched"]) for r in search.bm25(docs, "Fox, blue!", "id", ["a", "b"]).collect()}
    assert set(got) == {1, 2} and got[2][0] > got[1][0] and got[2][1] == 2
    twice = {(r["id"], round(r["score"], 9)) for r in search.bm25(docs.union(docs), "fox", "id", ["a", "b"]).collect()}
    assert len(twice) == 2 and search.bm25(docs, "?!", "id", ["a"]).collect() == [] and search.bm25(docs.limit(0), "fox", "id", ["a"]).collect() == []
    todo = search.backlog(docs, spark.createDataFrame([(1,)], "id int"), "id")
    assert sorted(r["id"] for r in todo.collect()) == [2, 3]


def test_streamed_status(spark, tmp_path):
    from provena.streaming import status

    log, target, schema = tmp_path / "log", f"{tmp_path}/t", "k string, status string, seq long"
    log.mkdir()
    (log / "1.json").write_text('{"k":"a","status":"failed","seq":1}\n{"k":"b","status":"failed","seq":2}\n')
    status.keep_latest(status.read_log(spark, str(log), schema), "k", "status", "seq", target, f"{tmp_path}/c").awaitTermination()
    (log / "2.json").write_text('{"k":"a","status":"success","seq":3}\n')
    status.keep_latest(status.read_log(spark, str(log), schema), "k", "status", "seq", target, f"{tmp_path}/c").awaitTermination()
    assert sorted((r["k"], r["status"]) for r in status.current(spark, target).collect()) == [("a", "success"), ("b", "failed")]
