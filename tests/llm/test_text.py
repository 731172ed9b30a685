"""Decontamination, token files, BPE, chat and main text, against plain versions."""

import hashlib
import os
import random
import re
import subprocess
import sys
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from provena.llm import bpe, chat, decontaminate, main_text, token_files
from provena.llm.common import flat, scratch, table
from pyspark.sql import functions as F

ODD = [None, "", "a  b", " a", "  ", "a \n b", "x 　y é  ü", "don't 'S aren't", "aaaaa" * 900, "12 345  6", "…. »,", "日本 語", "a\u0085 b", "\x1c. a\x1f b", "<|endoftext|> x", "İstanbul K ΟΔΟΣ ǆ", "x́.y É́", "z " * 10 + "\n\n q"]


def plain_words(text):
    out, word = [], b""
    for c in (text or "").encode():
        if 65 <= c <= 90:
            c += 32
        if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128:
            word += bytes([c])
        else:
            out += [word] if word else []
            word = b""
    return out + ([word] if word else [])


def plain_hits(text, items, window=13):
    w = plain_words(text)
    hit, found = [False] * len(w), set()
    for i, t in items:
        v = plain_words(t)
        n = min(window, len(v))
        for k in range(len(v) - n + 1) if v else ():
            for a in range(len(w) - n + 1):
                if w[a : a + n] == v[k : k + n]:
                    hit[a : a + n] = [True] * n
                    found.add(str(i))
    return len(w), sum(hit), sorted(found)


def test_decontamination(spark):
    rng = random.Random(1)
    words = ["alpha", "Bêta", "gamma", "d9", "E"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(10, text(20)), (9, text(13)), (100, text(5)), (3, "alpha"), (4, None), (5, "..."), (10, "x y z")]
    texts = [None, "", "...", "alpha", text(40) + items[0][1] + text(10), items[1][1], "x Y z", *[text(60) for _ in range(30)]]
    docs = spark.createDataFrame([(k, t, "i") for k, t in enumerate(texts)] + [(5, texts[5], "i")], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_NODES, 60):  # one automaton, and several, that share an item's windows
        got = decontaminate.decontaminate(docs, bench, block_nodes=block).collect()
        assert len(got) == len(texts) + 1
        for r in got:
            n, hit, found = plain_hits(texts[r["doc_id"]], items)
            assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, found)
            assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
            data = (texts[r["doc_id"]] or "").encode()
            assert sum(len(plain_words(data[s["start"] : s["end"]].decode())) for s in r["spans"]) == hit
    clash = docs.withColumns({c: F.lit(3) for c in ("n_words", "n_hit", "spans", "contaminated", "row", "d", "runs")})
    whole = decontaminate.decontaminate(clash, bench, whole=True)
    assert whole.select("row.*").columns == clash.columns and whole.where("contaminated").count() == sum(r["contaminated"] for r in got)
    assert decontaminate.decontaminate(docs.limit(0), bench).collect() == []
    assert all(r["n_hit"] == 0 for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


def test_an_automaton_of_full_size_fits_a_worker():
    """As many windows as a block takes, of words of two digits: nodes, and memory of the process that holds it."""
    code = """
import random
from provena.llm import decontaminate as d
rng = random.Random(1)
w = [str(rng.randrange(16000)).encode() for _ in range(d.BLOCK_NODES // 26 + 12)]
patterns = [(b" ".join(w[k : k + 13]), 13, ["i"]) for k in range(len(w) - 12)]
rss = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
before = rss()
m = d.Matcher(patterns)
print(m.digits, m.automaton.get_stats()["nodes_count"], (rss() - before) >> 20)
assert m.scan(b"x, " + b"-".join(w[5:25]))[:2] == (21, [(k, 13) for k in range(1, 9)])
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ, check=True).stdout.split()
    assert int(out[0]) == 2 and int(out[1]) <= decontaminate.BLOCK_NODES and int(out[2]) < 400, out


@pytest.fixture(scope="module")
def public():
    return pytest.importorskip("public_tokenizers")


def texts_of(sf, n=120):
    import duckdb

    return [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet' ORDER BY doc_id LIMIT {n}").fetchall()]


def test_bpe_equals_the_library(public, sf):
    import base64

    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ODD + texts_of(sf)
    codec = bpe.Codec(path, public.PATTERN)
    ids, ends = codec.encode(*flat(pa.array(texts, pa.string())))
    for k, t in enumerate(texts):
        own = ids[ends[k] : ends[k + 1]]
        assert own.tolist() == lib.encode_ordinary(t or "")
        assert codec.decode(own) == (t or "").encode()


def test_bpe_of_long_pieces(public):
    """Unbroken runs: the heap gives what the matrix gives, and a megabyte takes seconds."""
    ranks = bpe.codec(public.path("byte_bpe_50k.tiktoken"), public.PATTERN).ranks
    rng = random.Random(4)
    for alphabet in ("ab", "etaoin shrdlu".replace(" ", ""), "aé漢"):
        pieces = ["".join(rng.choice(alphabet) for _ in range(n)).encode() for n in (2, 3, 17, 200, 1500)]
        for p in pieces:
            m = ranks.byte_id[np.frombuffer(p, dtype=np.uint8)][None, :].copy()
            assert bpe._merge_long(p, ranks).tolist() == bpe._merge(m, np.array([len(p)]), ranks)[0].tolist()
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(1 << 20)).encode()
    codec = bpe.codec(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    began = time.time()
    ids, _ = codec.encode(np.frombuffer(long, dtype=np.uint8), np.array([0, len(long)]))
    assert codec.decode(ids) == long and time.time() - began < 60


def test_bpe_query_and_frames(public, spark, sf):
    path = public.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(ODD)] + [(3, ODD[3], 1), (None, "q", 1)], "doc_id long, text string, d int")
    coded = bpe.encode(docs, path, public.PATTERN)
    back = sorted((r["doc_id"] or -1, bytes(r["bytes"])) for r in bpe.decode(coded, path, public.PATTERN).collect())
    assert back == sorted((r["doc_id"] or -1, (r["text"] or "").encode()) for r in docs.collect())
    trip = {r["doc_id"]: r for r in bpe.round_trip(docs, path, public.PATTERN).collect()}
    for r in coded.collect():
        t = trip[r["doc_id"]]
        assert t["n_tokens"] == len(r["ids"]) and t["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
    for k, t in enumerate(ODD):
        assert trip[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), path, public.PATTERN).collect() == []


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000, 50_000):
        for high in (1, 2, 20, 300, 40_000, 2**32 - 1):
            ids = rng.integers(0, high, n, dtype=np.uint32) if high > 1 else np.zeros(n, np.uint32)
            if n > 500:
                ids[20:400] = 0
            r = token_files.Record(token_files.record(np.array([7]), np.array([n]), ids))
            assert (r.ids() == ids).all() and r.doc_ids.tolist() == [7]
            for a, b in ((0, 3), (n // 3, n // 2), (max(0, n - 5), n)):
                assert (r.ids(a, b) == ids[a:b]).all()
    zeros = np.zeros(240_000, np.uint32)
    assert len(token_files.record(np.array([1]), np.array([len(zeros)]), zeros)) < 9000


def test_token_files(public, spark, sf):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    texts = ODD + texts_of(sf, 80)
    docs = spark.createDataFrame([((k * 7) % 101, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, b string").repartition(3)
    folder = scratch(spark, "test-tokens")
    token_files.write(docs, folder, path)
    want, start = {}, 0
    for i, t in sorted(((k * 7) % 101, t) for k, t in enumerate(texts)):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.index(spark, folder).collect()} == want
    assert {r["doc_id"]: len(r["ids"]) for r in token_files.read(spark, folder).collect()} == {i: v[1] for i, v in want.items()}
    twice = spark.createDataFrame([(None, "b"), (4, "a"), (4, "a"), (4, None)], "doc_id long, text string")
    folder = scratch(spark, "test-tokens")
    token_files.write(twice, folder, path)
    assert sorted((r["doc_id"] or -1, r["start"], r["n_tokens"]) for r in token_files.index(spark, folder).collect()) == [(-1, 0, 2), (4, 2, 1), (4, 3, 2), (4, 5, 2)]
    # one id may hold nearly all rows: their files still follow the texts' order
    hot = [(None if k % 9 else k, f"{(k * 37) % 400:03d} " + "word " * (k % 5)) for k in range(400)]
    folder = scratch(spark, "test-tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write(spark.createDataFrame(hot, "doc_id long, text string").repartition(3), folder, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert token_files._files(spark, folder).where("length(content) > 2000").count() > 1
    start, want = 0, []
    for i, t in sorted(hot, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        n = len(lib.encode(t, add_special_tokens=False).ids) + 1
        want.append((start, i, n))
        start += n
    assert sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.index(spark, folder).collect()) == want
    folder = scratch(spark, "test-tokens")
    token_files.write(twice.limit(0), folder, path)
    assert token_files.index(spark, folder).collect() == []


CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ANS]", "[TURN]", "[/TURN]", "[IS]"]


def test_chat_round_trip(spark):
    rng = random.Random(4)
    bits = [*CONTROLS, "\\", "<\\s>", "[\\\\INST]", "<", "[", "]", ">", " ", "\n", "é😀", "ok", "s>", "/s>", "INST]"]
    rows = []
    for conv in range(25):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", "[IS] x", None])
            rows.append((conv, turn, role, rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randrange(8)))]), "z"))
    rows += [(None, 1, "user", "no id", "z"), (None, 2, "assistant", "still", "z"), (3, None, "user", "first", "z"), (5, 0, "user", "twin", "z"), (5, 0, "user", "twin", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string")
    done = chat.conversations(df)
    got = {r["conv_id"]: r for r in chat.digests(done).collect()}
    formatted = {r["conv_id"]: r for r in done.collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "") for r in rows if r[0] == conv))
        turns = [(r[3], r[5]) for r in own]
        said = "".join(f"{a}\n{b}\n" for a, b in turns)
        loss = "".join(b for a, b in turns if a == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        text = formatted[conv]["formatted"]
        assert r["formatted_chars"] == len(text)
        marks = re.findall(r"<s>|</s>|\[/?(?:SYS|INST|ANS|TURN)\]|\[IS\]", text)
        kinds = [a for a, _ in turns]
        assert len(marks) == 1 + sum(2 if k in ("user", "assistant", "system") else 3 for k in kinds)
    assert chat.conversations(df.limit(0)).collect() == []


def test_reply_trees(spark):
    """All root-to-leaf paths, ranked by score, against a walk."""
    rng = random.Random(8)
    rows, want = [], {}
    for tree in (1, 2, None):
        parent, score = {}, {}
        for n in range(1, 40):
            parent[n] = None if n == 1 else 999 if n == 2 else rng.randrange(max(1, n - 4), n)
            score[n] = float(rng.randrange(5))
            rows.append((tree, n, parent[n], score[n], "user", f"m{n}"))
        found = []
        for leaf in parent:
            if leaf in parent.values():
                continue
            path, n = [], leaf
            while n in parent:
                path.append(n)
                n = parent[n]
            found.append((-sum(score[x] for x in path), leaf, path[::-1]))
        want[tree] = [(leaf, path) for _, leaf, path in sorted(found)][:3]
    m = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    p = chat.paths(m, tree="tree", node="node", parent="parent", score="score", best=3)
    got = {}
    for r in p.orderBy("rank", "depth").collect():
        got.setdefault(r["tree"], {}).setdefault((r["rank"], r["leaf"]), []).append(r["node"])
    for tree, ranked in want.items():
        assert [(leaf, path) for (_, leaf), path in sorted(got[tree].items())] == ranked
    texts = chat.format_paths(p, m, tree="tree", node="node").where("rank = 1 AND tree = 1").first()
    assert texts["formatted"] == "<s>\n" + "\n".join(f"[INST] m{n} [/INST]" for n in want[1][0][1])


def test_chat_plan_is_native(spark, sf):
    plan = chat.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p>";</script></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div class="cookie-notice">We use</div>
<article class="post ad-free"><header><h1>Ti&amp;tle</h1></header><p>One <b>two<br>three<p>Four&nbsp;five &lt;x&gt; <!-- no --><div class="ad">Buy</div><ul><li>i<li>ii</ul>
<table><tr><td>c1<td>c2</table><form><input name=q>Go</form><p hidden>gone</p><pre> a
  b</pre><section class="comments"><article>Nice</article></section></article><aside>side</aside><div id="footer">foot</div></body></html>"""


def test_blocks_of_a_page():
    kept = [t for t, article, outside in main_text.blocks(PAGE) if article and not outside]
    assert kept == ["Ti&tle", "One two three", "Four five <x>", "i", "ii", "c1", "c2", "a b"]
    for broken in ("", "<", "<p", "a<b", "<script>x", "<!-- x", "<p><nav>x<article>y", "</p></div>", "<a href='x>y"):
        main_text.blocks(broken)
    assert [t for t, a, o in main_text.blocks("<nav>x<article>y") if a and not o] == ["y"]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        kept = [x for x, k in zip(a, main_text.common_subsequence(a, b)) if k]
        rest = iter(b)
        assert len(kept) == best[-1][-1] and all(x in rest for x in kept)


def test_common_subsequence_of_long_lists():
    b = list(range(9000))
    assert main_text.common_subsequence(b[3000:] + b[:3000], b) == [True] * 6000 + [False] * 3000
    assert sum(main_text.common_subsequence([1, 2] * 5000, [2, 1] * 4000)) == 8000
    assert sum(main_text.common_subsequence(b, b[8000:] + b[:500])) == 1000


def test_common_subsequence_rows_made_again(monkeypatch):
    """The same answer whether all bit rows are held or made again."""
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(40))] for _ in range(2))
        whole = main_text.common_subsequence(a, b)
        with monkeypatch.context() as m:
            m.setattr(main_text, "ALIGN", 3)
            assert main_text.common_subsequence(a, b) == whole


def test_common_subsequence_of_near_copies():
    """Two long articles that differ in one line take no time."""
    began, n = time.time(), 400_000
    a = list(range(n))
    b = [*a[: n // 2], -1, *a[n // 2 + 1 :]]
    assert main_text.common_subsequence(a, b) == [i != n // 2 for i in range(n)] and time.time() - began < 30
    assert main_text.common_subsequence([1, 1], [1]) == [True, False] and main_text.common_subsequence([1], []) == [False]


def test_page_differencing(spark):
    plain = lambda own, menu="Home": f"<div>{menu}</div><p>{own}</p><div>Imprint</div>"
    rows = [(1, "http://h/x/1", plain("one")), (2, "http://h/x/2", plain("two")), (3, "http://h/y/1", plain("three", "Other")), (4, "http://k/1", plain("alone")), (5, None, plain("none")), (6, "http://h/x/2", None), (7, "http://k/2", PAGE), (1, "http://h/x/1", plain("one"))]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, near int")
    got = sorted((r["page_id"], r["text"]) for r in main_text.extract(pages).collect())
    article = "Ti&tle\nOne two three\nFour five <x>\ni\nii\nc1\nc2\na b"
    assert got == [(1, "one"), (1, "one"), (2, "two"), (3, "Other\nthree"), (4, "Home\nalone\nImprint"), (5, "Home\nnone\nImprint"), (6, ""), (7, article)]
    assert main_text.extract(pages.limit(0)).collect() == []


def test_very_long_pages():
    """Megabytes of paragraphs, of open elements and of closing tags that match nothing take seconds."""
    began = time.time()
    page = "<article>" + "".join(f"<p>line {k}" for k in range(150_000)) + "</article>"
    assert [x[0] for x in main_text.blocks(page)] == [f"line {k}" for k in range(150_000)]
    page = "<b>x" * 100_000 + "</i>" * 100_000 + "<hr>" * 50_000 + "</p>" + "y" * 3_000_000
    assert "".join(x[0] for x in main_text.blocks(page)) == "x" * 100_000 + "y" * 3_000_000
    assert main_text.blocks("<div " * 200_000 + "<!-- x")[0][0] == " ".join(["<div"] * 200_000) and time.time() - began < 60


def test_differencing_against_brute_force(spark):
    """Pages without an article: the nearest URL of the host, one longest common subsequence, and its lines deleted."""
    rng = random.Random(6)
    pages = []
    for k in range(120):
        host, path = rng.choice(["a.example", "b.example"]), "/" + "/".join(rng.choice(["x", "y", "zz"]) for _ in range(rng.randrange(1, 3))) + rng.choice(["", "/1", "/2"])
        lines = rng.sample([f"line {w}" for w in range(40)], rng.randrange(0, 25))
        if rng.random() < 0.5:
            lines.sort()
        pages.append((k, f"http://{host}{path}?{rng.randrange(3)}", "".join(f"<div>{x}</div>" for x in lines), host, path, lines))
    pages += [(200, *pages[0][1:]), (201, *pages[1][1:])]
    got = {r["page_id"]: r["text"].split("\n") if r["text"] else [] for r in main_text.extract(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")).collect()}
    order = sorted({(h, p, hashlib.md5(f"{u}\n{t}".encode()).digest(), t, tuple(x)) for _, u, t, h, p, x in pages if x})
    start = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for k, url, page, host, path, lines in pages:
        if not lines:
            assert got[k] == []
            continue
        at = order.index((host, path, hashlib.md5(f"{url}\n{page}".encode()).digest(), page, tuple(lines)))
        near = [order[i] if 0 <= i < len(order) and order[i][0] == host else None for i in (at - 1, at + 1)]
        other = near[0] if near[0] and (not near[1] or start(path, near[0][1]) >= start(path, near[1][1])) else near[1]
        other = list(other[4]) if other and other[3] != page else []
        best = np.zeros((len(lines) + 1, len(other) + 1), dtype=int)
        for i, x in enumerate(lines):
            for j, y in enumerate(other):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        gone, it = [x for x in lines if x not in got[k]], iter(other)
        assert got[k] == [x for x in lines if x not in gone] and len(gone) == best[-1, -1] and all(x in it for x in gone)


def test_differencing_inside_articles(spark):
    """Every page is differenced: what most articles of a host share goes, also a whole promoted article; what few share and reprints stay."""
    def page(k, body, promoted="<article><p>Read our shop</p></article>"):
        return f"<nav>Menu {k}</nav><article><h1>Title {k}</h1><p>{body}</p><p>We are hiring</p></article>{promoted}"

    long = "A reprinted text of many words that stands in several articles of the host"
    rows = [(k, f"http://h/n/{k}", page(k, f"own text {k} of the article")) for k in range(10, 16)]
    rows += [(20, "http://h/q/1", page(20, "The.</p><p>own words 20 of it")), (21, "http://h/q/2", page(21, "The.</p><p>own words 21 of it"))]
    rows += [(30 + k, f"http://h/r/{k}", f"<nav>{k}</nav><article><p>{long}</p><p>{k}</p></article>") for k in range(20)]  # one article, other menus
    rows += [(60 + k, f"http://two/{k}", page(k, f"own text {k}")) for k in range(2)]  # too few articles to say
    rows += [(70 + k, f"http://only/{k}", f"<article><p>Read our shop now or never</p></article><div>Menu</div><div>text {k}</div>") for k in range(4)]  # half of an article and more: no votes
    got = {r["page_id"]: r["text"].split("\n") for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(10, 16)] == [[f"Title {k}", f"own text {k} of the article"] for k in range(10, 16)]
    assert [got[k] for k in (20, 21)] == [[f"Title {k}", "The.", f"own words {k} of it"] for k in (20, 21)]
    assert [got[30 + k] for k in range(20)] == [[long, str(k)] for k in range(20)]
    assert [got[60 + k] for k in range(2)] == [[f"Title {k}", f"own text {k}", "We are hiring", "Read our shop"] for k in range(2)]
    assert all(got[70 + k] == ["Read our shop now or never"] for k in range(4))


def test_nearest_page_has_other_lines(spark):
    """Copies of a page are not its neighbours, however many partitions they fill; marked pages look for one, too."""
    rng, rows = random.Random(9), []
    kinds = ["<p>a</p><p>b</p>", "<article>c</article><p>b</p>", "<main>d</main><p>b</p>"]
    for k in range(400):
        host = rng.choice(["a", "b", "c"])
        kind = {"a": rng.choice(kinds), "b": kinds[0] if rng.random() < 0.98 else kinds[1], "c": kinds[2]}[host]
        rows.append((bytes([k >> 8, k & 255]), f"http://{host}/{rng.choice('xyz')}/{rng.randrange(90)}", kind))
    near = main_text.neighbours(spark.createDataFrame(rows, "uid binary, url string, html string"), main_text.Steps(spark)).collect()
    got = {bytes(r["uid"]): r["near"] for r in near}
    order = sorted((u.split("/")[2], u.split("/", 3)[3], i, main_text._hashes(main_text.blocks(h))) for i, u, h in rows)
    start = lambda a, b: len(os.path.commonprefix([a, b]))
    for at, (host, path, uid, lines) in enumerate(order):
        beside = [next((x for x in way if x[0] != host or x[3] != lines), None) for way in (order[:at][::-1], order[at + 1 :])]
        a, b = (x if x and x[0] == host else None for x in beside)
        best = a if a and (not b or start(path, a[1]) >= start(path, b[1])) else b
        assert got[uid] == (best[3] if best else None)
    rows = [(k, f"http://h/{k:03}", "<div>Menu</div><p>text</p>") for k in range(50)] + [(50, "http://h/050", "<div>Menu</div><p>other</p>")]
    assert {r["text"] for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"text", "other"}


def test_main_text_among_teasers_and_marks():
    def kept(page):
        return main_text.article_lines(main_text.blocks(page))

    for part in ("aside", "nav", "header", "footer"):
        assert kept(f"<article>Main</article><{part}><article>teaser</article></{part}>") == ["Main"]
        assert kept(f"<{part}><article>teaser</article></{part}><article>Main</article>") == ["Main"]
        assert kept(f"<{part}>left open<article>Main</article>") == ["Main"]
        assert kept(f"<{part}>left open<article>Main</article><{part}>x</{part}>") == ["Main"]
    page = '<article><p class="share-price">a</p><h2 id="related-work">b</h2><p id="search">c</p><div class="notice-board">d</div><div class="share-buttons">e</div><div class="Related">f</div><div id="comments">g</div><p class="ad">h</p></article>'
    assert kept(page) == ["a", "b", "c", "d"]
    assert kept('<article><p class="share-price">only</p></article>') == ["only"]
    assert kept("<main><ul><li>Menu</li></ul><article>Main</article>more menu</main>") == ["Main"]
    assert kept("<main>Main</main><p>other</p>") == ["Main"] and kept("<div>x</div>") is None


def test_main_text_of_the_pages(spark, sf):
    """The generator's pages: what stands in the article element, block by block."""
    import html

    got = {r["page_id"]: r["text"] for r in main_text.query(spark, sf).collect()}
    for r in table(spark, sf, "pages").collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner))
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)
