"""Quality by held-out accuracy and a plain scorer, spelling variants and fill-in-middle by brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from provena.llm import fim, quality, spelling
from provena.llm.common import flat, table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
ODD = ["", " ", "\n\t ", "a", " a", "a ", " a b c  ", "é\tü\x0bß", "<P> no", "x <M>", "<S", "a<", "P> b <", " wide \U0001f600 pairs\r\n", "w " * 4000, "y" * 100_000, " " * 5000, "tail   ", "\x00 nul \x1c", "m<P" + ">x"]


def plain_fim(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, d = len(tokens), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return n, form, *((None, None) if form == "plain" else (len(p), len(m))), out


def test_rank_and_select():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 511, 512, 513, 5000):
        for share in (0.0, 0.01, 0.5, 1.0):
            b = rng.random(size) < share
            bits = fim.Bits(b)
            assert (bits.rank(np.arange(size + 1)) == np.concatenate([[0], np.cumsum(b)])).all()
            assert (bits.select(np.arange(b.sum())) == np.flatnonzero(b)).all()


def test_fill_in_middle_against_plain_python(spark):
    rows = [(k, t, "extra", "x") for k, t in enumerate(ODD * 6)] + [(5, "repeated id", None, None), (5, "repeated id", None, None), (None, "no id here", None, None), (7, None, None, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form string, row string")
    got = fim.transform(docs, whole=True).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == Counter((d, *plain_fim(d, t)) for d, t, _, _ in rows)
    assert Counter(tuple(r["row"]) for r in got) == Counter(rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert all(fim.restore(r["output"].encode(), r["form"]).decode() == (r["row"]["text"] or "") for r in got)
    empty = fim.transform(docs.limit(0), digests=True)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    for r in fim.transform(docs, digests=True).collect():
        assert len(r["output_sha256"]) == 64


def test_every_text_of_a_high_rate_comes_back():
    for text in ODD:
        data = text.encode()
        buf, offsets = flat(pa.array([text, None, text + "z"], pa.string()))
        for seed in range(20):
            n, a, b = fim.cuts(buf, offsets, fim.draw([1, 2, 3], seed))
            assert n[0] == plain_fim(1, text)[0] and n[1] == 0
            if not any(m in data for m in (fim.PREFIX, fim.SUFFIX, fim.MIDDLE)):
                for form in ("psm", "spm"):
                    whole = buf.tobytes()
                    assert fim.restore(fim.assemble(whole[: a[0]], whole[a[0] : b[0]], whole[b[0] : offsets[1]], form), form) == data


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_vocabulary(rows, least=6, often=5):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= least and n >= often}


def plain_variants(words):
    out = {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        out[w] = [best if best and words[best] >= 5 * n else None, None, n, len(others), None]
    for w in out:
        at = w
        while out[at][0]:
            at = out[at][0]
        out[w][1] = at
        out[w][4] = words[out[w][0]] if out[w][0] else None
    return {(w, *v) for w, v in out.items()}


def spelled(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_variants_against_brute_force(spark):
    rng = np.random.default_rng(3)
    stems = ["anagram", "nagaram", "Straße", "été même", "ÀÉÎÕÜ×÷xyz", "letters", "lettres", "öffnung"]
    words = []
    for k in range(9000):
        w = stems[int(rng.integers(len(stems)))]
        for _ in range(int(rng.integers(3)) if k % 3 else 0):
            at, c = int(rng.integers(len(w))), "abéÿ"[int(rng.integers(4))]
            w = [w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]][int(rng.integers(3))]
        words.append(w)
    rows = [(k, " ".join(words[k * 90 : k * 90 + 90])) for k in range(100)] + [(None, "letters-letters1letters"), (4, None), (5, ""), (6, "z" * 30_000), (7, "abcdef" * 10)] + [(8, "Lettersx lettersx")] * 4
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    vocabulary = plain_vocabulary(rows)
    assert len(vocabulary) > 40
    got = spelled(spelling.group(docs))
    assert got == plain_variants(vocabulary)
    assert any(r[1] for r in got) and any(r[3] and not r[1] for r in got)
    assert spelled(spelling.group(docs.limit(0))) == set() and spelled(spelling.group(docs.where("text = ''"))) == set()


def test_chains_of_forms_and_ties(spark):
    words = {"kettle": 1000, "kettles": 200, "kettlesx": 40, "kettlesxy": 8, "ketule": 0, "bottle": 5, "bettle": 25, "cottle": 25, "bottla": 4}
    words = {w: n for w, n in words.items() if n}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {r[0]: r for r in spelled(spelling.variants(df))}
    assert {tuple(r) for r in got.values()} == plain_variants(words)
    assert got["kettlesxy"][2] == "kettle" and got["bottle"][1] == "bettle"


def test_crowded_anagram_lists_lose_no_pair(spark):
    """Words of the same few letters share one list, whatever their order; splitting it by halves keeps all near pairs."""
    rng = np.random.default_rng(4)
    words = {"".join(rng.permutation(list("aabbcd"))) for _ in range(150)} | {"".join(rng.permutation(list("aabbce"))) for _ in range(150)} | {"".join(rng.permutation(list("aabbcde"))) for _ in range(80)}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    want = {frozenset((a, b)) for a in words for b in words if near(a, b)}
    for hot in (1, 10, 1000):
        got = [frozenset(r) for r in spelling.near_pairs(df, hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_crc32_of_pieces():
    rng = np.random.default_rng(5)
    buf = rng.integers(0, 256, 3000).astype(np.uint8)
    starts = rng.integers(0, 2900, 200)
    ends = starts + rng.integers(0, 100, 200)
    first = np.array([zlib.crc32(str(k).encode()) for k in range(200)], dtype=np.uint32)
    assert [int(x) for x in spelling.crc32s(buf, starts, ends, first)] == [zlib.crc32(buf[a:b].tobytes(), int(f)) for a, b, f in zip(starts, ends, first, strict=True)]


def plain_features(text):
    """FEATURES that a few lines of Python can count."""
    b = (text or "").encode()
    words = re.split(rb"[ \t\n\v\f\r]+", b.strip(b" \t\n\v\f\r")) if b.strip(b" \t\n\v\f\r") else []
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    n = max(len(words), 1)
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122
    odd = lambda c: 32 < c < 127 and not letter(c) and not 48 <= c <= 57 and chr(c) not in ".,;:'\"-()?"
    lines = [x for x in b.split(b"\n") if x]
    return {
        "words": np.log1p(len(words)), "word_bytes": sum(map(len, words)) / n, "line_words": np.log1p(len(words) / len(lines)) if lines else 0.0,
        "upper": sum(65 <= c <= 90 for c in b) / max(sum(map(letter, b)), 1), "marks": sum(map(odd, b)) / n, "marked_words": sum(odd(w[-1]) for w in words) / n,
        "repeated_words": sum(x == y for x, y in zip(low, low[1:], strict=False)) / n, "distinct_words": len(set(low)) / n,
        "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0, "bars": b.count(b"|") / n, "high_bytes": sum(c >= 128 for c in b) / max(len(b), 1),
        "upper_words": sum(len(w) > 1 and sum(65 <= c <= 90 for c in w) > sum(97 <= c <= 122 for c in w) for w in words) / n,
    }


def test_features_against_plain_python(spark):
    texts = [None, *ODD, "One two two. THREE!! four| #$", "a\na\nb\n\n\nb", "É É é"] + [r["text"] for r in table(spark, SF, "documents").select("text").limit(60).collect()]
    buf, offsets = flat(pa.array(texts, pa.string()))
    got = quality.features(buf, offsets)
    for row, text in zip(got, texts, strict=True):
        want = plain_features(text)
        at = dict(zip(quality.FEATURES, row, strict=True))
        assert {k: round(float(at[k]), 9) for k in want} == {k: round(float(v), 9) for k, v in want.items()}, text and text[:50]
    assert np.isfinite(got).all()
    assert (quality.features(np.zeros(0, np.uint8), np.zeros(3, np.int64)) == 0).all()


def plain_score(model, x):
    """One row, one table at a time."""
    z = model.intercept
    at = [sum(e <= v for e in edges) for edges, v in zip(model.edges, x, strict=True)]
    z += sum(t[k] for t, k in zip(model.tables, at, strict=True))
    z += sum(t[model.coarse[i][at[i]], model.coarse[j][at[j]]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
    return 1 / (1 + np.exp(-z))


def test_quality_on_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    got = quality.query(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p for y, p in held if y == 1]) > 0.97 and np.mean([1 - p for y, p in held if y == 0]) > 0.9


def test_quality_scores_are_sums_of_table_entries(spark):
    docs = table(spark, SF, "documents").limit(300)
    model = quality.learn(docs, table(spark, SF, "labels"), F.lit(True))
    assert model.pairs and len(model.tables) == len(quality.FEATURES)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.score(docs, model).collect():
        buf, offsets = flat(pa.array([texts[r["doc_id"]]], pa.string()))
        assert r["score"] == pytest.approx(plain_score(model, quality.features(buf, offsets)[0]), abs=1e-9)


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.Model().fit(x, y, np.ones(2000))
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x) > 0.5) == y) > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "", "b"), (None, "word " * 50_000, "c"), (3, "\n\n", None)], "doc_id bigint, text string, score string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    one = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id bigint, quality int")
    assert {r["score"] for r in quality.score(docs, quality.learn(docs, none, F.lit(True))).collect()} == {0.5}
    got = quality.score(docs, quality.learn(docs, one, F.lit(True))).collect()
    assert len(got) == 5 and all(r["score"] > 0.99 and r["predicted"] == 1 for r in got)
    model = quality.learn(table(spark, SF, "documents"), table(spark, SF, "labels"), F.lit(True))
    got = quality.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(docs.limit(0), model).count() == 0
