"""SimHash groups and removal of repeated strings, against brute force."""

import hashlib
import random

import numpy as np
import xxhash
from provena.llm import simhash, suffix_dedup
from provena.llm.components import components


def naive_fingerprint(text):
    words, word = [], ""
    for ch in (text or "").translate({c: c + 32 for c in range(65, 91)}):
        if ch == " " or "\x09" <= ch <= "\x0d":
            words += [word] if word else []
            word = ""
        else:
            word += ch
    words += [word] if word else []
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_groups(items, near):
    root = {k: k for k in range(len(items))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                root[find(i)] = find(j)
    return [find(k) for k in range(len(items))]


def check_groups(found, ids, prints):
    groups = naive_groups(prints, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {}
    for i, g in zip(ids, groups):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted((str(i), f"{p:016x}", least.get(g)) for i, p, g in zip(ids, prints, groups))
    assert sorted((str(r[0]), r[1], r[2]) for r in found) == want


def test_near_duplicates(spark, sf):
    from provena.llm.common import table

    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    found = simhash.query(spark, sf).collect()
    check_groups(found, [i for i, _ in rows], [naive_fingerprint(t) for _, t in rows])


def test_near_duplicates_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\x0b"), (None, "a b"), (7, "a b"), (7, "a b"), (9, "A b C d e"), (8, "x" * 30000)]
    docs = spark.createDataFrame([(i, t, "fp") for i, t in rows], "doc_id long, text string, fp string")
    found = simhash.near_duplicates(docs).collect()
    got = [(r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in found]
    check_groups(got, [i for i, _ in rows], [naive_fingerprint(t) for _, t in rows])
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_links_of_long_lists(spark):
    """Lists over the cap go on to five positions, and to places within one and two bits; no link is lost."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = {0, 1 << 63, (1 << 64) - 1}
    for _ in range(220):
        x = rng.choice(base)
        for _ in range(rng.choice([1, 2, 3, 5])):
            x ^= 1 << rng.choice([0, 1, 2, 3, 4, 5, 62, 63, rng.randrange(64)])
        prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = naive_groups(prints, lambda a, b: bin(a ^ b).count("1") <= 3)
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    for cap in (2048, 20, 4, 1):
        pairs = simhash.links(fps, cap)
        for r in pairs.collect():
            assert bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 3
        root = {r["node"]: r["root"] for r in components(pairs).collect()}
        got = [root.get(x, x) for x in signed]
        assert len({*zip(want, got)}) == len(set(want)) == len(set(got)), cap


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 180)] + [(200, 200), (301, 300), (300, 301)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 180)}, 300: 300, 301: 300}


def naive_removal(texts, length):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for d, b in enumerate(data):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((d, i))
    gone = [np.zeros(len(b), dtype=bool) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = True
    out = []
    for b, g in zip(data, gone):
        edge = np.diff(np.concatenate([[0], g.astype(int)]))
        out.append((len(b), int(g.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()))
    return out


def check_removal(spark, texts, length, gram, cap=suffix_dedup.CLASS_CAP):
    docs = spark.createDataFrame([(k, t, b"") for k, t in enumerate(texts)], "doc_id long, text string, tid binary")
    found = suffix_dedup.removal(docs, length=length, gram=gram, cap=cap).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found}
    assert [got[k] for k in range(len(texts))] == naive_removal(texts, length)


def test_repeats_of_small_alphabets(spark):
    rng = random.Random(2)
    for length, gram in ((24, 8), (40, 10)):
        shared = ["".join(rng.choice("ab") for _ in range(200)) for _ in range(4)]
        texts = [None, "", "a" * 300, "ab" * 200, "é" * 90, "\0" * 60, "a" * (length - 1), "b" * length, "b" * (length + 1)]
        for _ in range(50):
            parts = []
            for _ in range(rng.randrange(1, 5)):
                s = rng.choice(shared)
                a = rng.randrange(0, 150)
                parts.append(s[a : a + rng.randrange(5, 120)] if rng.random() < 0.6 else "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 60))))
            texts.append("".join(parts))
        texts += texts[-3:]
        check_removal(spark, texts, length, gram)


def test_repeats_of_hot_classes(spark):
    """Classes over the cap are narrowed to slices and single windows with the same result."""
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh") for _ in range(70))
    texts = []
    for k in range(60):
        texts.append("".join(rng.choice("xyz") for _ in range(40)) + shared[k % 3 : 70 - k % 5] + "".join(rng.choice("xy") for _ in range(40)))
    for cap in (4, 50):
        check_removal(spark, texts, 48, 12, cap)


def test_repeats_of_documents(spark, sf):
    from provena.llm.common import table

    rows = table(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.query(spark, sf).collect()}
    assert [got[r["doc_id"]][:-1] for r in rows] == naive_removal([r["text"] for r in rows], 400)
    assert [got[r["doc_id"]][-1] for r in rows] == [len(g) for g in naive_words([r["text"] for r in rows], 50, True)[1]]


def test_column_order_is_the_sorted_order():
    rng = np.random.default_rng(0)
    classes = np.sort(rng.integers(0, 6, 200))
    rows = rng.integers(0, 2, (200, 24)).astype(np.uint8)
    rows[:, :10] = 1
    order, prefix = suffix_dedup.column_order(rows.view(">u8").astype(np.uint64), classes)
    keys = [(int(c), bytes(r)) for c, r in zip(classes, rows)]
    assert [keys[k] for k in order] == sorted(keys)
    for i in range(1, 200):
        (c, a), (d, b) = keys[order[i - 1]], keys[order[i]]
        want = -1 if c != d else next((k for k in range(24) if a[k] != b[k]), 24)
        assert prefix[i] == want


def naive_words(texts, length, across):
    """Per text the places of words in windows that a second owner has."""
    lines = [[w.decode() for w in (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()] for t in texts]
    owners = {}
    for d, w in enumerate(lines):
        for i in range(len(w) - length + 1):
            owners.setdefault(tuple(w[i : i + length]), []).append((d, i))
    gone = [set() for _ in texts]
    for places in owners.values():
        if len({d for d, _ in places} if across else places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + length))
    return lines, gone


def test_repeated_passages_of_words(spark):
    """Windows of words, in two places or in two rows, whatever the white space and the case of A-Z."""
    rng = random.Random(8)
    shared = [[rng.choice(["la", "Éa", "on", "x" * 30, "the"]) for _ in range(40)] for _ in range(3)]
    texts = [None, "", " \n", "on " * 30, "the\tthe  the", "lone " + "w" * 400]
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            s, a = rng.choice(shared), rng.randrange(0, 30)
            part = s[a : a + rng.randrange(3, 30)] if rng.random() < 0.6 else [rng.choice("abcdef") * 3 for _ in range(rng.randrange(1, 20))]
            parts += [w.upper() if rng.random() < 0.1 and w.isascii() else w for w in part]
        texts.append(rng.choice(["", " "]) + rng.choice([" ", "\n", "  "]).join(parts))
    texts += texts[-2:]
    docs = spark.createDataFrame([(k, t, "m") for k, t in enumerate(texts)], "doc_id long, text string, marks string")
    for across in (False, True):
        lines, gone = naive_words(texts, 9, across)
        for cap in (suffix_dedup.CLASS_CAP, 3)[across:]:
            got = {r["doc_id"]: r["n_symbols"] for r in suffix_dedup.removal(docs, unit="words", length=9, gram=3, across=across, cap=cap).collect()}
            assert got == {k: len(g) for k, g in enumerate(gone)}, (across, cap)
        if not across:
            continue
        kept = {r["doc_id"]: r["text"] for r in suffix_dedup.removal(docs, unit="words", length=9, gram=3, across=across, text=True).collect()}
        for k, t in enumerate(texts):
            want = [w for i, w in enumerate(lines[k]) if i not in gone[k]]
            assert (kept[k] is None) == (t is None)
            assert [w.decode() for w in (kept[k] or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()] == want
            assert gone[k] or kept[k] == t


def test_removed_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "q" * 500 + "é", "x"), (2, "q" * 500 + "z", "y"), (3, None, "z")], "doc_id long, text string, d string")
    kept = {r["doc_id"]: (r["text"], r["d"]) for r in suffix_dedup.removal(docs, text=True).collect()}
    assert kept == {1: ("é", "x"), 2: ("z", "y"), 3: (None, "z")}
    assert suffix_dedup.removal(docs.limit(0)).collect() == []
