"""The stored index against scores of all documents, over batches, changes and compaction."""

import glob
import math
import os
import random

from provena.operators import text_index
from provena.operators.state import shared_folder
from provena.operators.store import Store
from provena.operators.text_index import TextIndex, words
from pyspark.sql import functions as F


def plain(docs, question, k, weights):
    asked, n = words(question), len(docs)
    split = {i: [words_of(f) for f in fields] for i, fields in docs.items()}
    out, each = [], range(len(weights))
    means = [sum(len(f[j]) for f in split.values()) / n for j in each]
    dfs = {w: [sum(w in f[j] for f in split.values()) for j in each] for w in asked}
    for i, fields in split.items():
        score, matched = 0.0, 0
        for w in asked:
            for j, weight in enumerate(weights):
                mean, df, tf = means[j], dfs[w][j], fields[j].count(w)
                if tf:
                    score += weight * math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(fields[j]) / mean))
            matched += any(w in f for f in fields)
        if matched:
            out.append((-round(score, 9), i, matched))
    return [(rank, i, -s, m) for rank, (s, i, m) in enumerate(sorted(out)[:k], 1)]


def words_of(text):
    return "".join(c.lower() if c.isalnum() else " " for c in text or "").split()


def test_index_against_all_documents(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = ["the"] * 30 + ["of"] * 12 + ["isnad"] * 3 + ["matn", "نافع", "Malik", "rare", "École"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(n)))
    index, docs = TextIndex(Store(spark, f"file://{tmp_path}/i"), ["title", "body"], buckets=4), {}

    def check():
        for question, k, weights in (("the isnad", 5, [1.0, 1.0]), ("rare, École!", 40, [3.0, 0.5]), ("نافع of Malik the", 3, [0.0, 1.0])):
            got = [(r["rank"], r["id"], r["score"], r["matched"]) for r in index.search(question, k, weights).collect()]
            want = plain(docs, question, k, weights)
            assert [(a, round(s, 7), m) for a, _, s, m in got] == [(a, round(s, 7), m) for a, _, s, m in want], question
            assert {(i, round(s, 7)) for _, i, s, _ in got} == {(i, round(s, 7)) for _, i, s, _ in want}, question

    for n, ids in enumerate([range(200), range(150, 260), [0, 1, 2]]):
        batch = {i: (text(6) if i % 7 else None, text(60) if n < 2 else "") for i in ids}
        docs |= batch
        df = spark.createDataFrame([(i, *f) for i, f in batch.items()] + [(None, "rare", "rare")], "id long, title string, body string")
        index.add(f"b{n}", df, "id")
        index.add(f"b{n}", df, "id")
        if n:
            check()
    before = index.store.manifest()["version"]
    index.compact("compact")
    assert index.store.manifest()["version"] == before + 1 == 4
    assert index.store.read("docs").select("segment").distinct().count() == 1
    check()
    index.store.vacuum()
    assert index.search("isnad", 3).count() == 3 and index.search("the", 1000).count() > 150
    assert index.search("nothing", 3).count() == index.search("", 3).count() == 0


def test_blocks_are_left_out(spark, tmp_path):
    """A common word with a rare one: few blocks of the common word can matter."""
    rng = random.Random(3)
    docs = [(i, "common " * rng.randrange(1, 9) + "x " * rng.randrange(300) + ("rare rare" if i in (17, 5000) else "")) for i in range(9000)]
    index = TextIndex(Store(spark, f"file://{tmp_path}/i"), ["body"], buckets=4)
    index.add("all", spark.createDataFrame(docs, "id long, body string"), "id")
    for question, k in (("common", 10), ("common rare", 2)):
        work: dict = {}
        got = [(r["rank"], r["id"], round(r["score"], 7)) for r in index.search(question, k, work=work).collect()]
        assert got == [(a, i, round(s, 7)) for a, i, s, _ in plain({i: (t,) for i, t in docs}, question, k, [1.0])]
        assert work["postings"] >= 9000 and work["read"] < 0.3 * work["postings"], work


def test_batch_leaves_its_segment_and_nothing_else(spark, tmp_path, monkeypatch):
    """A batch's rows are written once, in passes if they are many, and its shuffle files go."""
    monkeypatch.setattr(text_index, "POSTED", 1500)
    rng = random.Random(8)
    docs = {i: " ".join(rng.choice(["the", "of", "isnad"]) if rng.random() < 0.5 else f"w{rng.randrange(300)}" for _ in range(rng.randrange(40))) for i in range(400)}
    index = TextIndex(Store(spark, f"file://{tmp_path}/i"), ["body"], buckets=4)
    places = [f"{spark.conf.get('spark.local.dir', '/tmp')}/blockmgr-*/*/shuffle_*.data", f"{shared_folder(spark).removeprefix('file://')}/index-*"]
    before = [set(glob.glob(p)) for p in places]
    index.add("all", spark.createDataFrame([(i, t) for i, t in docs.items()], "id long, body string"), "id")
    shuffled, copies = (set(glob.glob(p)) - b for p, b in zip(places, before, strict=True))
    assert sum(os.path.getsize(f) for f in shuffled) < 20_000 and not copies  # counts and lists of buckets
    at = index.store.manifest()["tables"]["postings"]["at"]
    assert len({d for dirs in at.values() for d in dirs}) == 4  # a folder for each pass
    postings = index.store.read("postings").select("term", F.explode("entries").alias("e")).select("term", "e.id", "e.tf_0", "e.len_0")
    want = {(t, i, text.split().count(t), len(text.split())) for i, text in docs.items() for t in set(text.split())}
    got = [tuple(r) for r in postings.collect()]
    assert set(got) == want and len(got) == len(want)
