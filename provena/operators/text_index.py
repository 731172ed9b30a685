"""Ranked full-text search over several weighted fields, from a stored inverted index.

A document's score is the sum over its fields of the field's weight times BM25 in that field. The index is a Store with

* docs: id, segment, the number of tokens of each field; the segment of an id is the newest batch that had it,
* forward: id, segment, term, the term's count in each field and the tokens of each field of the document,
* terms: term and the change of its document count in each field, a row for each batch,
* postings: blocks of at most BLOCK postings of one term, with the largest count and the least length of each field in the block.

A batch adds a segment: its postings are written beside the others, and an id that it brings again makes its older postings dead,
which the next `compact` drops. Counts of documents, terms and tokens move by differences, so that scores are always those of
the documents that count now.

Postings of a term are dealt to slots by a hash of the id, about SLOT documents of a segment each, whatever the term, and inside
a slot to blocks by falling weight. No list of a common word is thus in one group, and a slot's best score is bounded by the
sum of its blocks' bounds. A question for the best k reads the headers of its words' blocks, scores the most promising blocks
for a threshold that k documents reach, and then only those blocks that may still hold a document above it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .search import tokens
from .state import Steps, materialize
from .store import Store

K1, B, BLOCK, SLOT = 1.2, 0.75, 64, 1024
#: Postings that one pass over a segment's rows sorts and writes; PASSES at most, since each reads all rows.
POSTED, PASSES = 1 << 22, 8
#: Below this difference scores count as equal, so that no block is left out by rounding.
TINY = 1e-9


def words(question: str) -> list[str]:
    """The distinct tokens of a question, in order."""
    return list(dict.fromkeys("".join(ch.lower() if ch.isalnum() else " " for ch in question).split()))


class TextIndex:
    def __init__(self, store: Store, fields: list[str], buckets: int = 32):
        self.store, self.fields, self.buckets = store, fields, buckets

    def _numbers(self, name: str) -> list[str]:
        return [f"{name}_{k}" for k in range(len(self.fields))]

    def add(self, batch: str, docs: DataFrame, id_col: str) -> dict:
        """Index a batch of new and changed documents; ids are distinct within a batch, null ids are left out, null fields are empty.

        Writes a segment and the buckets of docs that the ids touch. A batch seen before changes nothing.
        """
        base = self.store.manifest()
        if batch in base["applied"]:
            return base
        segment, lens, tfs, steps = base["version"] + 1, self._numbers("len"), self._numbers("tf"), Steps(self.store.spark)
        named = docs.where(F.col(id_col).isNotNull()).withColumnRenamed(id_col, "id")
        n_new = named.select("id").count()
        # texts go once through the shuffle, to parts of the id buckets; their words are split, counted and written there
        parts, dealt = -(-n_new // SLOT // self.buckets) or 1, named.select("id", *[F.col(f).alias(f"f_{k}") for k, f in enumerate(self.fields)])
        bucket, part = self.store.bucket(["id"], self.buckets), F.pmod(F.hash("id"), F.lit(parts))
        dealt = dealt.withColumns({"bucket": bucket, "part": part}).repartition(self.buckets * parts, "bucket", "part")
        split = dealt.select("bucket", "part", "id", *[tokens(F.col(f"f_{k}")).alias(f"t_{k}") for k in range(len(self.fields))])
        in_field = lambda k: F.transform(f"t_{k}", lambda t: F.struct(t.alias("term"), F.lit(k).alias("field")))
        split = split.select("bucket", "part", "id", *[F.size(f"t_{k}").cast("long").alias(n) for k, n in enumerate(lens)], F.explode(F.concat(*[in_field(k) for k in range(len(self.fields))])).alias("x"))
        forward = split.groupBy("bucket", "part", "id", F.col("x.term").alias("term"), *lens).agg(*[F.count_if(F.col("x.field") == k).alias(n) for k, n in enumerate(tfs)])
        forward, forward_at = self.store.stage("forward", forward.select("id", F.lit(segment).alias("segment"), "term", *tfs, *lens), ["id"], self.buckets, dealt=True)
        # lengths come with the counts, so that texts are read and split once; the second scan is of ids alone, for those without a token
        known = forward.groupBy("id").agg(*[F.max(n).alias(n) for n in lens])
        sizes = named.select("id").join(known, "id", "left").select("id", F.lit(segment).alias("segment"), *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in lens])
        sizes = steps.write(sizes, "index-docs")

        touched = self.store.touched(sizes, ["id"], self.buckets)
        kept, gone, less = sizes, None, None
        if self.store.has("docs", base):
            now = self.store.read("docs", touched, base)
            gone = now.join(sizes.select("id"), "id", "left_semi")
            kept = now.join(sizes.select("id"), "id", "left_anti").unionByName(sizes)
            less = self.store.read("forward", touched, base).join(gone.select("id", "segment"), ["id", "segment"], "left_semi")
        count = lambda df, sign: df.groupBy("term").agg(*[(F.count_if(F.col(n) > 0) * sign).alias(f"df_{k}") for k, n in enumerate(tfs)])
        change = count(forward, 1) if less is None else count(forward, 1).unionByName(count(less, -1)).groupBy("term").agg(*[F.sum(f"df_{k}").alias(f"df_{k}") for k in range(len(tfs))])
        totals = self._totals(base, sizes, gone)
        postings, postings_at = self._postings(forward, segment, max(1, n_new // SLOT))
        made = self.store.commit(
            batch, base,
            replace={"docs": (kept, ["id"], self.buckets, touched)},
            append={"forward": (forward, ["id"], self.buckets, forward_at), "terms": (change, ["term"], self.buckets), "postings": (postings, ["term"], self.buckets, postings_at)},
            notes={"totals": totals},
        )
        steps.drop("index-docs")
        return made

    def _totals(self, base: dict, new: DataFrame, gone: DataFrame | None) -> list[int]:
        """Documents, and tokens of each field."""
        sums = lambda df: list(df.agg(F.count("*"), *[F.coalesce(F.sum(n), F.lit(0)) for n in self._numbers("len")]).first())
        before = base["notes"].get("totals", [0] * (len(self.fields) + 1))
        minus = sums(gone) if gone is not None else [0] * len(before)
        return [b + p - m for b, p, m in zip(before, sums(new), minus, strict=True)]

    def _postings(self, forward: DataFrame, segment: int, slots: int) -> tuple[DataFrame, list[tuple[str, str]]]:
        """Blocks, staged: segment, term, slot, block, n, top_<k>, least_<k> and entries; a group is one term in one slot, about SLOT entries at most.

        Rows go once through the shuffle, to parts of a bucket's slots that are both the groups' and the written files'; a large
        segment takes its buckets in passes, so that only a part of it is on its way.
        """
        lens, tfs = self._numbers("len"), self._numbers("tf")
        parts, passes = -(-slots // self.buckets), min(PASSES, self.buckets, max(1, -(-forward.count() // POSTED)))
        weight = reduce(lambda a, b: a + b, [F.col(t) / (F.col(t) + F.col(n) / 100.0 + 1) for t, n in zip(tfs, lens, strict=True)])
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("es") - 1) / BLOCK).cast("int")), lambda b: F.slice("es", b * BLOCK + 1, BLOCK))
        of = lambda name: F.transform("b", lambda e: e[name])
        back, at = None, []
        for k in range(passes):
            bucket = self.store.bucket(["term"], self.buckets)
            rows = forward.where(F.pmod(bucket, F.lit(passes)) == k).select("term", "id", *tfs, *lens, bucket.alias("bucket"), F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int").alias("slot"))
            rows = rows.repartition(max(1, -(-self.buckets // passes)) * parts, "bucket", F.pmod("slot", F.lit(parts)))
            rows = rows.select("bucket", F.pmod("slot", F.lit(parts)).alias("part"), "term", "slot", F.struct((-weight).alias("weight"), "id", *tfs, *lens).alias("e"))
            lists = rows.groupBy("bucket", "part", "term", "slot").agg(F.array_sort(F.collect_list("e")).alias("es"))
            cut = lists.select("term", "slot", F.posexplode(blocks).alias("block", "b")).select(
                F.lit(segment).alias("segment"), "term", "slot", "block", F.size("b").alias("n"), *[F.array_max(of(t)).alias(f"top_{j}") for j, t in enumerate(tfs)],
                *[F.array_min(of(n)).alias(f"least_{j}") for j, n in enumerate(lens)],
                F.transform("b", lambda e: F.struct(e["id"].alias("id"), *[e[x].alias(x) for x in (*tfs, *lens)])).alias("entries"),
            )
            back, more = self.store.stage("postings", cut, ["term"], self.buckets, dealt=True)
            at += more
        return back, at

    def compact(self, batch: str) -> dict:
        """All documents that count now as one segment: dead postings, old rows of terms and forward go."""
        base = self.store.manifest()
        if batch in base["applied"]:
            return base
        segment = base["version"] + 1
        docs, steps = self.store.read("docs", manifest=base), Steps(self.store.spark)
        forward = self.store.read("forward", manifest=base).join(docs.select("id", "segment"), ["id", "segment"], "left_semi").withColumn("segment", F.lit(segment))
        forward, docs = steps.write(forward.select("id", "segment", "term", *self._numbers("tf"), *self._numbers("len")), "index-forward"), docs.withColumn("segment", F.lit(segment))
        terms = forward.groupBy("term").agg(*[F.count_if(F.col(n) > 0).alias(f"df_{k}") for k, n in enumerate(self._numbers("tf"))])
        every = list(range(self.buckets))
        postings, at = self._postings(forward, segment, max(1, base["notes"]["totals"][0] // SLOT))
        tables = {"docs": (docs, ["id"]), "forward": (forward, ["id"]), "terms": (terms, ["term"]), "postings": (postings, ["term"], at)}
        made = self.store.commit(batch, base, replace={n: (df.select(*self.store.read(n, [], base).columns), keys, self.buckets, every, *staged) for n, (df, keys, *staged) in tables.items()})
        steps.drop("index-forward")
        return made

    # questions

    def _score(self, stats: dict, weights: list[float], tf, size) -> Column:
        """The score of a term: tf(k) and size(k) are the count and length in field k."""
        total, n = F.lit(0.0), stats["totals"][0]
        for k, weight in enumerate(weights):
            mean = stats["totals"][k + 1] / n if n else 0.0
            idf = reduce(lambda e, x: e.when(F.col("term") == x[0], F.lit(x[1][k])), stats["df"].items(), F.when(F.lit(False), 0))
            idf = F.log(1 + (F.lit(n) - idf + 0.5) / (idf + 0.5))
            length = size(k) / mean if mean else F.lit(0.0)
            total = total + F.when(tf(k) > 0, weight * idf * tf(k) * (K1 + 1) / (tf(k) + K1 * (1 - B + B * length))).otherwise(0.0)
        return total

    def search(self, question: str, k: int, weights: list[float] | None = None, work: dict | None = None) -> DataFrame:
        """rank, id, score and matched (words) of the k best documents, ties to the smaller id; scores are rounded to nine digits.

        work, a dict, gets postings (of the question's words), first and read (scored for the threshold, and in the end).
        """
        asked, weights, base = words(question), weights or [1.0] * len(self.fields), self.store.manifest()
        spark, kind = self.store.spark, self.store.read("docs", [], base).schema["id"].dataType.simpleString()
        empty = spark.createDataFrame([], f"rank int, id {kind}, score double, matched bigint")
        if not asked or k < 1 or any(w < 0 for w in weights):
            return empty
        named = spark.createDataFrame([(w,) for w in asked], "term string")
        places = self.store.touched(named, ["term"], self.buckets)
        of = lambda name: self.store.read(name, places, base).where(F.col("term").isin(asked))
        df = {r["term"]: list(r)[1:] for r in of("terms").groupBy("term").agg(*[F.sum(f"df_{j}") for j in range(len(self.fields))]).collect()}  # a row for each word
        if not df:
            return empty
        stats = {"totals": base["notes"]["totals"], "df": df}
        bound = self._score(stats, weights, lambda j: F.col(f"top_{j}"), lambda j: F.col(f"least_{j}"))
        heads = of("postings").select("segment", "term", "slot", "block", "n", bound.alias("bound"))
        at = ["segment", "term", "slot", "block"]
        docs = self.store.read("docs", manifest=base).select("id", "segment")

        def scored(blocks: DataFrame) -> DataFrame:
            e = of("postings").join(blocks.select(*at), at, "left_semi").select("segment", "term", F.explode("entries").alias("e"))
            part = self._score(stats, weights, lambda j: F.col(f"e.tf_{j}"), lambda j: F.col(f"e.len_{j}"))
            return e.select("segment", F.col("e.id").alias("id"), part.alias("part")).groupBy("id", "segment").agg(F.sum("part").alias("sum"), F.count("*").alias("matched"))

        promising = materialize(heads.orderBy(F.col("bound").desc(), *at).limit(2 * k), "promising")  # 2k blocks have k documents of one word, or two, at least
        best = scored(promising).join(docs, ["id", "segment"], "left_semi").orderBy(F.col("sum").desc()).limit(k).agg(F.count("*").alias("c"), F.min("sum").alias("s")).first()
        floor = best["s"] - TINY if best["c"] == k else float("-inf")
        top = heads.groupBy("segment", "slot", "term").agg(F.max("bound").alias("top"))
        slots = top.groupBy("segment", "slot").agg(F.sum("top").alias("all_tops"))
        kept = heads.join(top, ["segment", "slot", "term"]).join(slots, ["segment", "slot"]).where(F.col("bound") + F.col("all_tops") - F.col("top") >= floor)
        kept = materialize(kept.select(*at, "n"), "kept-blocks")
        if work is not None:
            work |= {"postings": heads.agg(F.sum("n")).first()[0], "first": promising.agg(F.sum("n")).first()[0], "read": kept.agg(F.sum("n")).first()[0]}
        live = scored(kept).where(F.col("sum") >= floor).join(docs, ["id", "segment"], "left_semi")
        rounded = live.select("id", F.round("sum", 9).alias("score"), "matched").orderBy(F.col("score").desc(), "id").limit(k)
        return rounded.select(F.row_number().over(Window.orderBy(F.col("score").desc(), "id")).alias("rank"), "id", "score", "matched")  # k rows
