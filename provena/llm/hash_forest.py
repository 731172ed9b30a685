"""Approximate nearest neighbours by a forest of hash prefixes.

Distinct vectors are dealt to blocks of about BLOCK_ROWS. In a block each tree gives every vector one long hash string: after
a random rotation of the tree, a 7-bit symbol for the largest coordinate by size and its sign, five times over, packed in a
sorted array of 35-bit numbers. A query descends each tree to its longest prefix match, then ascends in all trees at once, bit
by bit, until the prefix's ranges hold CANDIDATES entries in all; the vectors in those ranges are the candidates, whose inner
products are computed exactly in double precision. Hash strings know directions only. So every vector joins the candidates
that is long enough to reach the (k + 1)-th best score found at the (k + 1)-th best cosine found: any other one would need a
direction closer than those, which is what the trees look for. Among vectors of one length none joins.

How many entries that takes depends on the vectors: the more dimensions and the less structure, the less a hash string knows.
So each block measures it. PROBES of its own vectors are asked; their exact neighbours are known from all products; entries
grow by half until TARGET of these are among the candidates. A block whose candidates would be most of it is compared whole.

Every query meets every block once, in a stream: a block's task holds its vectors and a batch of queries. Blocks are about the same size at every scale, so is the share of a block that is compared.

Copies of a vector are one entry with its smallest ids, k + 1 of them, which is all that k results can need; no id is lost
where fewer are kept, as larger ids of equal score rank after them.

Defined cases: null ids, and vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of
different lengths never meet; rows that share the query's id are its own, and where an id has several vectors these are set
aside before anything is cut to k; fewer candidates than k give as many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize, prepare, table

K, TREES, BLOCK_ROWS, CANDIDATES = 20, 48, 8192, 2400
#: A block's own vectors that are asked to measure its recall, the recall that they have to reach, and the share of a block above which it is compared whole.
PROBES, TARGET, WHOLE = 64, 0.93, 0.7
#: Coordinates after a rotation, and symbols of a string.
SPREAD, SYMBOLS = 64, 5


def _rotations(dim: int, trees: int) -> np.ndarray:
    """trees x SYMBOLS matrices with orthonormal columns (or random ones where there are fewer dimensions than columns)."""
    rng = np.random.default_rng(97)
    out = np.empty((trees, SYMBOLS, dim, SPREAD), dtype=np.float32)
    for t in range(trees):
        for s in range(SYMBOLS):
            g = rng.standard_normal((dim, SPREAD))
            out[t, s] = np.linalg.qr(g)[0] if dim >= SPREAD else g
    return out


def strings(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Hash strings of unit vectors by one tree."""
    out = np.zeros(len(x), dtype=np.uint64)
    for s in range(SYMBOLS):
        y = x @ rotation[s]
        top = np.abs(y).argmax(axis=1)
        symbol = (top << 1 | (y[np.arange(len(y)), top] > 0)).astype(np.uint64)
        out |= symbol << np.uint64(7 * (SYMBOLS - 1 - s))
    return out


class Forest:
    """Sorted hash strings of a block, by tree."""

    def __init__(self, x: np.ndarray, trees: int = TREES):
        self.rotations = _rotations(x.shape[1], trees)
        self.norms = np.linalg.norm(x, axis=1)
        unit = (x / self.norms[:, None]).astype(np.float32)
        hashes = [strings(unit, r) for r in self.rotations]
        self.order = [h.argsort(kind="stable") for h in hashes]
        self.sorted = [h[o] for h, o in zip(hashes, self.order)]
        self.n = len(x)

    def candidates(self, queries: np.ndarray, least: int) -> list[np.ndarray]:
        """Places of the candidates of each query."""
        unit = (queries / np.linalg.norm(queries, axis=1, keepdims=True)).astype(np.float32)
        q = [strings(unit, r) for r in self.rotations]
        bits = 7 * SYMBOLS
        # descend: the longest prefix that a tree holds is shared with a neighbour in sorted order
        deepest = np.zeros(len(queries), dtype=np.int64)
        for h, s in zip(q, self.sorted):
            at = np.searchsorted(s, h)
            for near in (np.maximum(at - 1, 0), np.minimum(at, self.n - 1)):
                differ = s[near] ^ h
                deepest = np.maximum(deepest, bits - np.frexp(differ.astype(np.float64))[1])
        lo, hi = np.zeros((len(q), len(queries)), np.int64), np.full((len(q), len(queries)), self.n)
        level, open_ = np.clip(deepest, 0, bits), np.arange(len(queries))
        while len(open_):  # ascend in all trees at once
            shift = (bits - level[open_]).astype(np.uint64)
            for t, (h, s) in enumerate(zip(q, self.sorted)):
                first = h[open_] >> shift << shift
                lo[t, open_] = np.searchsorted(s, first)
                hi[t, open_] = np.searchsorted(s, first | ((np.uint64(1) << shift) - np.uint64(1)), side="right")
            enough = ((hi - lo)[:, open_].sum(axis=0) >= least) | (level[open_] == 0)
            open_ = open_[~enough]
            # below three symbols hardly any ranges differ: go up by whole symbols there
            level[open_] = np.where(level[open_] > 21, np.maximum(21, (level[open_] - 1) // 7 * 7), level[open_] - 1)
        out = []
        for k in range(len(queries)):
            seen = np.zeros(self.n, dtype=bool)
            for t, o in enumerate(self.order):
                seen[o[lo[t, k] : hi[t, k]]] = True
            out.append(np.flatnonzero(seen))
        return out

    def longer(self, places: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the vectors, not among the candidates, that their length may bring among the k + 1 best at a wider angle."""
        bound = 0.0  # all, where candidates are few or none is within a right angle
        if len(places) > k:
            score, cosine = (np.partition(a, len(a) - k - 1)[-k - 1] for a in (scores, scores / self.norms[places]))
            if score > 0 and cosine > 0:
                bound = score / cosine * (1 + 1e-6)  # rounding of unit vectors is no length
        new = self.norms > bound
        new[places] = False
        return np.flatnonzero(new)


    def entries(self, x: np.ndarray, k: int, least: int) -> int:
        """The entries, from `least` on, at which TARGET of the k nearest of probes of the block are found; 0: compare the whole block."""
        probes = np.unique(np.linspace(0, self.n - 1, PROBES).astype(np.int64))
        products = x[probes] @ x.T
        products[np.arange(len(probes)), probes] = -np.inf
        k = min(k, self.n - 1)
        if k < 1:
            return 0
        best = np.argpartition(-products, k - 1, axis=1)[:, :k]
        while True:
            hits = held = 0
            for row, true, places in zip(products, best, self.candidates(x[probes], least)):
                places = places[row[places] > -np.inf]
                held += len(places)
                places = np.concatenate([places, self.longer(places, row[places], k)])
                hits += np.isin(true, places).sum()
            if held > WHOLE * self.n * len(probes):
                return 0
            if hits >= TARGET * k * len(probes):
                return least
            least += least // 2


def _usable(v: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)


def _search(rows: DataFrame, k: int, trees: int, least: int) -> DataFrame:
    """rows: block, kind (0 vectors, 1 queries), key, v, ids, ordered within blocks; gives key and its best (score, id) of the block."""

    def answer(x: np.ndarray, ids: list, forest: Forest, entries: int, keys: list, owners: list, queries: np.ndarray) -> pa.RecordBatch:
        found = []
        whole = np.arange(forest.n)
        for q, own, places in zip(queries, owners, forest.candidates(queries, entries) if entries else [whole] * len(queries)):
            other = lambda at: at if own[0] is None else np.array([p for p in at.tolist() if ids[p] != own], dtype=np.int64)
            places = other(places)
            scores = np.einsum("ij,j->i", x[places] if len(places) < forest.n else x, q)
            more = other(forest.longer(places, scores, k)) if entries else places[:0]
            if len(more):
                places, scores = np.concatenate([places, more]), np.concatenate([scores, np.einsum("ij,j->i", x[more], q)])
            if len(places) > 4 * k:
                cut = np.partition(scores, len(scores) - k - 1)[-k - 1]
                places, scores = places[scores >= cut], scores[scores >= cut]
            best = sorted((-s, i) for p, s in zip(places.tolist(), scores.tolist()) for i in ids[p] if i != own[0])[: k + 1]
            found.append([{"s": s, "i": i} for s, i in best])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.struct([("s", pa.float64()), ("i", pa.int64())])))], names=["key", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, ids, x, forest, entries = None, [], [], None, None, 0
        for batch in batches:
            names, kinds = batch.column("block").to_pylist(), np.asarray(batch.column("kind"))
            edges = [0, *(i for i in range(1, batch.num_rows) if names[i] != names[i - 1] or kinds[i] != kinds[i - 1]), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, -1)
                if names[a] != block:
                    block, parts, ids, x, forest = names[a], [], [], None, None
                if kinds[a] == 0:
                    parts.append(v)
                    ids += part.column("ids").to_pylist()
                    continue
                if forest is None and parts:
                    x = np.concatenate(parts)
                    forest = Forest(x, trees)
                    entries = forest.entries(x, k, least)
                for c in range(0, b - a if forest else 0, 256):
                    yield answer(x, ids, forest, entries, part.column("key").slice(c, 256).to_pylist(), part.column("ids").slice(c, 256).to_pylist(), v[c : c + 256])

    return rows.mapInArrow(run, "key binary, best array<struct<s:double,i:bigint>>")


def nearest(vectors: DataFrame, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, trees: int = TREES, block_rows: int = BLOCK_ROWS, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for the rows where `queries` (of columns id and v) holds."""
    spark = vectors.sparkSession
    prepare(spark)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v")))
    text = F.to_json(F.struct("v"))
    v = v.withColumn("key", F.unhex(F.md5(text)))
    # one row of a distinct vector with its smallest ids; the rank limit is applied before the shuffle too
    ranked = v.dropDuplicates(["key", "id"]).withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= k + 1)
    entries = ranked.groupBy("key").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))
    entries = materialize(entries, "vectors")
    # the vector names a query; where an id has several vectors, the id and the vector do, and the block leaves out what is its own
    rows = v.where(queries).dropDuplicates(["id", "key"])
    several = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    own = F.when(F.col("n").isNotNull(), F.col("id"))
    asked = v.where(queries).join(several, "id", "left").select("id", own.alias("own"), F.unhex(F.md5(F.concat(F.hex("key"), F.coalesce(own.cast("string"), F.lit(""))))).alias("key"), "v")
    asked = materialize(asked, "queries")
    sizes = {r["d"]: max(1, -(-r["n"] // block_rows)) for r in entries.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = F.element_at(F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, n)]), F.size("v"))
    place = lambda b: F.concat_ws("/", F.size("v").cast("string"), b.cast("string"))
    held = entries.select(place(F.pmod(F.xxhash64("key"), blocks)).alias("block"), F.lit(0).alias("kind"), "key", "v", "ids")
    distinct = asked.groupBy("key").agg(F.first("v").alias("v"), F.first("own").alias("own"))
    dealt = distinct.select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("b")).select(place(F.col("b")).alias("block"), F.lit(1).alias("kind"), "key", "v", F.array("own").alias("ids"))
    n = max(sum(sizes.values()), spark.sparkContext.defaultParallelism)
    streamed = held.union(dealt).repartition(n, "block").sortWithinPartitions("block", "kind")
    found = _search(streamed, k, trees, candidates)
    merge = lambda df, *by: df.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))
    part = F.pmod(F.xxhash64(F.col("best")), F.lit(16))
    merged = merge(merge(found.withColumn("part", part), "key", "part"), "key")
    own = asked.select(F.col("id").alias("query_id"), "key").join(merged, "key")
    near = F.slice(F.filter("best", lambda x: x["i"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(near).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
