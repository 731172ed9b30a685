"""All pairs of vectors whose cosine reaches a threshold: every pair is bounded in square cells of the pair table, then verified.

Vectors are dealt to groups; a cell is a pair of groups, and each pair of vectors lies in one cell. In a cell the directions are
turned to their main axes, and a product over the first few of these, with the lengths of the rests, bounds the cosine from above
(Cauchy-Schwarz): no pair is missed. Cells go in passes of bounded size; what may reach the threshold is verified on the vectors
in the cell, so that pairs take no join, however many they are.
That is work by the square of the vectors, some two nanoseconds a pair.

Where a share of pairs may be missed, signatures of hyperplane signs spare most comparisons among more than some 10^7 vectors: a
vector's signature has BITS signs, and two vectors differ in each with probability angle / pi. A table of buckets takes some of
these bits; a pair is compared where it agrees in all bits of a table, by its whole signatures, in the join itself, and once: in
the first table that it agrees in. What is left is verified on the vectors. Numbers of bits and tables follow from the number of
vectors, the threshold and the share (`plan`), so buckets stay small as the tables grow.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .search import cosine
from .state import Steps, materialize

BITS = 256
#: Bytes of a group's vectors, of which a task holds two groups; bytes of vectors that a pass of cells moves at least.
GROUP, MOVED = 1 << 24, 1 << 30
#: Rows of a cell's tiles (WIDE by eights), and the share of pairs that the bound may leave to a whole product.
TALL, WIDE, LEFT = 1024, 1024, 5e-4


def plan(n: int, threshold: float, miss: float) -> tuple[int, int, int]:
    """(bits of a table, tables, differing bits that a pair may have): the cheapest for n vectors by which at most a share `miss`
    of the pairs that have just the threshold is lost; nearer pairs are lost less often."""
    if not 0 < threshold < 1 or not 0 < miss < 1:
        raise ValueError("threshold and miss lie between 0 and 1")
    d = math.acos(threshold) / math.pi
    share = [math.comb(BITS, h) * d**h * (1 - d) ** (BITS - h) for h in range(BITS + 1)]  # pairs by differing bits
    limit = next(h for h in range(BITS + 1) if sum(share[h + 1 :]) <= miss / 2)
    best = None
    for bits in range(4, 33):
        agree = [math.comb(BITS - h, bits) / math.comb(BITS, bits) for h in range(limit + 1)]
        lost = lambda tables: sum(s * (1 - a) ** tables for s, a in zip(share, agree, strict=False))  # noqa: B023, E731
        low, high = 0, 1
        while lost(high) > miss / 2:
            low, high = high, high * 2
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if lost(mid) > miss / 2 else (low, mid)
        cost = high * (n * 50 + n * n / 2 / 2**bits)  # a row through the shuffle costs some 50 compared pairs
        if best is None or cost < best[0]:
            best = (cost, bits, high)
    return best[1], best[2], limit


def signature(vector: Column, seed: int = 0) -> Column:
    """array<bigint> of the signs of a vector's products with BITS random directions, the same directions for all vectors of one length."""

    @F.pandas_udf("array<bigint>")
    def signs(v: pd.Series) -> pd.Series:
        out, size = np.empty(len(v), dtype=object), v.map(len).to_numpy()
        for dim in np.unique(size):
            at = np.flatnonzero(size == dim)
            planes = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), BITS))
            s = np.packbits(np.stack(v.to_numpy()[at]).astype("f8") @ planes > 0, axis=1).view("<i8")
            for i, row in zip(at, s, strict=True):
                out[i] = row
        return pd.Series(out)

    return signs(vector)


def takes_part(v: Column) -> Column:
    """Whether a vector has a direction: not null, empty or zero, and no null or non-finite component."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def by_signatures(first: DataFrame, threshold: float, miss: float, seed: int, work: dict | None) -> DataFrame:
    """a, b: pairs whose signatures meet in a table and differ in few bits; at most a share `miss` of those at the threshold is lost."""
    bits, tables, limit = plan(max(first.count(), 1), threshold, miss)
    rng = random.Random(seed)
    masks = [sum(1 << b for b in rng.sample(range(BITS), bits)) for _ in range(tables)]
    part = lambda m, k: ((m >> 64 * k & (1 << 64) - 1) ^ 1 << 63) - (1 << 63)  # noqa: E731  as a signed number
    words = range(BITS // 64)
    mask = F.from_json(F.lit(json.dumps([[part(m, k) for k in words] for m in masks])), "array<array<bigint>>")  # folded to one literal
    s = first.select("class_id", F.size("v").alias("dim"), signature(F.col("v"), seed).alias("sig"))
    s = materialize(s.select("class_id", "dim", *[F.col("sig")[k].alias(f"s{k}") for k in words]), "signatures")
    key = F.transform(mask, lambda m, t: F.xxhash64("dim", t, *[F.col(f"s{k}").bitwiseAND(m[k]) for k in words]))
    rows = s.select("class_id", "dim", *[f"s{k}" for k in words], F.posexplode(key).alias("t", "key"))
    a, b = rows.alias("a"), rows.alias("b")
    unlike = [F.col(f"a.s{k}").bitwiseXOR(F.col(f"b.s{k}")) for k in words]
    differ = sum((F.bit_count(x) for x in unlike[1:]), F.bit_count(unlike[0]))
    agree = F.transform(mask, lambda m: (unlike[0].bitwiseAND(m[0]) == 0) & (unlike[1].bitwiseAND(m[1]) == 0) & (unlike[2].bitwiseAND(m[2]) == 0) & (unlike[3].bitwiseAND(m[3]) == 0))
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.dim") == F.col("b.dim")) & (F.col("a.class_id") < F.col("b.class_id"))
    once = F.array_position(agree, F.lit(True)) == F.col("a.t") + 1
    b = b.hint("merge")  # Spark reckons with the vectors' bytes, not with a row for each table, and might broadcast those
    near = a.join(b, met & F.when(differ <= limit, once)).select(F.col("a.class_id").alias("a"), F.col("b.class_id").alias("b"))
    if work is not None:  # costs a run of the join
        work.update(bits=bits, tables=tables, limit=limit, compared=a.join(b, met).count(), verified=near.count())
    return near


def _bounds(left: np.ndarray, right: np.ndarray, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose products bound those of the given rows (of left twice, if they are the same) from above, with as few columns as a sample asks for; or the rows themselves."""
    right, dim = left if same else right, left.shape[1]
    if dim < 8:
        return left, right
    some = left[:: -(-len(left) // 8192)].astype("f8")
    axes = np.linalg.eigh(some.T @ some)[1][:, ::-1]
    turn = lambda x: np.concatenate([(x[i : i + 8192].astype("f8") @ axes).astype("f4") for i in range(0, len(x), 8192)])
    cut = lambda x, k: np.ascontiguousarray(np.column_stack([x[:, :k], np.sqrt((x[:, k:] * x[:, k:]).sum(axis=1))]))
    turned = turn(left)
    facing = turned if same else turn(right)
    few, some = (x[:: -(-len(x) // 512)] for x in (turned, facing))
    for k in (dim // 4, dim * 5 // 16, dim * 3 // 8, dim * 7 // 16, dim // 2, dim * 5 // 8):
        passed = (cut(few, k) @ cut(some, k).T >= least).sum() - (len(few) if same else 0)
        if passed <= LEFT * len(few) * len(some):
            low = cut(turned, k)
            return low, low if same else cut(facing, k)
    return left, right


def _meet(left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of rows of left and right, or of two rows of left if right is the same, whose cosine reaches the threshold, and it; tile by tile."""
    same, dim = right is left, left.shape[1]
    least = np.float32(threshold - (3 * dim + 32) * 2.0**-23)  # sums of 4-byte products err by less
    low, high = _bounds(_unit(left), left if same else _unit(right), same, least)
    high, step = np.ascontiguousarray(high.T), max(1, (1 << 21) // dim)
    product, hit = np.empty((TALL, WIDE), "f4"), np.zeros((TALL, WIDE), bool)
    for i in range(0, len(left), TALL):
        for j in range(i // WIDE * WIDE if same else 0, len(right), WIDE):
            h, w = min(TALL, len(left) - i), min(WIDE, len(right) - j)
            if h < TALL or w < WIDE:
                hit[:] = False
            np.greater_equal(np.matmul(low[i : i + h], high[:, j : j + w], out=product[:h, :w]), least, out=hit[:h, :w])
            eights = np.flatnonzero(hit.reshape(-1).view(np.uint64))  # few of them hold a hit
            at, one = np.nonzero(hit.reshape(-1, 8)[eights])
            x, y = np.divmod(eights[at] * 8 + one, WIDE)
            x, y = x + i, y + j
            if same:
                x, y = x[x < y], y[x < y]
            for s in range(0, len(x), step):
                a, b = x[s : s + step], y[s : s + step]
                score = _cosines(left[a], right[b])
                near = score >= threshold
                if near.any():
                    yield a[near], b[near], score[near]


def _unit(v: np.ndarray) -> np.ndarray:
    """Directions as 4-byte floats, of length 1 but for rounding."""
    out = np.empty(v.shape, "f4")
    for i in range(0, len(v), 8192):
        x = v[i : i + 8192] / np.abs(v[i : i + 8192]).max(axis=1, keepdims=True)
        out[i : i + 8192] = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return out


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows; vectors whose squares leave the numbers are brought to 1 at most before."""
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    with np.errstate(all="ignore"):
        size = np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))
        score = dot(a, b) / size
    odd = ~((size > 1e-280) & (size < 1e280))
    if odd.any():
        x, y = (v[odd] / np.abs(v[odd]).max(axis=1, keepdims=True) for v in (a, b))
        score[odd] = dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))
    return score


def by_cells(first: DataFrame, threshold: float, work: dict | None) -> DataFrame:
    """a, b, score: all pairs of vectors of one length whose cosine reaches the threshold, each once, in a written table."""
    spark, kind = first.sparkSession, first.schema["class_id"].dataType.simpleString()
    steps = Steps(spark)
    counted = sorted((r["dim"], r["n"]) for r in first.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect())  # a row for each length
    places, cells, total = {}, [], 0
    for dim, n in counted:
        start, groups = sum(g for _, g in places.values()), max(-(-n * dim * 8 // GROUP), min(8, -(-n // 2048)))
        places[dim] = (start, groups)
        total += n * dim * 8
        cells += [(start + i, start + j, n * dim * 8 // groups) for i in range(groups) for j in range(i, groups)]
    if work is not None:
        work.update(tables=len(cells), compared=sum(n * (n - 1) // 2 for _, n in counted))
    place = F.from_json(F.lit(json.dumps({str(d): p for d, p in places.items()})), "map<string,array<int>>")[F.size("v").cast("string")]
    dealt = first.select("class_id", (place[0] + F.pmod(F.xxhash64("class_id"), place[1])).cast("int").alias("part"), "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            part, ids = t["part"].to_numpy(), t["class_id"].combine_chunks()
            v = t["v"].combine_chunks().flatten().to_numpy().reshape(len(part), -1)
            rows = [np.flatnonzero(part == p) for p in np.unique(part)]
            left = v[rows[0]]
            for a, b, score in _meet(left, v[rows[1]] if len(rows) > 1 else left, threshold):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[0][a])), ids.take(pa.array(rows[-1][b])), pa.array(score)], ["a", "b", "score"])

        held, now = [], None
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j > i and cell[i] != now:
                    if held:
                        yield from pairs(held)
                    held, now = [], cell[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield from pairs(held)

    near, at, most = spark.createDataFrame([], f"a {kind}, b {kind}, score double"), 0, max(MOVED, 2 * total)
    while at < len(cells):
        took, begun, met = 0, at, {}
        while at < len(cells) and (at == begun or took < most):
            i, j, size = cells[at]
            for g in {i, j}:
                met.setdefault(g, []).append(at)
            took, at = took + 2 * size, at + 1
        mine = F.from_json(F.lit(json.dumps({str(g): x for g, x in met.items()})), "map<string,array<int>>")  # folded to one literal
        rows = dealt.withColumn("cell", F.explode(mine[F.col("part").cast("string")])).repartition(2 * (at - begun), "cell").sortWithinPartitions("cell")
        found = rows.mapInArrow(compare, f"a {kind}, b {kind}, score double")
        near = steps.write(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score"), "near")
    if work is not None:
        work["verified"] = near.count()
    return near


def similar_pairs(first: DataFrame, threshold: float = 0.85, miss: float = 0.0, seed: int = 0, work: dict | None = None) -> DataFrame:
    """a, b, score: class ids a < b of different vectors whose cosine is at least the threshold, each pair once; all of them where
    miss is 0, else all but such a share of those at the threshold.

    first: class_id, v, each vector once, written, since it is read for the count, for the comparisons and twice to verify. work,
    a dict, gets the numbers of tables (or cells), compared and verified pairs.
    """
    if not miss:
        return by_cells(first, threshold, work)
    near = by_signatures(first, threshold, miss, seed, work)
    left, right = (first.select(F.col("class_id").alias(c), F.col("v").alias(f"v_{c}")) for c in "ab")
    scored = near.join(left, "a").join(right, "b").select("a", "b", cosine(F.col("v_a"), F.col("v_b")).alias("score"))
    return scored.where(F.col("score") >= threshold)


def similar_rows(vectors: DataFrame, id_col: str, vector: str, threshold: float = 0.85, miss: float = 0.0, seed: int = 0, work: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Neighbours of all rows above a threshold: (rows, pairs).

    rows: id, class_id (smallest id of the same vector) and n_links, the number of other rows whose vectors reach the threshold,
    copies among them; a row of a vector that takes no part (null, empty, zero, with null or non-finite components) has a null
    class and no links. pairs: a, b, score between classes. Vectors of different lengths never link; rows of null ids are left
    out; rows of one id are rows like any others. Copies are counted before anything is compared, so a group of them costs one
    vector. A group of many *different* vectors that are all near each other has that many pairs, which are the answer.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL").withColumn("whole", takes_part(F.col("v")))
    members = rows.where("whole")
    first = materialize(members.groupBy("v").agg(F.min("id").alias("class_id"), F.count("*").alias("copies")), "vectors")
    pairs = similar_pairs(first, threshold, miss, seed, work)
    pairs = materialize(pairs, "pairs") if miss else pairs
    ends = pairs.select(F.col("a").alias("class_id"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    others = ends.join(first.select(F.col("class_id").alias("other"), "copies"), "other").groupBy("class_id").agg(F.sum("copies").alias("near"))
    known = first.join(others, "class_id", "left").select("v", "class_id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    code = F.xxhash64(F.transform("v", lambda x: x + F.lit(0.0)))  # arrays are slow to order, and both zeros are one
    found = members.withColumn("code", code).join(known.withColumn("code", code), ["code", "v"]).select("id", "class_id", "n_links")
    return found.union(rows.where("NOT whole").select("id", F.lit(None).cast(found.schema["class_id"].dataType), F.lit(0).cast("long"))), pairs
