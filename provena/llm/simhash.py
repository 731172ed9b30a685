"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

Fingerprints of 64 bits are eight positional bytes. Two that differ in three bits at most share five of the eight, so they
share some three positions of one half of the fingerprint: the index has a posting list for every value of those eight
triples of positions (lists of single bytes would each hold a 256th of all fingerprints). In a posting list the shared
positional bytes of each pair are tallied, pairs that reach five stay, and their differing bits are counted; what leaves a
list is a spanning forest of its links, never all pairs. Only distinct fingerprints are indexed.

Posting lists over LIST_CAP members are not gathered: their members go on to lists of five positions, and if one of those is
too long as well, to lists of the values within one bit (near) or two bits (far) of the three bytes that are left: any two
members within three bits meet where one is near and the other near or far, and are both linked to the first near one.

Defined cases: null and wordless texts have fingerprint zero and link like others; copies and repeated rows share a
fingerprint; rows with a null id count, but a group takes the smallest id that isn't null; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import drop_held, materialize, prepare, slices, table
from .components import components

#: Differing bits of a link, words of a shingle, and its hash's seed.
BITS, WORDS, SEED = 3, 3, 42
#: Members of a posting list that one task takes.
LIST_CAP = 2048
TRIPLES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
FIVES = list(combinations(range(8), 5))


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    w = text.lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    lengths = np.fromiter(map(len, w), dtype=np.int64, count=len(w))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(w) - words + 1)].tolist()
    ends = ends[min(words, len(w)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """id, h (a hash of the text) and fp (the fingerprint as a signed bigint) of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            fp = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words, seed) for t in batch.column("t").cast(pa.binary())], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(fp.view(np.int64))], names=["id", "h", "fp"])

    held = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("h"), F.col(f"`{text_col}`").alias("t"))
    return held.mapInArrow(run, held.select("id", "h").schema.add("fp", "long"))


def _mask(positions) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _postings(fps: DataFrame, subsets: list, where: Column | None = None) -> DataFrame:
    """list (number of the position set), key (the bytes there) and fp."""
    keys = F.array(*[F.struct(F.lit(k).alias("list"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("key")) for k, s in enumerate(subsets)])
    return fps.select("fp", F.explode(keys).alias("p")).select("p.list", "p.key", "fp")


def forest(members: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links that join what pairs with `bits` differing bits at most join: each member is compared with those not yet reached."""
    left, links = members.copy(), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            differ = left ^ x
            shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            maybe = np.flatnonzero(shared >= 8 - bits)
            if len(maybe):
                hit = maybe[np.bitwise_count(differ[maybe]) <= bits]
                links += [(int(x), int(y)) for y in left[hit]]
                queue += list(left[hit])
                left = np.delete(left, hit)
    return links


def _forests(lists: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            links = [x for m in batch.column("m") for x in forest(np.asarray(m.values, dtype=np.int64).astype(np.uint64, copy=False).view(np.uint64))]
            both = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    return lists.mapInArrow(run, "a bigint, b bigint")


def _near_and_far(postings: DataFrame) -> DataFrame:
    """Links of lists that are too long, from the places within one and two bits of what their key leaves open."""
    of_list = F.array(*[F.array(*[F.lit(b if b < 63 else -1).cast("int") for p in range(8) if p not in s for b in range(8 * p, 8 * p + 8)]) for s in FIVES])
    free = F.element_at(of_list, F.col("list") + 1)
    bit = lambda k: F.when(k < 0, F.lit(-(1 << 63))).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), k))
    ones = F.transform(free, bit)
    one = F.transform(ones, lambda x: F.struct(F.col("fp").bitwiseXOR(x).alias("at"), F.lit(True).alias("near")))
    two = F.flatten(F.transform(ones, lambda x: F.transform(F.filter(ones, lambda y: y > x), lambda y: F.struct(F.col("fp").bitwiseXOR(x).bitwiseXOR(y).alias("at"), F.lit(False).alias("near")))))
    self_ = F.array(F.struct(F.col("fp").alias("at"), F.lit(True).alias("near")))
    places = postings.select("fp", F.explode(F.concat(self_, one, two)).alias("p")).select("fp", "p.at", "p.near").distinct()
    first = places.where("near").groupBy("at").agg(F.min("fp").alias("a"))
    return places.join(first, "at").where("a <> fp").select("a", F.col("fp").alias("b"))


def links(fps: DataFrame, cap: int = LIST_CAP) -> DataFrame:
    """A forest (a, b) over distinct fingerprints fp that has the components of all links."""
    found, postings = [], _postings(fps, TRIPLES)
    for level in ("triples", "fives"):
        sizes = materialize(postings.groupBy("list", "key").agg(F.count("*").alias("n")).where("n > 1"), f"lists-{level}")
        lists = postings.join(sizes.where(F.col("n") <= cap), ["list", "key"]).groupBy("list", "key").agg(F.collect_list("fp").alias("m")).select("m")
        found.append(_forests(lists))
        longer = sizes.where(F.col("n") > cap)
        if longer.isEmpty():
            postings = None
            break
        rest = postings.join(longer.select("list", "key"), ["list", "key"], "left_semi").select("fp").distinct()
        postings = materialize(_postings(rest, FIVES), "postings") if level == "triples" else postings.join(longer.select("list", "key"), ["list", "key"], "left_semi")
    if postings is not None:
        found.append(_near_and_far(postings))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cap: int = LIST_CAP) -> DataFrame:
    """id, h (a hash of the text), fp, root (a fingerprint that names the group) and component_id (the smallest id of the group) of every row."""
    marked = materialize(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    groups = components(links(distinct.select("fp"), cap))
    rooted = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(smallest, "root").select("fp", "root", "component_id"), "fp").select(F.col("id").alias(id_col), "h", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all columns: that of the smallest id, a null id only where the group has no other."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col)
    first = found.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "h")).alias("r")).select("r.id", "r.h")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("i"), F.xxhash64(f"`{text_col}`").alias("k"))
    kept = rows.join(first, F.col("i").eqNullSafe(F.col("id")) & (F.col("k") == F.col("h")), "left_semi")
    return kept.dropDuplicates(["i", "k"]).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
