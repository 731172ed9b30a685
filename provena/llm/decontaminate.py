"""Benchmark decontamination by one Aho-Corasick automaton over normalised test passages.

A text is lower-cased (A-Z only) and read as words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Every run of `window` consecutive
words of a benchmark item (all words of a shorter one) is a pattern of one automaton over word numbers; each document is scanned
once. Normalising keeps byte lengths, so that a hit word's place in the original is known exactly.

Defined cases: null or wordless texts have no words and no hits; null or wordless items have no window; repeated document
rows each give a row; repeated items count once by id; null item ids are left out of the item list but their windows hit.
"""

from __future__ import annotations

import re
import uuid
from collections import deque
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import held, materialize, prepare, table

WINDOW = 13
#: Nodes of one automaton at most, about 48 bytes each; larger benchmarks are scanned for by several, one after the other.
BLOCK_NODES = 4 << 20
#: Symbols that a word's digits have: a node's children are searched one by one.
BASE = 128
_NORMAL = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """p (words with a space between), n (words), items (ids as sorted strings) of the distinct windows. benchmark: i, t. An item's windows leave the task as they are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.binary(), pa.int32(), pa.string()))], names=["p", "n", "i"])
            found.clear()
            return out

        for batch in batches:
            for item, text in zip(batch.column("i").to_pylist(), batch.column("t").cast(pa.binary()).to_pylist()):
                last: deque = deque(maxlen=window)
                for m in _WORD.finditer((text or b"").translate(_NORMAL)):
                    last.append(m[0])
                    if len(last) == window:
                        found.append((b" ".join(last), window, item))
                        if len(found) >= 20_000:
                            yield handed()
                if 0 < len(last) < window:
                    found.append((b" ".join(last), len(last), item))
        yield handed()

    made = benchmark.mapInArrow(run, "p binary, n int, i string")
    return made.groupBy("p", "n").agg(F.array_sort(F.collect_set("i")).alias("items"))


class Matcher:
    """One automaton over the windows of a block. A word is a number among the block's words, written in `digits` symbols of BASE
    each, every place with symbols of its own, so that no match begins inside a word; all other words are one symbol that no window has.
    """

    def __init__(self, patterns: list[tuple]):
        self.items = [ids for _, _, ids in patterns]
        self.sizes = [n for _, n, _ in patterns]
        known = dict.fromkeys(w for p, _, _ in patterns for w in p.split(b" "))
        self.digits = 1
        while BASE**self.digits < len(known):
            self.digits += 1
        self.codes = {w: "".join(chr(1 + BASE * d + k // BASE**d % BASE) for d in range(self.digits)) for k, w in enumerate(known)}
        self.other = "\0" * self.digits
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, (p, _, _) in enumerate(patterns):
            self.automaton.add_word("".join(map(self.codes.__getitem__, p.split(b" "))), k)
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set]:
        """Words, hit runs as (first word, words) and items."""
        w = words(text)
        runs, items = [], set()
        line = "".join([self.codes.get(x, self.other) for x in w])
        for end, k in self.automaton.iter(line) if self.items else ():  # an automaton without words can't be asked
            n = self.sizes[k]
            runs.append(((end + 1) // self.digits - n, n))
            items.update(self.items[k])
        return len(w), runs, items


def _original_spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Byte spans of maximal runs of hit words in the original text."""
    real = np.frombuffer(text.translate(_NORMAL), dtype=np.uint8) != 32
    edge = np.diff(np.concatenate([[0], real.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    return [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1))]


def _hits(rows: DataFrame, patterns) -> DataFrame:
    """d, runs and items of those rows (d, t) in which a block of windows is met."""
    token, kind = uuid.uuid4().hex, rows.schema["d"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for batch in batches:
            matcher = matcher or held(token, lambda: Matcher(patterns.value))
            found = [matcher.scan(text or b"") for text in batch.column("t").cast(pa.binary()).to_pylist()]
            at = [k for k, x in enumerate(found) if x[1]]
            runs = pa.array([[{"a": a, "n": n} for a, n in found[k][1]] for k in at], pa.list_(pa.struct([("a", pa.int32()), ("n", pa.int32())])))
            items = pa.array([sorted(found[k][2]) for k in at], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("d").take(pa.array(at, pa.int64())), runs, items], names=["d", "runs", "items"])

    made = T.StructType.fromDDL("runs array<struct<a:int,n:int>>, items array<string>")
    return rows.mapInArrow(run, T.StructType([T.StructField("d", kind), *made.fields]))


def _summed(rows: DataFrame, patterns=None) -> DataFrame:
    """d, n_words, n_hit, items and spans of rows (d, t), which are scanned for the windows, or (d, t, runs, items) that were."""
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            texts = batch.column("t").cast(pa.binary()).to_pylist()
            if patterns is None:
                found = ((len(words(t or b"")), [(x["a"], x["n"]) for x in runs or ()], ids) for t, runs, ids in zip(texts, batch.column("runs").to_pylist(), batch.column("items").to_pylist()))
            else:
                matcher = matcher or held(token, lambda: Matcher(patterns.value))
                found = (matcher.scan(t or b"") for t in texts)
            for text, (n, runs, ids) in zip(texts, found):
                hit = np.zeros(n, dtype=bool)
                for a, m in runs:
                    hit[a : a + m] = True
                n_words.append(n)
                n_hit.append(int(hit.sum()))
                items.append(sorted(ids))
                spans.append(_original_spans(text, hit) if runs else [])
            columns = [batch.column("d"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, names=["d", "n_words", "n_hit", "items", "spans"])

    made = T.StructType.fromDDL("n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>")
    return rows.mapInArrow(run, T.StructType([T.StructField("d", rows.schema["d"].dataType), *made.fields]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, least: int = 20, block_nodes: int = BLOCK_NODES, whole: bool = False) -> DataFrame:
    """Per document row: id (with whole=True a struct `row` of all its columns, whatever their names), n_words, n_hit, items (sorted as strings), spans (original byte offsets), contaminated.

    contaminated: n_hit > 0 and least * n_hit >= n_words. The windows of the benchmark are made, made distinct and counted by
    Spark; blocks of them, by hash, become automata of at most about block_nodes nodes, each broadcast by itself. Usually one
    block has them all and the documents are read once; else rows are numbered and written once, each block's pass writes its
    hits alone, and these meet by row in the end.
    """
    spark = docs.sparkSession
    prepare(spark)
    bench = windows(benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t")), window)
    carried = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if whole else [id_col])]).alias("d")
    rows = docs.select(carried, F.col(f"`{text_col}`").alias("t"))
    found = materialize(bench, "windows")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    digits = 1
    while BASE**digits < min(total, block_nodes):  # no block has more distinct words
        digits += 1
    blocks = max(1, -(-total * digits // block_nodes))
    block = lambda k: spark.sparkContext.broadcast([tuple(x) for x in (found if blocks == 1 else found.where(F.pmod(F.xxhash64("p", "n"), F.lit(blocks)) == k)).select("p", "n", "items").collect()])
    if blocks == 1:
        rows = _summed(rows, block(0))
    else:
        numbered = materialize(rows.select(F.monotonically_increasing_id().alias("r"), "d", "t"), "numbered")
        hits = []
        for k in range(blocks):  # the driver and the workers hold one block at a time
            patterns = block(k)
            hits.append(materialize(_hits(numbered.select(F.col("r").alias("d"), "t"), patterns), f"hits-{k}"))
            patterns.destroy()
        met = reduce(DataFrame.union, hits).groupBy("d").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        joined = numbered.join(met.withColumnRenamed("d", "r"), "r", "left")
        rows = _summed(joined.select("d", "t", "runs", F.coalesce("items", F.array().cast("array<string>")).alias("items")))
    id_ = F.col("d").alias("row") if whole else F.col(f"d.`{id_col}`").alias(id_col)
    return rows.select(id_, "n_words", "n_hit", "items", "spans", ((F.col("n_hit") > 0) & (F.lit(least) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def query(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: Lower-casing A-Z only is spelled out with translate(); every table is read whole.
SQL = r"""
WITH norm AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k:k + 12], ' ') AS p
  FROM item, LATERAL unnest(range(1, greatest(1, len(w) - 12) + 1)) AS u(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT r, doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS p
  FROM norm, sizes, LATERAL unnest(range(1, len(w) - n + 2)) AS u(k) WHERE len(w) >= n),
hit AS (SELECT r, n, k, item_id FROM place JOIN win USING (n, p)),
words AS (SELECT DISTINCT r, x FROM hit, LATERAL unnest(range(k, k + n)) AS u(x)),
n_hit AS (SELECT r, count(*) AS n_hit FROM words GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, cast(item_id AS varchar) AS i FROM hit) GROUP BY r)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM norm LEFT JOIN n_hit USING (r) LEFT JOIN items USING (r)
"""
