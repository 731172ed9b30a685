"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters' numbers, so that words of the same letters share a key, and one more,
one less or another letter moves it by a known value. Each word is laid down under its own key and under its key less each of
its letters; a longer and a shorter word meet where the longer one's key less a letter is the shorter one's key (addition,
removal), two words of one length where both keys less a different letter are the same (exchange). Keys say nothing of order:
each met pair is verified to differ by one inserted, deleted or replaced code point. Equal sums of different letters would only
be met in vain.

Exchange lists over HOT words (anagrams of one another, but for a letter) are split: two words that differ in one place agree in
their first or in their second half, so such a list's words meet by list and half, none is lost, and no list grows with the
number of orders of its letters.

Words are counted in Arrow batches, slice by slice, before any shuffle; everything later works on distinct words.

Defined cases: null and empty texts have no words; repeated rows count each time (a run is altered by its id and itself alone);
a null id counts as empty text; words under MIN_LETTERS code points or MIN_COUNT occurrences are no words; without words the
result is empty. Ties of the largest n go to the smallest word in code-point order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LETTER, LOWER, Steps, binary_parts, prepare, slices, table

MIN_LETTERS, MIN_COUNT, RATIO, ALTER = 6, 5, 5, 199
POWER, HOT = 5, 256
#: Distinct words that a task counts before it hands them on.
HELD = 200_000

_CRC = np.array([zlib.crc32(bytes([k])) ^ zlib.crc32(b"\0") for k in range(256)], dtype=np.uint32)  # crc32 is linear: what a byte adds to a zero byte's


def letter_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and code points of the maximal runs [A-Za-z\\u00C0-\\u00FF]+ of all texts; the latter are the bytes C3 80 to C3 BF."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    lead = buf == 0xC3
    inside = LETTER[buf] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    edge[1:-1] = inside[1:] != inside[:-1]
    starts = edge[:-1] & inside
    ends = edge[1:] & inside
    seams = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(buf))]  # texts lie side by side: no run crosses a seam
    starts[seams[inside[seams]]] = True
    ends[seams[inside[seams - 1]] - 1] = True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    wide = np.concatenate([[0], np.cumsum(lead)])
    return starts, ends, ends - starts - (wide[ends] - wide[starts])


def crc32s(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """crc32 of each piece of buf, carried on from the crc32 of what goes before it."""
    order = np.argsort(starts - ends, kind="stable")  # longest first: those that still have bytes are a prefix
    lengths, at = (ends - starts)[order], starts[order]
    state = ~first[order].astype(np.uint32)
    alive = len(order)
    for k in range(int(lengths[0]) if alive else 0):
        while alive and lengths[alive - 1] <= k:
            alive = int(np.searchsorted(-lengths[:alive], -k, side="left"))
        part = state[:alive]
        state[:alive] = _CRC[(part ^ buf[at[:alive] + k]) & 0xFF] ^ (part >> np.uint32(8))
    out = np.empty(len(order), dtype=np.uint32)
    out[order] = ~state
    return out


def _counts(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray, alter: int, least: int) -> tuple[list[bytes], np.ndarray]:
    """The words of a slice of texts, altered runs apart, each with a number of occurrences."""
    buf = LOWER[buf]
    starts, ends, chars = letter_runs(buf, offsets)
    long = chars >= least
    starts, ends, chars = starts[long], ends[long], chars[long]
    if not len(starts):
        return [], np.zeros(0, np.int64)
    first = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in rows.column("d").to_pylist()], dtype=np.uint32)
    h = crc32s(buf, starts, ends, first[np.searchsorted(offsets, starts, side="right") - 1])
    hit = h % alter == 0
    parts = np.zeros(2 * len(starts), dtype=np.int64)
    parts[0::2], parts[1::2] = starts, ends
    coded = binary_parts(buf, np.append(parts, len(buf))).take(pa.array(np.flatnonzero(~hit) * 2)).dictionary_encode()
    words, n = coded.dictionary.to_pylist(), np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary))
    for k in np.flatnonzero(hit & (chars > least)):  # shorter ones fall short of `least` by the removal
        run = buf[starts[k] : ends[k]].tobytes().decode()
        at = int(h[k]) % len(run)
        words.append((run[:at] + run[at + 1 :]).encode())
    return words, np.concatenate([n, np.ones(len(words) - len(n), dtype=np.int64)])


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alter: int = ALTER, least: int = MIN_LETTERS, often: int = MIN_COUNT) -> DataFrame:
    """word, n of the words of at least `least` code points and `often` occurrences."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        size = 0
        for rows, buf, offsets in slices(batches, "t"):
            for word, n in zip(*_counts(rows, buf, offsets, alter, least), strict=True):
                size += len(word) if word not in held else 0
                held[word] = held.get(word, 0) + int(n)
            if len(held) > HELD or size > 32 << 20:
                yield handed()
                size = 0
        yield handed()

    parts = docs.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text_col}`").alias("t")).mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def letter_value(letter):
    """The power of a letter's number: a to z are 1 to 26, U+00C0 to U+00FF 27 to 90."""
    number = F.when(letter <= "z", F.ascii(letter) - 96).otherwise(F.ascii(letter) - 0xC0 + 27)
    return F.pow(number.cast("double"), F.lit(float(POWER))).cast("long")  # at most 90^5: exact in a double


def anagram_keys(words: DataFrame) -> DataFrame:
    """word, key, letters (the distinct ones)."""
    each = F.split("word", "")
    return words.select("word", F.aggregate(F.transform(each, letter_value), F.lit(0).cast("long"), lambda a, x: a + x).alias("key"), F.array_distinct(each).alias("letters"))


def one_apart(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    return F.levenshtein(a, b, 1) == 1


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """a, b of every pair of words that differ in one code point, each pair once: words of one length in no order, else a the longer one."""
    steps = Steps(words.sparkSession)
    own = steps.write(anagram_keys(words), "anagram-keys")
    less = own.select("word", F.explode("letters").alias("letter"), F.length("word").alias("size"), "key").withColumn("rest", F.col("key") - letter_value(F.col("letter")))
    longer, shorter = less.select(F.col("word").alias("a"), "rest"), own.select(F.col("word").alias("b"), F.col("key").alias("rest"))
    added = longer.join(shorter, "rest").where(one_apart(F.col("a"), F.col("b"))).select("a", "b")
    crowd = less.groupBy("rest", "size").agg(F.count("*").alias("members")).where(F.col("members") > 1)  # a list of one has no pair
    lists = steps.write(less.join(crowd, ["rest", "size"]).select("word", "letter", "rest", "size", (F.col("members") > hot).alias("hot")), "anagram-lists")
    half = F.floor(F.col("size") / 2).cast("int")
    sides = F.array(F.concat(F.lit("<"), F.left("word", half)), F.concat(F.lit(">"), F.substring(F.col("word"), half + 1, F.col("size"))))
    split = lists.select("word", "letter", "rest", "size", F.explode(F.when(F.col("hot"), sides).otherwise(F.array(F.lit("")))).alias("side"))
    x, y = split.select(F.col("word").alias("a"), F.col("letter").alias("la"), "rest", "size", "side"), split.select(F.col("word").alias("b"), F.col("letter").alias("lb"), "rest", "size", "side")
    exchanged = x.join(y, ["rest", "size", "side"]).where((F.col("la") < F.col("lb")) & one_apart(F.col("a"), F.col("b"))).select("a", "b")
    return steps.write(added.union(exchanged), "near-words")  # words that differ in one place agree in one half only: no pair comes twice


def variants(words: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n)."""
    spark = words.sparkSession
    steps = Steps(spark)
    words = steps.write(words.select("word", "n"), "vocabulary")
    pairs = near_pairs(words.select("word"))
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    best = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("other_n"), "other")).alias("best"))
    held = words.join(best, "word", "left").withColumn("fits", F.coalesce(-F.col("best.col1") >= ratio * F.col("n"), F.lit(False)))
    held = held.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), F.col("best.other")).alias("form"), F.when(F.col("fits"), -F.col("best.col1")).alias("form_n"))
    held = steps.write(held, "forms")
    links = steps.write(held.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots-0")
    k = 0
    while True:  # each round doubles how far a root is followed; n grows `ratio` times a step, so a few rounds reach any end
        k += 1
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.write(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{k}")
        steps.drop(f"roots-{k - 1}")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return held.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of docs with their forms and roots."""
    return variants(vocabulary(docs, id_col=id_col, text_col=text_col))


def query(spark, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))


#: crc32 by its definition, bit by bit, over the distinct runs of a document; near words by what is left when one code point goes.
SQL = r"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY k) AS c FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda a, i: xor(a >> 1, (a & 1) * 3988292384)) AS v FROM (SELECT unnest(range(256)) AS k))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
bytes AS (SELECT *, hex(encode(coalesce(cast(doc_id AS varchar), '') || ':' || run)) AS x FROM each),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) AS bigint))), lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1]))) AS h FROM bytes, crc),
altered AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, cast(sum(n) AS bigint) AS n FROM altered WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
named AS (SELECT word, min(other) AS other FROM near JOIN best USING (word) WHERE other_n = top GROUP BY word),
held AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * n THEN other END AS form, CASE WHEN top >= 5 * n THEN top END AS form_n FROM w LEFT JOIN best USING (word) LEFT JOIN named USING (word)),
walk AS (SELECT word, word AS at FROM held UNION ALL SELECT walk.word, held.form FROM walk JOIN held ON walk.at = held.word WHERE held.form IS NOT NULL)
SELECT h.word, h.form, walk.at AS root, h.n, h.n_near, h.form_n FROM held h JOIN walk ON h.word = walk.word JOIN held e ON walk.at = e.word WHERE e.form IS NULL
"""
