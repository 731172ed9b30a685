"""Fill-in-middle transformation over succinct token boundaries.

The last byte of every token is a 1 in a packed bit vector over a slice of whole texts; a directory holds the number of ones
before each block of BLOCK words. rank of a text's end less rank of its start, popcounts both, is its number of tokens n, and
select on the ranks of the two cuts gives the bytes where prefix and middle end. No token is ever made as a string.

A token is `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`, so one ends where a byte that is no white space is
followed by one that is, and at the end of the text; UTF-8 bytes over 127 are never white space.

Defined cases: null is an empty text; empty texts, texts with one of the three marks in them and those that the draw leaves
alone stay as they are (plain); a null id draws as the empty text; repeated rows each give a row, with the same draw for the
same id; other columns go along in `row` where asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import SPACE, hex_digest, prepare, slices, table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of texts that are transformed, percent of these in suffix-prefix-middle order, and what the draw is salted with.
RATE, SPM_RATE, SEED = 50, 80, 42
#: 64-bit words in a block of the directory.
BLOCK = 8


class Bits:
    """A packed bit vector with rank and select, both for many arguments at once."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        size = -(-len(packed) // (8 * BLOCK)) * BLOCK + BLOCK  # whole blocks and an empty one, so that rank(len) has a word
        self.words = np.zeros(size, dtype="<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        in_block = np.cumsum(np.bitwise_count(self.words).reshape(-1, BLOCK), axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(in_block[:, -1])])  # ones before each block

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        block = word // BLOCK
        total = self.before[block]
        for k in range(BLOCK):
            here = block * BLOCK + k
            total = total + np.where(here < word, np.bitwise_count(self.words[here]), 0)
        return total + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self, which: np.ndarray) -> np.ndarray:
        """The position of the one with each number, from 0; they have to be there."""
        block = np.searchsorted(self.before, which, side="right") - 1
        left, word, found = which - self.before[block], block * BLOCK, np.zeros(len(which), dtype=bool)
        for _ in range(BLOCK):
            ones = np.bitwise_count(self.words[word]).astype(np.int64)
            found |= left < ones
            left, word = np.where(found, left, left - ones), np.where(found, word, word + 1)
        x, at = self.words[word].copy(), np.zeros(len(which), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # halves of the word, the lower one first
            low = x & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(low).astype(np.int64)
            up = left >= ones
            left, at, x = np.where(up, left - ones, left), at + width * up, np.where(up, x >> np.uint64(width), low)
        return (word << 6) + at


def boundaries(buf: np.ndarray, offsets: np.ndarray) -> Bits:
    """A one at the last byte of every token."""
    bits = np.zeros(len(buf), dtype=bool)
    if len(buf):
        white = SPACE[buf]
        bits[:-1] = ~white[:-1] & white[1:]
        bits[offsets[1:][np.diff(offsets) > 0] - 1] = True
    return Bits(bits)


def draw(ids: list, seed: int = SEED) -> np.ndarray:
    """Four numbers for each id: the first 8-digit groups of the SHA-256 of `seed:id`."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, dtype=">u4").reshape(-1, 4).astype(np.int64)


def cuts(buf: np.ndarray, offsets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the number of tokens and the bytes where prefix and middle end."""
    bits = boundaries(buf, offsets)
    ranks = bits.rank(offsets)
    n = np.diff(ranks)
    picked = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    out = np.repeat(offsets[:-1, None], 2, axis=1)
    some = picked > 0  # no token before the cut: it is where the text begins
    out[some] = bits.select((ranks[:-1, None] + picked)[some] - 1) + 1
    return n, out[:, 0], out[:, 1]


def assemble(prefix: bytes, middle: bytes, suffix: bytes, form: str) -> bytes:
    if form == "psm":
        return b"".join([PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle])
    return b"".join([SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle])


def restore(output: bytes, form: str) -> bytes:
    """The text again. Neither text nor marks have a mark inside or across their seams, so the first of each is the one that was set."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    rest, _, middle = output[len(first) :].partition(MIDDLE)
    a, _, b = rest.partition(second)
    return a + middle + b if form == "psm" else b + middle + a


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, whole: bool = False, digests: bool = False) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars (null if plain) and output; row with all columns where `whole`.

    With digests, output_sha256 and restored_sha256 (of the text rebuilt from output and form) stand in the place of output, so
    that no text leaves the task.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    last = "output_sha256 string, restored_sha256 string" if digests else "output string"
    columns = [F.col(f"`{id_col}`").alias("d"), F.col(f"`{text_col}`").alias("t")] + ([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else [])
    schema = StructType.fromDDL(f"d {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, {last}")
    if whole:
        schema = schema.add("row", docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in slices(batches, "t"):
            h = draw(rows.column("d").to_pylist(), seed)
            n, a, b = cuts(buf, offsets, h)
            chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # code points before each byte
            forms, outs, backs = [], [], []
            view = buf.tobytes()
            for k in range(rows.num_rows):
                text = view[offsets[k] : offsets[k + 1]]
                plain = not text or h[k, 2] % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text
                form = "plain" if plain else "spm" if h[k, 3] % 100 < spm_rate else "psm"
                out = text if plain else assemble(view[offsets[k] : a[k]], view[a[k] : b[k]], view[b[k] : offsets[k + 1]], form)
                forms.append(form)
                outs.append(hex_digest(out) if digests else out)
                if digests:
                    backs.append(hex_digest(restore(out, form)))
            gone = np.array([f == "plain" for f in forms])
            sizes = [pa.array(chars[y] - chars[x], pa.int64(), mask=gone) for x, y in ((offsets[:-1], a), (a, b))]
            results = [pa.array(outs, pa.string()), pa.array(backs, pa.string())] if digests else [pa.array(outs, pa.binary()).cast(pa.string())]
            arrays = [rows.column("d"), pa.array(n), pa.array(forms, pa.string()), *sizes, *results] + ([rows.column("row")] if whole else [])
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(*columns).mapInArrow(run, schema).withColumnRenamed("d", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return transform(table(spark, sf_dir, "documents"), digests=True)


#: DuckDB has no SHA-256 of raw bytes to compare with but sha256(text), which is the digest of its UTF-8.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(cast(doc_id AS varchar), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM d),
n AS (SELECT *, len(w) AS n, cast('0x' || substr(h, 1, 8) AS bigint) AS h1, cast('0x' || substr(h, 9, 8) AS bigint) AS h2,
  cast('0x' || substr(h, 17, 8) AS bigint) AS h3, cast('0x' || substr(h, 25, 8) AS bigint) AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, cast(n AS bigint) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
