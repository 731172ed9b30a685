"""Token-id files in Simple-8b: 64-bit words of a 4-bit selector and 60 payload bits.

A file is a run of records, each followed by one line feed (the separator of Spark's text writer, which commits raw bytes
to any store). A record holds whole documents:

    bytes 0-3 "S8B1"; then little-endian int64: documents, ids, words, escapes
    documents x int64 document id, documents x int64 ids per document
    one int64 per BLOCK words: ids before that block; one int64 per BLOCK words: escapes before that block
    words x uint64 (selector in the top 4 bits, first id in the lowest bits), escapes x uint32

An id that needs over 14 bits and a bit pattern is escaped: its 15-bit slot holds 32767 and the id is the next escape. So any
32-bit id can be stored, and the offsets of a block suffice to decode it alone, all its words of a selector at once.

Defined cases: null texts are empty and hold the end id alone; repeated document ids are kept, ordered by text; null document
ids are stored as the smallest 64-bit integer; documents of any length stay in one record; no documents give no records.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import SLICE_BYTES, Memo, held, materialize, prepare, scratch, slices, table, uniques, word_cuts

#: Fixed values of the coding: (ids in a word, bits of each), by selector.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15)]
ESCAPE = 32767
#: Words of a block, and records of a file.
BLOCK, FILE_RECORDS = 1024, 16
#: Code points of a text that divide the rows of one id among tasks; their order is the text's.
HEAD = 64
MAGIC, NO_ID = b"S8B1", -(1 << 63)
MEMO = 1_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Byte-level vocabularies name a byte that is no printable Latin-1 character by the next code point from 256 on.
_NAMES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """uint64 words, uint32 escapes and the ids held by each word."""
    n = len(ids)
    slot = np.minimum(ids, ESCAPE).astype(np.int64)
    escapes = ids[slot == ESCAPE].astype(np.uint32)
    need = np.zeros(n, dtype=np.int8)  # bits of each slot
    for bits in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15):
        need[slot >= 1 << (bits - 1 if bits <= 8 else {10: 8, 12: 10, 15: 12}[bits])] = bits
    # from each position the longest run of ids that fits, by selector from the widest slot to the narrowest
    choice = np.full(n, len(SELECTORS) - 1, dtype=np.int8)
    for s in range(len(SELECTORS) - 2, -1, -1):
        count, bits = SELECTORS[s]
        if n < count or not (need[count - 1 :: count] <= bits).any():
            continue  # no run of so many
        small = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(need > bits, out=small[1:])
        choice[: n - count + 1][small[count:] == small[: n - count + 1]] = s
    step = np.array([c for c, _ in SELECTORS], dtype=np.int64)[choice].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, dtype=np.int64)
    selector = choice[starts].astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    words = selector.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([slot, np.zeros(240, dtype=np.int64)]).astype(np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(selector == s)
        if bits and len(own):
            for k in range(count):
                words[own] |= padded[starts[own] + k] << np.uint64(k * bits)
    held = np.minimum(np.append(starts[1:], n) - starts, n) if len(starts) else np.zeros(0, np.int64)
    return words, escapes, held


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of the words, all words of a selector at once."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS], dtype=np.int64)[selector]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint32)
    for s, (count, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(selector == s)
        if bits and len(own):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[starts[own][:, None] + np.arange(count)] = (words[own][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    out = out[:n]
    out[out == ESCAPE] = escapes
    return out


def record(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, escapes, held = pack(ids)
    before = np.concatenate([[0], np.cumsum(held)])[:-1][::BLOCK] if len(held) else np.zeros(0, np.int64)
    hidden = np.concatenate([[0], np.cumsum(np.minimum(ids, ESCAPE) == ESCAPE)])[before] if len(before) else before
    head = MAGIC + struct.pack("<4q", len(doc_ids), len(ids), len(words), len(escapes))
    return b"".join([head, *(np.asarray(x).astype(t).tobytes() for x, t in ((doc_ids, "<i8"), (counts, "<i8"), (before, "<i8"), (hidden, "<i8"), (words, "<u8"), (escapes, "<u4")))])


class Record:
    """One record in a buffer, from an offset on."""

    def __init__(self, data, at: int = 0):
        if bytes(data[at : at + 4]) != MAGIC:
            raise ValueError(f"no record at byte {at}")
        n, self.n_ids, w, e = struct.unpack("<4q", data[at + 4 : at + 36])
        blocks = -(-w // BLOCK)
        at += 36
        fields = []
        for count, kind in ((n, "<i8"), (n, "<i8"), (blocks, "<i8"), (blocks, "<i8"), (w, "<u8"), (e, "<u4")):
            fields.append(np.frombuffer(data, dtype=kind, count=count, offset=at))
            at += fields[-1].nbytes
        self.doc_ids, self.counts, self.before, self.hidden, self.words, self.escapes = fields
        self.end = at

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids first to last (not included), decoding only the blocks that hold them."""
        last = self.n_ids if last is None else min(last, self.n_ids)
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = int(np.searchsorted(self.before, first, side="right")) - 1, int(np.searchsorted(self.before, last))
        whole = b >= len(self.before)
        n = (self.n_ids if whole else int(self.before[b])) - int(self.before[a])
        escapes = self.escapes[self.hidden[a] : None if whole else self.hidden[b]]
        return unpack(self.words[a * BLOCK : b * BLOCK], escapes, n)[first - self.before[a] : last - self.before[a]]


def records(data: bytes) -> Iterator[Record]:
    at = 0
    while at < len(data):
        r = Record(data, at)
        yield r
        at = r.end + 1


class Encoder:
    """Whole texts to ids by a tokenizers file that lower-cases and drops white space; each distinct chunk is encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), Memo(MEMO)
        self.tokenizer.encode_special_tokens = True

    def chunks(self, chunks: list[bytes]) -> list[list[int]]:
        words = [c.strip(b" \n") for c in chunks]
        out: list = [None] * len(words)
        one = self.tokenizer.model.tokenize
        rest = []
        for k, w in enumerate(words):
            if w.isalpha():  # ASCII letters: one piece, that no normalizer changes
                out[k] = [t.id for t in one(w.decode())]
            elif (u := w.decode()).isalpha() and u.islower() and is_normalized("NFC", u):  # the same, but for its bytes' names
                out[k] = [t.id for t in one(w.decode("latin-1").translate(_NAMES))]
            else:
                rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([words[k].decode() for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of several texts as one array, and the texts' n + 1 offsets into it."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        buf = _LOWER[buf]
        cuts = word_cuts(buf, offsets)
        at, distinct = uniques(buf, cuts)
        ids, ends = self.memo.ids(self.memo.find(distinct, self.chunks)[at])
        return ids, ends[np.searchsorted(cuts, offsets)]


def encoder(path: str) -> Encoder:
    return held(("tokens", path), lambda: Encoder(path))


def write(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> None:
    """Write all documents in ascending order of id; each record holds the documents of about SLICE_BYTES of text.

    Rows of one id, or of none, are divided by how their texts begin, so that only rows that share both are one task's; it sorts
    them with spills and streams them.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for rows, buf, offsets in slices(batches, "t", 2 * SLICE_BYTES):
            ids, ends = e.encode(buf, offsets)
            n = len(ends) - 1
            full = np.full(len(ids) + n, end_id, dtype=np.uint32)
            full[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(ends))] = ids
            yield pa.RecordBatch.from_arrays([pa.array([record(np.asarray(rows.column("d")), np.diff(ends) + 1, full)], pa.binary())], names=["b"])

    ordered = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.col(text_col).alias("t")).repartitionByRange("d", F.substring("t", 1, HEAD)).sortWithinPartitions("d", "t")
    ordered.mapInArrow(run, "b binary").select(F.col("b").cast("string")).write.option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _files(spark, path: str) -> DataFrame:
    """Files and their order: parts are numbered by range of id, and their files by record."""
    name = F.regexp_extract("path", r"part-(\d+)-.*-c(\d+)\.[^/]*$", 0)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.concat(F.lpad(F.regexp_extract(name, r"part-(\d+)-", 1), 12, "0"), F.lpad(F.regexp_extract(name, r"-c(\d+)\.", 1), 12, "0")).alias("f"), "content")


def read(spark, path: str) -> DataFrame:
    """doc_id and ids (array of bigint), read from files."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for r in records(content.as_buffer()):
                    yield pa.RecordBatch.from_arrays([_ids(r), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(r.counts)]), pa.int32()), pa.array(r.ids().astype(np.int64)))], names=["doc_id", "ids"])

    return _files(spark, path).mapInArrow(run, "doc_id bigint, ids array<bigint>")


def _ids(r: Record) -> pa.Array:
    return pa.array(r.doc_ids.astype(np.int64), mask=np.asarray(r.doc_ids == NO_ID))


def index(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files; totals of files are summed, never rows of one task."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, content in zip(batch.column("f"), batch.column("content")):
                start = 0
                for r in records(content.as_buffer()):
                    data, ends = r.ids().astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(r.counts)])
                    crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array([f.as_py()] * len(crc)), _ids(r), pa.array(ends[:-1] + start), pa.array(r.counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["f", "doc_id", "at", "n_tokens", "ids_crc32"])
                    start += int(ends[-1])

    found = materialize(_files(spark, path).mapInArrow(run, "f string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"), "token-index")
    totals = found.groupBy("f").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("f", F.coalesce(F.sum("n").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    return found.join(before, "f").select("doc_id", (F.col("at") + F.col("b")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return index(spark, path)
