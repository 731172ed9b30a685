"""Byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

Texts are cut where every match of the splitting pattern ends, and each distinct piece is encoded once per slice: pieces of
about one length form a padded matrix of token ids, and each round every row merges its leftmost pair of minimum rank. The
pair's rank comes from an open-addressed hash table held in numpy arrays; rows that have no pair left are taken out
(compaction), the others move their tails up by one.

A piece of over LONG bytes (an unbroken run of letters or of white space) would move its whole row up at every merge. Its
pairs wait in a heap by rank and place instead, which gives the same merges in the same order.

Defined cases: null texts are empty; an empty text has no ids; lone pieces of any length are encoded whole; repeated rows
each give a row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import SLICE_BYTES, WHITE, Memo, held, joined_cuts, prepare, ragged, slices, table, uniques

#: Cells of a padded matrix, and remembered pieces of a worker.
MATRIX_CELLS, MEMO = 1 << 18, 200_000
#: Bytes of a piece that is too long for a matrix.
LONG = 1024
NONE = np.int64(1) << 40


class Ranks:
    """A rank file as arrays: id of each byte, and (left id, right id) -> id of the merged token, which is its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for t, r in ranks.items():
            self.tokens[r] = t
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        pairs = [(ranks[t[:k]] << 20 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.bits = max(4, (3 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int64)
        keys, values = np.array([k for k, _ in pairs], dtype=np.int64), np.array([v for _, v in pairs], dtype=np.int64)
        slot, self.probes = self._hash(keys), 0
        while len(keys):  # every round each free slot takes one of its keys, the others go on to the next slot
            self.probes += 1
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            took = self.keys[slot] == keys
            self.values[slot[took]] = values[took]
            keys, values, slot = keys[~took], values[~took], (slot[~took] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it doesn't merge; negative ids are padding."""
        keys = left << 20 | right
        slot, out = self._hash(keys), np.full(len(keys), NONE, dtype=np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.probes):
            here = self.keys[slot[todo]]
            hit = here == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (here >= 0)]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
        return out


def _merge(matrix: np.ndarray, lengths: np.ndarray, ranks: Ranks) -> list[np.ndarray]:
    """Ids of each row of a matrix of byte ids padded with -1."""
    out: list = [None] * len(matrix)
    rows = np.arange(len(matrix))
    m, n = matrix, lengths.copy()
    pair = ranks.rank(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(m), -1) if m.shape[1] > 1 else np.full((len(m), 1), NONE)
    while len(rows):
        at = pair.argmin(axis=1)
        best = pair[np.arange(len(m)), at]
        done = best == NONE
        if done.any():
            for i in np.flatnonzero(done):
                out[rows[i]] = m[i, : n[i]].astype(np.uint32)
            keep = ~done
            rows, m, n, pair, at, best = rows[keep], m[keep], n[keep], pair[keep], at[keep], best[keep]
            if not len(rows):
                break
            width = max(2, int(n.max()))
            m, pair = m[:, :width], pair[:, : width - 1]
        r, width = np.arange(len(m)), m.shape[1]
        source = np.arange(width)[None, :] + (np.arange(width)[None, :] > at[:, None])
        padded = np.concatenate([m, np.full((len(m), 1), -1, dtype=m.dtype)], axis=1)
        padded[r, at] = best
        m = np.take_along_axis(padded, source, axis=1)
        n -= 1
        wide = np.concatenate([pair, np.full((len(m), 1), NONE)], axis=1)
        pair = np.take_along_axis(wide, source[:, :-1], axis=1)
        pair[r, np.minimum(at, width - 2)] = ranks.rank(m[r, at], np.where(at + 1 < width, m[r, np.minimum(at + 1, width - 1)], -1))
        left = at > 0
        pair[r[left], at[left] - 1] = ranks.rank(m[r[left], at[left] - 1], m[r[left], at[left]])
    return out


def _merge_long(piece: bytes, ranks: Ranks) -> np.ndarray:
    """Ids of one long piece: the leftmost pair of minimum rank comes off a heap, its neighbours are looked up anew."""
    ids = ranks.byte_id[np.frombuffer(piece, dtype=np.uint8)]
    first = ranks.rank(ids[:-1], ids[1:])
    n, token, tokens, find = len(ids), ids.tolist(), ranks.tokens, ranks.ranks.get
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(int(first[i]), i) for i in np.flatnonzero(first != NONE).tolist()]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if token[i] < 0 or j >= n or find(tokens[token[i]] + tokens[token[j]]) != rank:
            continue  # one of the two has been merged since
        token[i], token[j], after[i] = rank, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n and (new := find(tokens[token[a]] + tokens[token[after[a]]])) is not None:
                heapq.heappush(heap, (new, a))
    return np.array([t for t in token if t >= 0], dtype=np.uint32)


def encode_pieces(pieces: list[bytes], ranks: Ranks) -> list[np.ndarray]:
    """Ids of each piece; one that is a token itself needs no merge."""
    out: list = [None] * len(pieces)
    rest = []
    for k, p in enumerate(pieces):
        r = ranks.ranks.get(p)
        if r is None and len(p) > LONG:
            out[k] = _merge_long(p, ranks)
        elif r is None and p:
            rest.append(k)
        else:
            out[k] = np.array([r], dtype=np.uint32) if p else np.zeros(0, np.uint32)
    rest.sort(key=lambda k: len(pieces[k]))
    start = 0
    while start < len(rest):
        # one bucket: lengths within a quarter of the shortest, cells within the bound
        low = len(pieces[rest[start]])
        end = start + 1
        most = low + low // 4
        while end < len(rest) and len(pieces[rest[end]]) <= most and (end - start + 1) * len(pieces[rest[end]]) <= MATRIX_CELLS:
            end += 1
        group = rest[start:end]
        lengths = np.array([len(pieces[k]) for k in group], dtype=np.int64)
        width = int(lengths.max())
        m = np.full((len(group), width), -1, dtype=np.int64)
        m[np.arange(width)[None, :] < lengths[:, None]] = ranks.byte_id[np.frombuffer(b"".join(pieces[k] for k in group), dtype=np.uint8)]
        for k, ids in zip(group, _merge(m, lengths, ranks)):
            out[k] = ids
        start = end
    return out


def space_cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cuts before each single space between characters that are surely not white space; the pattern has a match start there."""
    n = len(buf)
    marks = np.zeros(n, dtype=bool)
    if n > 2:
        # bytes that may end a white space character, by its lead byte, and lead bytes of such
        lead = (buf == 0xC2) | (buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3)
        doubt = WHITE[buf]
        doubt[1:] |= (buf[1:] >= 128) & lead[:-1]
        doubt[2:] |= (buf[2:] >= 128) & lead[:-2]
        after = WHITE[buf] | lead
        marks[1:-1] = (buf[1:-1] == 32) & ~doubt[:-2] & ~after[2:]
    return joined_cuts(marks, offsets, n)


class Codec:
    """Encodes and decodes with one rank file and one splitting pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.split, self.memo, self.words = Ranks(path), regex.compile(pattern), Memo(MEMO), Memo(MEMO)

    def chunks(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of each chunk: the matches of the pattern in it, each encoded apart."""
        split = [[m.encode() for m in self.split.findall(c.decode())] for c in chunks]
        distinct = list(dict.fromkeys(p for ps in split for p in ps))
        ids, ends = self.words.ids(self.words.find(distinct, lambda new: encode_pieces(new, self.ranks)))
        ids, ends = ids.tolist(), ends.tolist()
        of = {p: ids[a:b] for p, a, b in zip(distinct, ends[:-1], ends[1:])}
        return [of[ps[0]] if len(ps) == 1 else [i for p in ps for i in of[p]] for ps in split]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of several texts as one array, and the texts' n + 1 offsets into it."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cuts = space_cuts(buf, offsets)
        at, distinct = uniques(buf, cuts)
        ids, ends = self.memo.ids(self.memo.find(distinct, self.chunks)[at])
        return ids, ends[np.searchsorted(cuts, offsets)]

    def decode(self, ids: np.ndarray) -> bytes:
        r = self.ranks
        return r.bytes[ragged(r.starts[ids], r.lengths[ids])].tobytes()


def codec(path: str, pattern: str) -> Codec:
    return held(("bpe", path, pattern), lambda: Codec(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int) of every row."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for rows, buf, offsets in slices(batches, "t", SLICE_BYTES):
            ids, ends = c.encode(buf, offsets)
            yield pa.RecordBatch.from_arrays([rows.column("d"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))], names=["d", "ids"])

    return docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).mapInArrow(run, f"d {kind}, ids array<int>").withColumnRenamed("d", id_col)


def decode(coded: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text bytes (binary) of every row of ids; null ids are none."""
    prepare(coded.sparkSession)
    kind = coded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            texts = [c.decode(np.asarray(x.values, dtype=np.int64)) if x.is_valid else b"" for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(texts, pa.binary())], names=["d", "bytes"])

    return coded.select(F.col(id_col).alias("d"), F.col(ids_col).alias("ids")).mapInArrow(run, f"d {kind}, bytes binary").withColumnRenamed("d", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (ids as little-endian uint32) and decoded_sha256, in one pass that ships no ids to Spark."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for rows, buf, offsets in slices(batches, "t", SLICE_BYTES):
            ids, ends = c.encode(buf, offsets)
            wire = ids.astype("<u4").tobytes()
            back = c.decode(ids)
            sizes = np.concatenate([[0], np.cumsum(c.ranks.lengths[ids])])[ends]
            digest = lambda data, e: [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(e[:-1], e[1:])]
            yield pa.RecordBatch.from_arrays([rows.column("d"), pa.array(np.diff(ends)), pa.array(digest(wire, (4 * ends).tolist())), pa.array(digest(back, sizes.tolist()))], names=["d", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).mapInArrow(run, f"d {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("d", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
