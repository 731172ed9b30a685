"""What the operators of this subpackage share: shared storage, Arrow batches as flat byte buffers, chunks of text."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Bytes of text that a Python worker takes at once; its numpy temporaries are a small multiple of it.
SLICE_BYTES = 2 << 20
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of very long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; only where that is unset and all is one process (tests), one is set here."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file:///tmp/checkpoints/provena"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended: the folder's owner cleans up
        pass


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def discard(df: DataFrame, path: str) -> None:
    _remove(df.sparkSession, path)


#: While a table is written, Spark deletes the shuffle files of that job as soon as it ends: nothing else reads them.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df once to the shared folder and read it back: short lineage that survives lost executors."""
    return _write(df, scratch(df.sparkSession, what))


class Steps:
    """The tables that one operator writes on its way, dropped as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, what: str) -> DataFrame:
        self.paths[what] = scratch(self.spark, what)
        return _write(df, self.paths[what])

    def drop(self, *names: str) -> None:
        for what in names:
            if what in self.paths:
                _remove(self.spark, self.paths.pop(what))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Nulls as empty; all bytes as one uint8 array, and n + 1 offsets into it."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else pa.binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    wide = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    bytes_ = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows with about `limit` bytes of text, one row at least; whole texts always."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, offsets = flat(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start), buf[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            start = end
    release()


def binary_parts(buf: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The pieces of buf between consecutive cuts."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])


def uniques(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each piece of buf its number among the distinct pieces, and those."""
    coded = binary_parts(buf, cuts).dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary.to_pylist()


def joined_cuts(marks: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Sorted cut positions: those marked, the edges of documents, 0 and size."""
    marks = marks.copy()
    if size:
        edges = offsets[(offsets < size)]
        marks[edges] = True
        marks[0] = True
    return np.append(np.flatnonzero(marks), size)


def word_cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cuts before white space, and between an ASCII letter and an ASCII character that is neither a letter nor an apostrophe.

    Such places end a token for every splitter that keeps letters, digits and punctuation apart.
    """
    marks = np.zeros(len(buf), dtype=bool)
    if len(buf) > 1:
        white, letter = SPACE[buf], LETTER[buf]
        other = (buf < 128) & ~letter & ~white & (buf != 39)
        marks[1:] = white[1:] & ~white[:-1]
        marks[1:] |= (letter[1:] & other[:-1]) | (letter[:-1] & other[1:])
    return joined_cuts(marks, offsets, len(buf))


def packed(df: DataFrame, text_col: str = "t") -> DataFrame:
    """The text column compressed, as z (null stays null), before a shuffle: texts make most of what moves."""
    rest = [c for c in df.columns if c != text_col]
    df = df.select(*rest, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [z.compress(t.as_buffer()) if t.is_valid else None for t in batch.column(text_col).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], names=[*rest, "z"])

    return df.mapInArrow(run, df.select(*rest).schema.add("z", "binary"))


def unpacked(z: bytes | None) -> bytes:
    return zstandard.decompress(z) if z is not None else b""


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library keeps its own books
    _trim = lambda _: 0


def release() -> None:
    """Give memory that is free again back to the system: workers live on, and the next operator needs it elsewhere."""
    pa.default_memory_pool().release_unused()
    _trim(0)


_held: dict = {}


def held(key, make):
    """The one object that a Python worker keeps between batches: a loaded vocabulary, model or automaton with its memo.

    Workers serve one operator after another; what another one has left is dropped first.
    """
    if key not in _held:
        drop_held()
        _held[key] = make()
    return _held[key]


def drop_held() -> None:
    """For operators that keep nothing: what another one has left goes at once."""
    if _held:
        _held.clear()
        release()


def hex_digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


class Memo:
    """Remembers the ids of chunks in flat arrays. It only saves work, and is emptied when it holds over `limit` chunks."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.used, self.store = 0, np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def find(self, chunks: list[bytes], make) -> np.ndarray:
        """The numbers of distinct chunks; make(new chunks) gives a list of ids for each that isn't known."""
        if len(self.at) > self.limit:
            self.clear()
        found = list(map(self.at.get, chunks))
        new = [k for k, x in enumerate(found) if x is None]
        if new:
            coded = make([chunks[k] for k in new])
            lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
            flat_ids = np.fromiter((i for ids in coded for i in ids), dtype=np.uint32, count=int(lengths.sum()))
            n, used = len(self.at), self.used + len(flat_ids)
            if used > len(self.store):
                self.store = np.concatenate([self.store[: self.used], np.zeros(used, np.uint32)])
            if n + len(new) > len(self.starts):
                self.starts, self.lengths = (np.concatenate([x[:n], np.zeros(n + len(new), np.int64)]) for x in (self.starts, self.lengths))
            self.store[self.used : used] = flat_ids
            self.lengths[n : n + len(new)] = lengths
            self.starts[n : n + len(new)] = self.used + np.cumsum(lengths) - lengths
            self.used = used
            for x, k in enumerate(new, n):
                self.at[chunks[k]] = found[k] = x
        return np.array(found, dtype=np.int64)

    def ids(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of chunks by number, one after the other, and n + 1 offsets."""
        lengths = self.lengths[which]
        return self.store[ragged(self.starts[which], lengths)], np.concatenate([[0], np.cumsum(lengths)])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... for lengths[i] each, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class Rows:
    """Remembers a row of numbers for each chunk. It only saves work, and is emptied when it holds over `limit` chunks."""

    def __init__(self, width: int, limit: int):
        self.width, self.limit = width, limit
        self.at: dict[bytes, int] = {}
        self.values = np.zeros((1 << 12, width))

    def find(self, chunks: list[bytes], make) -> np.ndarray:
        """The rows of distinct chunks; make(new chunks) gives those that aren't known."""
        if len(self.at) > self.limit:
            self.at.clear()
        found = list(map(self.at.get, chunks))
        new = [k for k, x in enumerate(found) if x is None]
        if new:
            n = len(self.at)
            if n + len(new) > len(self.values):
                self.values = np.concatenate([self.values[:n], np.zeros((n + len(new), self.width))])
            self.values[n : n + len(new)] = make([chunks[k] for k in new])
            for x, k in enumerate(new, n):
                self.at[chunks[k]] = found[k] = x
        return self.values[np.array(found, dtype=np.int64)]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunk_sums(buf: np.ndarray, offsets: np.ndarray, memo: Rows, make) -> np.ndarray:
    """Per text the sum of its chunks' rows; chunks as word_cuts has them, A-Z lower-cased, without white space around."""
    out = np.zeros((len(offsets) - 1, memo.width))
    if not len(buf):
        return out
    buf = LOWER[buf]
    cuts = word_cuts(buf, offsets)
    at, distinct = uniques(buf, cuts)
    rows = memo.find([c.strip() for c in distinct], make)
    begin = np.searchsorted(cuts[:-1], offsets)
    full = np.flatnonzero(np.diff(begin) > 0)  # texts that have chunks; the empty ones between them add none
    if len(full):
        out[full] = np.add.reduceat(rows[at], begin[full], axis=0)
    return out


def fold(id_: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % parts


def bounded_sample(rows: DataFrame, by: str, most: int, seed: int) -> list:
    """At most `most` rows of each group, the first by a hash of all columns. Rows have to be distinct: copies share one hash.

    Groups are counted first, and only rows under a hash bound that leaves about twice as many are ranked: however large the
    input, a task sees a few times `most` rows of a group.
    """
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).collect()}  # a row for each class
    if not counts:
        return []
    h = rows.withColumn("h_", F.xxhash64(F.lit(seed), *rows.columns))
    bound = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2 * most + 200) / n))])
    near = h.where(F.pmod("h_", F.lit(1 << 30)) < F.element_at(bound, F.col(by)) * (1 << 30))
    order = Window.partitionBy(by).orderBy("h_")
    return near.withColumn("r_", F.row_number().over(order)).where(F.col("r_") <= most).drop("r_", "h_").collect()


def bounded_texts(rows: DataFrame, by: str, order: str, text: str, most: int) -> list:
    """The rows of each group, by `order`, as far as their texts have at most `most` bytes together; the first one always."""
    before = Window.partitionBy(by).orderBy(order)
    held = rows.withColumns({"size_": F.sum(F.octet_length(text)).over(before), "row_": F.row_number().over(before)})
    return held.where((F.col("size_") <= most) | (F.col("row_") == 1)).drop("size_", "row_").orderBy(by, order).collect()
