"""Removal of long repeated strings, by a column-wise suffix order of many contexts.

A text is a sequence of symbols: its UTF-8 bytes, or its words (A-Z lower-cased, each as a 64-bit number). Two equal strings
of `length` symbols have the same minimizer: the smallest hash among their grams of `gram` symbols, the leftmost of equals.
So every window of a text is laid to its minimizer, the anchor, and windows can only be equal where their anchors' grams are
equal and lie at the same place in both. The steps:

1. anchors: one pass over the texts gives each anchor with the range of windows laid to it, a hash of its gram (its class)
   and one of the symbols that these windows span (its context);
2. classes of one anchor go; equal contexts of a class become one, with the least and the greatest of their owners: where
   these differ, their windows repeat by that alone;
3. classes of several contexts are ordered. What follows the anchor and (read backwards) what precedes it are columns of
   8-byte symbols, and as in column-wise construction of the Burrows-Wheeler transform one symbol of each document is
   inserted per round, last column first: a stable sort by the round's symbols puts each context's longer suffix in place,
   and common prefixes follow from the smallest of those passed over. Only the newest suffix of a context keeps a place, so
   the transform of the older ones isn't kept. Columns, orders and common prefixes go through temporary files that are read
   and written in sequence. A window of s symbols before the anchor is repeated where contexts of two owners share the group
   of common prefix >= length - s after it and >= s before it;
4. classes of over CLASS_CAP contexts are first narrowed: windows are dealt to slices by s, and a slice's class includes
   the symbols that all its windows hold; slices of a single s have equal windows only, whose owners are compared;
5. each text's repeated windows are joined to it and removed.

An owner is the place itself, so that any second occurrence repeats a string, or with across=True the row, so that strings
have to stand in two rows.

Defined cases: null texts are empty; texts shorter than `length` keep all; strings never cross rows; a repeated row or text
repeats all its windows; overlapping occurrences count; no rows give no rows; any other columns, whatever their names, are
carried along with text=True.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, SPACE, Steps, drop_held, packed, prepare, release, slices, table, unpacked

#: Symbols of a window and of a gram, by unit. 50 words are in every passage of over 50, even if a word at its edge is glued to its surroundings.
LENGTH, GRAM = {"bytes": 400, "words": 50}, {"bytes": 64, "words": 8}
#: Bytes of a symbol.
WIDTH = {"bytes": 1, "words": 8}
#: Contexts of a class that one task orders at once, contexts that it orders together, symbols of text whose anchors are found at once.
CLASS_CAP, GATHER, PIECE = 1024, 8192, 8 << 20
#: Widths of s by which classes over the cap are narrowed.
NARROW = (16, 1)
_TABLE = np.random.default_rng(20240).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    power = np.full(n, base, dtype=np.uint64)
    power[:1] = 1
    return np.cumprod(power, out=power)


def _hashes(symbols: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    """A hash of the symbols from each start to its end, from prefix sums of a polynomial modulo 2**64."""
    n = len(symbols)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_TABLE[symbols] if symbols.dtype == np.uint8 else symbols) * _powers(_ODD, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(_INVERSE, n + 1)[starts]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    return _hashes(symbols, slice(0, len(symbols) + 1 - gram), slice(gram, None))


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last; words end at white space and at the edges of texts."""
    real = ~SPACE[buf]
    begin, stop = real.copy(), real.copy()
    begin[1:] &= ~real[:-1]
    stop[:-1] &= ~real[1:]
    edges = offsets[(offsets > 0) & (offsets < len(buf))]
    begin[edges] = real[edges]
    stop[edges - 1] = real[edges - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def _symbols(buf: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts in buf, and the texts' offsets in them."""
    if unit == "bytes":
        return buf, offsets
    starts, ends = words(buf, offsets)
    out, k = np.zeros(len(starts), dtype=np.uint64), 0
    while k < len(starts):  # about PIECE bytes of words at a time
        m = max(k + 1, int(np.searchsorted(ends, starts[k] + PIECE, side="right")))
        a = starts[k]
        out[k:m] = _hashes(LOWER[buf[a : ends[m - 1]]], starts[k:m] - a, ends[k:m] - a) | np.uint64(1)
        k = m
    return out, np.searchsorted(starts, offsets)


def _window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by running minima from both ends of blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text number, place in the text, smallest and largest number of symbols before it of the windows laid to it, and the gram's hash."""
    out, none = [], (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    doc_of = np.flatnonzero(np.diff(offsets) >= length)
    if not len(doc_of):
        return none
    for start in range(0, max(1, len(buf) - length + 1), PIECE):
        piece = buf[start : start + PIECE + length - 1]
        if len(piece) < length:
            continue
        full = _gram_hashes(piece, gram)
        h = (full & ~np.uint64(0xFFFFFF)) | np.arange(len(full), dtype=np.uint64)
        place = (_window_minimum(h, length - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        # windows inside one text
        first = np.searchsorted(offsets, np.arange(start, start + len(place)), side="right") - 1 if len(offsets) > 2 else None
        at = np.arange(start, start + len(place))
        doc = first if first is not None else np.zeros(len(place), np.int64)
        ok = at + length <= offsets[doc + 1]
        at, doc, place = at[ok], doc[ok], place[ok] + start
        if not len(at):
            continue
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(at)) - 1
        out.append((doc[begin], place[begin] - offsets[doc[begin]], place[end] - at[end], place[begin] - at[begin], full[place[begin] - start]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else none


def _hash(data) -> int:
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def _anchor_rows(docs: DataFrame, length: int, gram: int, unit: str, across: bool) -> DataFrame:
    """tid, d, owner, place, lo, hi, cls, ctx of all anchors. An owner's number holds the partition's: the table is written once, then read."""
    w = WIDTH[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        from pyspark import TaskContext

        owned = TaskContext.get().partitionId() << 40
        for rows, buf, offsets in slices(batches, "t", 1 << 20):
            symbols, offsets = _symbols(buf, offsets, unit)
            doc, place, lo, hi, cls = anchors(symbols, offsets, length, gram)
            view, at = memoryview(np.ascontiguousarray(symbols)).cast("B"), offsets[doc] + place
            owner = owned + (doc if across else np.arange(len(doc)))
            owned += rows.num_rows if across else len(doc)
            ctx = [_hash(view[(a - h) * w : (a - l + length) * w]) ^ (h << 20 | l) for a, l, h in zip(at.tolist(), lo.tolist(), hi.tolist())]
            arrays = [rows.column("tid").take(pa.array(doc)), rows.column("d").take(pa.array(doc)), pa.array(owner), pa.array(place), pa.array(lo, pa.int16()), pa.array(hi, pa.int16()), pa.array(cls.view(np.int64)), pa.array(ctx, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["tid", "d", "owner", "place", "lo", "hi", "cls", "ctx"])

    kind = docs.schema["d"].dataType.simpleString()
    return docs.mapInArrow(run, f"tid binary, d {kind}, owner bigint, place bigint, lo smallint, hi smallint, cls bigint, ctx bigint")


_MARKS = "array<struct<first:bigint,end:bigint>>"
_CONTEXT = [("cls", pa.int64()), ("ctx", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("lo", pa.int16()), ("hi", pa.int16()), ("bytes", pa.binary())]
_CONTEXT_SQL = "cls bigint, ctx bigint, a bigint, b bigint, lo smallint, hi smallint, bytes binary"


def _contexts(wanted: DataFrame, length: int, unit: str) -> DataFrame:
    """cls, ctx, a, b, lo, hi and the symbols, as bytes, that the windows of an anchor span; wanted: z and its anchors."""
    w = WIDTH[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            own = batch.column("own")
            fields = {f.name: x for f, x in zip(own.values.type, own.flatten().flatten())}
            place, lo, hi = (np.asarray(fields[k], dtype=np.int64) for k in ("place", "lo", "hi"))
            begin, end = ((place - hi) * w).tolist(), ((place - lo + length) * w).tolist()
            parts, k = [], 0
            for z, n in zip(batch.column("z"), pc.list_value_length(own).to_pylist()):
                data = unpacked(z.as_py())
                if unit == "words":
                    data = _symbols(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]), unit)[0].tobytes()
                parts += [data[a:b] for a, b in zip(begin[k : k + n], end[k : k + n])]
                k += n
            yield pa.RecordBatch.from_arrays([*[fields[c] for c, _ in _CONTEXT[:-1]], pa.array(parts, pa.binary())], schema=pa.schema(_CONTEXT))

    return wanted.mapInArrow(run, _CONTEXT_SQL)


def column_order(columns: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a symbol matrix within ascending classes, and common prefixes in bytes with the row before (-1 at a class's start).

    columns: uint64, big-endian bytes as numbers. Round by round the next symbol of every row is put before its suffix.
    """
    n, m = columns.shape
    same = np.concatenate([[False], classes[1:] == classes[:-1]])
    with tempfile.TemporaryFile() as symbols, tempfile.TemporaryFile() as state:
        for j in range(m - 1, -1, -1):
            symbols.write(np.ascontiguousarray(columns[:, j]).tobytes())
        np.arange(n, dtype=np.int64).tofile(state)
        np.where(same, 0, -1).astype(np.int64).tofile(state)
        symbols.seek(0)
        state.seek(0)
        for _ in range(m):
            symbol = np.frombuffer(symbols.read(8 * n), dtype=np.uint64)
            order, prefix = np.frombuffer(state.read(8 * n), dtype=np.int64), np.frombuffer(state.read(8 * n), dtype=np.int64)
            c, group = symbol[order], classes[order]
            to = np.lexsort((c, group))  # stable: equal symbols keep the order of their suffixes
            equal = np.concatenate([[False], (c[to][1:] == c[to][:-1]) & (group[to][1:] == group[to][:-1])])
            after = np.full(n, -1, dtype=np.int64)
            i = np.flatnonzero(equal)
            if len(i):
                bounds = np.empty(2 * len(i), dtype=np.int64)
                bounds[0::2], bounds[1::2] = to[i - 1] + 1, to[i] + 1
                after[i] = 8 + np.minimum.reduceat(np.append(prefix, 1 << 40), bounds)[0::2]
            other = np.flatnonzero(~equal & same)  # classes keep their places
            if len(other):
                differ = (c[to][other] ^ c[to][other - 1]).astype(">u8").view(np.uint8).reshape(-1, 8)
                after[other] = (differ != 0).argmax(axis=1)
            state.seek(0)
            order[to].tofile(state)
            after.tofile(state)
            state.seek(0)
        order, prefix = np.frombuffer(state.read(8 * n), dtype=np.int64), np.frombuffer(state.read(8 * n), dtype=np.int64)
    return order, prefix


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    """Rows of bytes as big-endian 8-byte symbols, padded with zeros."""
    width = max(8, -(-width // 8) * 8)
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), dtype=">u8").reshape(len(parts), -1).astype(np.uint64)


def repeated_windows(cls: np.ndarray, a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray, texts: list[bytes], length: int, w: int = 1) -> np.ndarray:
    """rows x (1 + largest hi) booleans: the window with s symbols (of w bytes) before the anchor has two owners in the class.

    a, b: least and greatest owner of each context. Rows come by ascending class.
    """
    right = [t[h * w :] for t, h in zip(texts, hi.tolist())]
    left = [t[: h * w][::-1] for t, h in zip(texts, hi.tolist())]
    order_r, prefix_r = column_order(_matrix(right, int((length - lo).max()) * w), cls)
    order_l, prefix_l = column_order(_matrix(left, int(hi.max()) * w), cls)
    rank_r, rank_l = np.empty_like(order_r), np.empty_like(order_l)
    rank_r[order_r] = rank_l[order_l] = np.arange(len(cls))
    out = np.zeros((len(cls), int(hi.max()) + 1), dtype=bool)
    for s in range(int(lo.min()), int(hi.max()) + 1):
        active = np.flatnonzero((lo <= s) & (s <= hi))
        if not len(active):
            continue
        key = np.cumsum(prefix_r < (length - s) * w)[rank_r[active]] * (len(cls) + 1) + np.cumsum(prefix_l < s * w)[rank_l[active]]
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        two = np.minimum.reduceat(a[active][order], new) != np.maximum.reduceat(b[active][order], new)
        out[active[order], s] = np.repeat(two, np.diff(np.append(new, len(order))))
    return out


def _ordered(contexts: DataFrame, length: int, w: int) -> DataFrame:
    """cls, ctx, lo, hi: a row for each run of s in which a context's windows are repeated."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        cls, a, b, lo, hi = (np.asarray(rows[k], dtype=np.int64) for k in ("cls", "a", "b", "lo", "hi"))
        hit = repeated_windows(cls, a, b, lo, hi, rows["bytes"].to_pylist(), length, w)
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1] - 1
        return pa.RecordBatch.from_arrays([rows[k].take(pa.array(row)).combine_chunks() for k in ("c0", "x0")] + [pa.array(x, pa.int16()) for x in (first, last)], names=["cls", "ctx", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        parts: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                parts.append(batch.slice(k, 1000))
                n += parts[-1].num_rows
                if n >= GATHER:  # whole classes: the last may go on
                    held = pa.Table.from_batches(parts)
                    cls = np.asarray(held["cls"])
                    whole = int(np.flatnonzero(np.append(cls[:-1] != cls[-1], False)).max(initial=-1)) + 1
                    if whole:
                        yield solve(held.slice(0, whole))
                        parts = held.slice(whole).to_batches()
                        n -= whole
        if n:
            yield solve(pa.Table.from_batches(parts))
        release()

    return contexts.repartition("cls").sortWithinPartitions("cls").mapInArrow(run, "cls bigint, ctx bigint, lo smallint, hi smallint")


def _narrowed(contexts: DataFrame, width: int, length: int, w: int) -> DataFrame:
    """Each context dealt to slices of `width` values of s; equal parts of a slice's class become one row for each context that they came from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for k in range(r["lo"] // width, r["hi"] // width + 1):
                    lo, hi = max(r["lo"], k * width), min(r["hi"], (k + 1) * width - 1)
                    part = r["bytes"][(r["hi"] - hi) * w : (r["hi"] - lo + length) * w]
                    core = r["bytes"][max(0, r["hi"] - k * width) * w : max(0, r["hi"] - (k + 1) * width + 1 + length) * w]
                    rows.append((_hash(b"%d,%d;" % (r["cls"], k) + core), _hash(part) ^ (hi << 20 | lo), r["a"], r["b"], lo, hi, part, r["c0"], r["x0"]))
            kinds = [*_CONTEXT, ("c0", pa.int64()), ("x0", pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, (_, t) in enumerate(kinds)], names=[k for k, _ in kinds])

    return contexts.mapInArrow(run, f"{_CONTEXT_SQL}, c0 bigint, x0 bigint")


def _repeats(rows: DataFrame, steps: Steps, length: int, gram: int, unit: str, across: bool, cap: int) -> DataFrame:
    """tid and marks: first and end symbol of the stretches of each text that its repeated windows cover. rows: tid, d (the id), t."""
    w = WIDTH[unit]
    found = steps.write(_anchor_rows(rows, length, gram, unit, across), "anchors")
    several = steps.write(found.groupBy("cls").agg(F.count("*").alias("c")).where("c > 1").select("cls"), "classes")
    # Joins are of written tables only, so that their skewed partitions (a gram that very many texts have) can be split.
    shared = steps.write(found.join(several, "cls"), "shared")
    steps.drop("anchors", "classes")
    groups = steps.write(shared.groupBy("cls", "ctx").agg(F.min("owner").alias("a"), F.max("owner").alias("b"), F.min(F.struct("tid", "d", "place", "lo", "hi")).alias("r")), "groups")
    # contexts of classes that have more than one, read from the texts
    many = steps.write(groups.groupBy("cls").agg(F.count("*").alias("c")).where("c > 1").select("cls"), "many")
    own = groups.join(many, "cls").groupBy("r.tid", "r.d").agg(F.collect_list(F.struct("cls", "ctx", "a", "b", "r.place", "r.lo", "r.hi")).alias("own"))
    own = own.withColumnsRenamed({"tid": "o_tid", "d": "o_d"})  # one row of each text: copies would all bring the same contexts
    wanted = packed(rows).join(own, (F.col("tid") == F.col("o_tid")) & F.col("d").eqNullSafe(F.col("o_d"))).select("z", "own")
    contexts = steps.write(_contexts(wanted, length, unit).dropDuplicates(["cls", "ctx"]).withColumns({"c0": F.col("cls"), "x0": F.col("ctx")}), "contexts")
    solved = [groups.where("a <> b").select("cls", "ctx", "r.lo", "r.hi")]
    for width in (*NARROW, 0):
        sizes = contexts.groupBy("cls").agg(F.count("*").alias("c"))
        hot = steps.write(sizes.where(F.col("c") > cap).select("cls"), f"hot-{width}")
        none = hot.isEmpty()
        solved.append(_ordered(contexts if none else contexts.join(hot, "cls", "left_anti"), length, w))
        if none or not width:
            break
        contexts = steps.write(_narrowed(contexts.join(hot, "cls", "left_semi"), width, length, w), f"narrowed-{width}")
        if width == 1:  # windows of a class are equal: those of two owners repeat
            twice = contexts.groupBy("cls").agg(F.min("a").alias("least"), F.max("b").alias("most")).where("least <> most").select("cls")
            solved.append(contexts.join(twice, "cls").select(F.col("c0").alias("cls"), F.col("x0").alias("ctx"), "lo", "hi"))
            break
    parts = solved[0]
    for x in solved[1:]:
        parts = parts.union(x)
    runs = steps.write(parts.withColumnsRenamed({"lo": "from", "hi": "to"}), "runs")
    stretch = F.struct((F.col("place") - F.col("to")).alias("first"), (F.col("place") - F.col("from") + length).alias("end"))
    marks = steps.write(shared.join(runs, ["cls", "ctx"]).groupBy("tid").agg(F.collect_set(stretch).alias("marks")), f"marks-{unit}")
    steps.drop(*[k for k in steps.paths if not k.startswith("marks")])
    return marks


def _gone(n: int, marks: pa.ListScalar) -> np.ndarray:
    """For each of n symbols whether a repeated window holds it."""
    first, end = (np.asarray(x) for x in marks.values.flatten())
    edge = np.bincount(first, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def _cut(data: bytes, marks: pa.ListScalar, unit: str) -> tuple[bytes, int, int, int]:
    """What is kept, bytes removed, runs removed, symbols removed. White space after removed words goes with them."""
    if not marks.is_valid or not len(marks):
        return data, 0, 0, 0
    buf = np.frombuffer(data, dtype=np.uint8)
    if unit == "bytes":
        gone = _gone(len(buf), marks)
        n = int(gone.sum())
    else:
        starts, ends = words(buf, np.array([0, len(buf)]))
        hit = _gone(len(starts), marks)
        n = int(hit.sum())
        gone = np.zeros(len(buf), dtype=bool)
        gone[starts[0] :] = np.repeat(hit, np.diff(np.append(starts, len(buf))))
    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return buf[~gone].tobytes(), int(gone.sum()), runs, n


def _keyed(docs: DataFrame, names: list[str], text_col: str) -> DataFrame:
    """x (the named columns), t (the text) and tid (its digest)."""
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("x"), F.col(f"`{text_col}`").alias("t"))
    return carried.withColumn("tid", F.unhex(F.md5(F.coalesce("t", F.lit("")))))


def removal(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "bytes", length: int | None = None, gram: int | None = None, across: bool = False, cap: int = CLASS_CAP, text: bool = False, passages: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, n_symbols (removed) and kept_sha256 of every row, or with text=True all columns with the text that is kept (invalid bytes at a cut character's edge are dropped).

    passages: also n_passage_words, the words inside passages of 50 words and more that stand in another row as well.
    """
    prepare(docs.sparkSession)
    length, gram = length or LENGTH[unit], gram or GRAM[unit]
    names = [c for c in docs.columns if c != text_col] if text else [id_col]
    rows = _keyed(docs, names, text_col)
    read, steps = _keyed(docs, [id_col], text_col).select("tid", F.col(f"x.`{id_col}`").alias("d"), "t"), Steps(docs.sparkSession)
    marks = _repeats(read, steps, length, gram, unit, across, cap).withColumn("more", F.lit(None).cast(_MARKS))
    if passages:  # one row a text again, so that the texts are joined once; written, so that copies of a text can be split in that join
        more = _repeats(read, steps, LENGTH["words"], GRAM["words"], "words", True, cap).select("tid", F.lit(None).cast(_MARKS).alias("marks"), F.col("marks").alias("more"))
        marks = steps.write(marks.union(more).groupBy("tid").agg(F.first("marks", True).alias("marks"), F.first("more", True).alias("more")), "marks")
        steps.drop("marks-bytes", "marks-words")
    marks = marks.withColumnRenamed("tid", "m_tid")
    joined = packed(rows).join(marks, F.col("tid") == F.col("m_tid"), "left").select("x", "z", "marks", "more")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if not z.is_valid else _cut(unpacked(z.as_py()), m, unit)[0].decode(errors="ignore") for z, m in zip(batch.column("z"), batch.column("marks"))]
            yield pa.RecordBatch.from_arrays([batch.column("x"), pa.array(texts, pa.string())], names=["x", "t"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for z, m, more in zip(batch.column("z"), batch.column("marks"), batch.column("more")):
                data = unpacked(z.as_py())
                keep, removed, runs, n = _cut(data, m, unit)
                out.append((len(data), removed, runs, n, hashlib.sha256(keep).hexdigest(), _cut(data, more, "words")[3]))
            columns = zip(*out) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays([batch.column("x"), *[pa.array(c, t) for c, t in zip(columns, (*(pa.int64(),) * 4, pa.string(), pa.int64()))]], names=["x", *made])

    made = ["n_bytes", "n_removed", "n_spans", "n_symbols", "kept_sha256", "n_passage_words"]
    kind = joined.select("x").schema
    if text:
        out = joined.mapInArrow(kept, kind.add("t", "string"))
        return out.select(*[F.col("t").alias(c) if c == text_col else F.col(f"x.`{c}`").alias(c) for c in docs.columns])
    for c in made:
        kind = kind.add(c, "string" if c == "kept_sha256" else "long")
    return joined.mapInArrow(digest, kind).select(F.col(f"x.`{id_col}`").alias(id_col), *(made if passages else made[:-1]))


def query(spark, sf_dir: str) -> DataFrame:
    """Removal of 400-byte strings; beside it n_passage_words, as passages of over 50 words may be shorter than that."""
    return removal(table(spark, sf_dir, "documents"), passages=True).drop("n_symbols")
