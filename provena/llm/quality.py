"""Quality by a generalised additive model with pairwise interactions.

A text is described by FEATURES, all counted on its bytes and words. Each feature is cut into bins at quantiles of the training
rows. Boosting goes round the features again and again: one shallow tree (at most LEAVES leaves) of the present gradients over
one feature's bins, shrunk, is added to that feature's lookup table. Then pairs of features are ranked by how much of what is
left four quadrants explain, and the PAIRS best are boosted in turn with trees over both features' coarse bins. How many rounds
are kept is decided on rows held aside. A score is the logistic of the intercept plus one table entry for each feature and
pair: bin numbers and additions over whole batches.

Training takes a bounded sample: at most SAMPLE_DOCS labelled rows of each class by a hash of the row, whose features (not
texts) come to the driver; classes are weighted back to their true counts, so that scores are shares.

Defined cases: null and empty texts have zero features and get what the model gives these; without labels of both classes every
score is the labelled share of 1 (0.5 without labels); repeated rows each give a row, an id with several labels takes the
larger one and one of its texts; a null label is no label.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import LETTER, LOWER, SPACE, binary_parts, bounded_sample, fold, held, prepare, slices, table

SAMPLE_DOCS = 4000
BINS, COARSE, LEAVES, LEAST_ROWS = 48, 12, 4, 10
ROUNDS, PAIR_ROUNDS, RATE, PAIRS, ASIDE, PATIENCE = 300, 120, 0.1, 10, 0.2, 30
LABEL_AT = 0.5

FEATURES = (
    "words", "word_bytes", "line_words", "letters", "upper", "upper_words", "digits", "white", "stops", "commas", "marks", "marked_words", "bars",
    "exclaims", "repeated_words", "distinct_words", "repeated_lines", "top_mark", "high_bytes", "controls",
)

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_HIGH = np.arange(256) >= 128
_CONTROL = (np.arange(256) < 32) & ~SPACE
#: ASCII punctuation that prose has little of.
_MARK = (np.arange(256) < 127) & (np.arange(256) > 32) & ~LETTER & ~_DIGIT
_MARK[[ord(c) for c in ".,;:'\"-()?"]] = False


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def _pieces(buf: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of the maximal runs without a separator; none crosses texts."""
    inside = ~between
    change = np.zeros(len(buf) + 1, dtype=bool)
    change[0], change[-1] = inside[0], inside[-1]
    change[1:-1] = inside[1:] != inside[:-1]
    starts, ends = change[:-1] & inside, change[1:] & inside
    seams = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(buf))]
    starts[seams[inside[seams]]] = True
    ends[seams[inside[seams - 1]] - 1] = True
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, side="right") - 1


def _numbers(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of each piece among the distinct ones."""
    cuts = np.empty(2 * len(starts) + 1, dtype=np.int64)
    cuts[0:-1:2], cuts[1:-1:2], cuts[-1] = starts, ends, len(buf)
    return np.asarray(binary_parts(buf, cuts).take(pa.array(np.arange(0, 2 * len(starts), 2))).dictionary_encode().indices)


def _distinct(text: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
    if not len(text):
        return np.zeros(n)
    wide = int(number.max()) + 1
    return np.bincount(np.unique(text * wide + number) // wide, minlength=n).astype(np.float64)


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(buf):
        return out
    size = np.diff(offsets)
    share = lambda x, of: np.divide(x, of, out=np.zeros(n), where=of > 0)
    count = lambda which: _per_text(which[buf], offsets)
    one = lambda c: _per_text(buf == ord(c), offsets)
    letters, upper, marks, high = count(LETTER), count(_UPPER), count(_MARK), count(_HIGH)
    starts, ends, text = _pieces(buf, offsets, SPACE[buf])
    words = np.bincount(text, minlength=n).astype(np.float64)
    number = _numbers(LOWER[buf], starts, ends)
    again = np.zeros(len(text), dtype=bool)
    again[1:] = (number[1:] == number[:-1]) & (text[1:] == text[:-1])
    loud = LETTER[buf].astype(np.int8)
    loud[_UPPER[buf]] = -1
    sums = np.concatenate([[0], np.cumsum(loud, dtype=np.int64)])
    capital = (sums[ends] - sums[starts] < 0) & (ends - starts > 1)
    l_starts, l_ends, l_text = _pieces(buf, offsets, buf == 10)
    lines = np.bincount(l_text, minlength=n).astype(np.float64)
    same = np.bincount(text, weights=again, minlength=n)
    columns = {
        "words": np.log1p(words), "word_bytes": share(np.bincount(text, weights=ends - starts, minlength=n), words), "line_words": np.log1p(share(words, lines)),
        "letters": share(letters + high, size), "upper": share(upper, letters), "upper_words": share(np.bincount(text, weights=capital, minlength=n), words),
        "digits": share(count(_DIGIT), size), "white": share(count(SPACE), size), "stops": share(one(".") + one("?"), words), "commas": share(one(","), words),
        "marks": share(marks, words), "marked_words": share(np.bincount(text, weights=_MARK[buf[ends - 1]], minlength=n), words), "bars": share(one("|"), words), "exclaims": share(one("!"), words),
        "repeated_words": share(same, words), "distinct_words": share(_distinct(text, number, n), words), "repeated_lines": 1 - share(_distinct(l_text, _numbers(buf, l_starts, l_ends), n), np.maximum(lines, 1)) - (lines == 0),
        "top_mark": share(np.max([one(c) for c in "#$%&*"], axis=0), words), "high_bytes": share(high, size), "controls": share(count(_CONTROL), size),
    }
    return np.stack([columns[f] for f in FEATURES], axis=1)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _loss(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * (np.logaddexp(0, margin) - y * margin)).sum() / weight.sum())


def _gain(g, h):
    return g * g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[float, int]:
    """How much a cut of these bins gains at most, and after which bin; each side keeps LEAST_ROWS rows."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, cl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(c)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain[(cl < LEAST_ROWS) | (c.sum() - cl < LEAST_ROWS)] = 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Values of a tree of at most LEAVES leaves over one feature's bins: the best cut is made first."""
    leaves = [(0, len(g))]
    cuts = [_best_cut(g, h, c)]
    while len(leaves) < LEAVES:
        k = int(np.argmax([gain for gain, _ in cuts]))
        if cuts[k][0] <= 1e-6:
            break
        (a, b), at = leaves[k], leaves[k][0] + cuts[k][1]
        leaves[k : k + 1] = [(a, at), (at, b)]
        cuts[k : k + 1] = [_best_cut(g[x:y], h[x:y], c[x:y]) for x, y in ((a, at), (at, b))]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts a pair's grid by one feature, then each side by the other."""
    best = (0.0, np.zeros_like(g))
    for turn in (False, True):
        G, H, C = (x.T if turn else x for x in (g, h, c))
        sums = [np.cumsum(x, axis=0) for x in (G, H, C)]
        for at in range(1, len(G)):
            total, values = -_gain(G.sum(), H.sum()), np.zeros_like(G)
            for part, (x, y, z) in ((slice(0, at), [s[at - 1] for s in sums]), (slice(at, None), [s[-1] - s[at - 1] for s in sums])):
                gain, cut = _best_cut(x, y, z)
                for q in (slice(0, cut), slice(cut, None)) if gain > 0 else (slice(None),):
                    total += _gain(x[q].sum(), y[q].sum())
                    values[part, q] = x[q].sum() / (y[q].sum() + 1.0)
            if total > best[0]:
                best = (float(total), values.T if turn else values)
    return best


class Model:
    """edges of each feature's bins and its table; pairs of features, the coarse bin of each bin, and their tables."""

    def __init__(self, share: float = 0.5):
        share = min(max(share, 1e-6), 1 - 1e-6)
        self.intercept, self.edges, self.tables, self.pairs, self.coarse, self.pair_tables = float(np.log(share / (1 - share))), [], [], [], [], []

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        bins = self.bins(x)
        for b, t in zip(bins, self.tables, strict=True):
            out += t[b]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 5) -> Model:
        aside = np.random.default_rng(seed).random(len(y)) < ASIDE
        if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
            aside = np.zeros(len(y), dtype=bool)
        fit, test = ~aside, aside if aside.any() else ~aside
        share = (weight * y)[fit].sum() / weight[fit].sum()
        self.__init__(share)
        for column in x[fit].T:
            q = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="higher"))
            self.edges.append(q)
            self.coarse.append((np.arange(len(q) + 1) * COARSE // (len(q) + 1)).astype(np.int64))
        bins = self.bins(x)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        margin = self._rounds(ROUNDS, self.tables, bins, [len(t) for t in self.tables], _tree, np.full(len(y), self.intercept), y, weight, fit, test)
        grid = [self.coarse[k][b] for k, b in enumerate(bins)]
        self.pairs = self._interactions(grid, margin, y, weight, fit)
        self.pair_tables = [np.zeros((COARSE, COARSE)) for _ in self.pairs]
        cells = [grid[i] * COARSE + grid[j] for i, j in self.pairs]
        flat = lambda g, h, c: _pair_tree(*(v.reshape(COARSE, COARSE) for v in (g, h, c)))[1].ravel()
        self._rounds(PAIR_ROUNDS, [t.reshape(-1) for t in self.pair_tables], cells, [COARSE**2] * len(cells), flat, margin, y, weight, fit, test)
        return self

    @staticmethod
    def _histograms(cells, size, margin, y, weight, fit):
        p = _sigmoid(margin[fit])
        w, at = weight[fit], cells[fit]
        return np.bincount(at, weights=w * (y[fit] - p), minlength=size), np.bincount(at, weights=w * p * (1 - p), minlength=size), np.bincount(at, minlength=size)

    def _rounds(self, rounds, tables, cells, sizes, tree, margin, y, weight, fit, test) -> np.ndarray:
        """Boost the tables in turn, in place; the round that the rows held aside like best stays. Gives the margins then."""
        best, kept, at, since = _loss(margin[test], y[test], weight[test]), [t.copy() for t in tables], margin, 0
        for _ in range(rounds if tables else 0):
            margin = margin.copy()
            for t, c, size in zip(tables, cells, sizes, strict=True):
                step = RATE * tree(*self._histograms(c, size, margin, y, weight, fit))
                t += step
                margin += step[c]
            loss, since = _loss(margin[test], y[test], weight[test]), since + 1
            if loss < best - 1e-6:
                best, kept, at, since = loss, [t.copy() for t in tables], margin, 0
            if since >= PATIENCE:
                break
        for t, k in zip(tables, kept, strict=True):
            t[:] = k
        return at

    def _interactions(self, grid, margin, y, weight, fit) -> list[tuple[int, int]]:
        found = []
        for i in range(len(grid)):
            for j in range(i + 1, len(grid)):
                g, h, c = (v.reshape(COARSE, COARSE) for v in self._histograms(grid[i] * COARSE + grid[j], COARSE**2, margin, y, weight, fit))
                found.append((-_pair_tree(g, h, c)[0], i, j))
        return [(i, j) for gain, i, j in sorted(found)[:PAIRS] if gain < 0]


def feature_rows(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """id and x, the features, of every row."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([rows.column("d"), pa.array(list(features(buf, offsets)), pa.list_(pa.float64()))], names=["d", "x"])

    return docs.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text_col}`").alias("t")).mapInArrow(run, f"d {kind}, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, where: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of a bounded sample of the labelled rows where `where` (of the id) holds."""
    marked = labels.where(where & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = bounded_sample(marked, "y", SAMPLE_DOCS, 3)
    if not chosen:
        return Model()
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row for each class
    share = counts.get(1, 0) / sum(counts.values())
    ids = docs.sparkSession.createDataFrame([(r["i"], r["y"]) for r in chosen], marked.schema)
    sampled = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).join(F.broadcast(ids.select("i")), "i")  # at most 2 * SAMPLE_DOCS ids
    found = feature_rows(sampled, id_col="i", text_col="t").groupBy(F.col("d").alias("i")).agg(F.min("x").alias("x"))
    rows = found.join(F.broadcast(ids), "i").orderBy("i").collect()  # one row for each sampled id
    y = np.array([r["y"] for r in rows], dtype=np.float64)
    if len(set(y)) < 2:
        return Model(share)
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    return Model(share).fit(np.array([r["x"] for r in rows]), y, weight / weight.mean())


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted of every row."""
    prepare(docs.sparkSession)
    state = docs.sparkSession.sparkContext.broadcast(model)  # a table for each feature and pair
    token, kind = uuid.uuid4().hex, docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(token, lambda: state.value)
        for rows, buf, offsets in slices(batches, "t"):
            s = own.score(features(buf, offsets)) if own.tables else np.full(rows.num_rows, _sigmoid(own.intercept))
            yield pa.RecordBatch.from_arrays([rows.column("d"), pa.array(s), pa.array((s >= LABEL_AT).astype(np.int32))], names=["d", "score", "predicted"])

    return docs.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text_col}`").alias("t")).mapInArrow(run, f"d {kind}, score double, predicted int").withColumnRenamed("d", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
