"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word (A-Z lower-cased, between marks) is the bag of its 3- to 7-byte n-grams; their vectors are averaged and a linear
softmax gives the word's probability of the toxic class, so that misspellings that were never seen share most vectors with
what was. A document's evidence is the sum of -log(clean probability) over all its words, and its score a logistic
function of the logarithm of that, whose two coefficients are learned with the vectors: two marked words count in a text of
any length. n-grams of fewer than LEAST_DOCS sampled documents have no vector, so that rare words teach nothing.

Training takes a bounded sample: at most SAMPLE_DOCS labelled documents of each class, by a hash of the row, and of these as
many as have SAMPLE_BYTES bytes together.

Defined cases: null, empty and wordless texts have no evidence and get the lowest score that the model gives; without labels
of both classes every score is the toxic share of the sample; repeated rows each give a row; a null label is no label.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, Rows, bounded_sample, bounded_texts, chunk_sums, flat, fold, held, prepare, ragged, slices, table, uniques, word_cuts

SAMPLE_DOCS, SAMPLE_BYTES, LEAST_DOCS = 1000, 16 << 20, 4
SIZES, DIM, STEPS, RATE = (3, 4, 5, 6, 7), 8, 60, 0.03
#: Evidence that an empty text has, and the least score for the label 1.
FLOOR, LABEL_AT = 1e-4, 0.7
MEMO = 400_000


def is_word(chunk: bytes) -> bool:
    return any(c >= 128 or 97 <= c <= 122 for c in chunk)


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of `<word>`, word by word, and n + 1 offsets."""
    marked = [b"<" + w + b">" for w in words]
    buf = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint64)
    lengths = np.array([len(w) for w in marked], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    hashes, owners = [], []
    for n in SIZES:
        count = np.maximum(lengths - n + 1, 0)
        at = ragged(starts, count)
        h = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ buf[at + k]) * np.uint64(0x100000001B3)
        hashes.append(h ^ (h >> np.uint64(29)))
        owners.append(np.repeat(np.arange(len(words)), count))
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return hashes[order], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(words)))])


def _softplus(x):
    return np.logaddexp(0, x)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Model:
    """n-gram vectors e (sorted by hash), softmax weights w (DIM x 2) and bias, and the logistic's slope and offset."""

    def __init__(self):
        self.keys, self.e = np.zeros(0, np.uint64), np.zeros((0, DIM))
        self.w, self.bias, self.slope, self.offset, self.share = np.zeros((DIM, 2)), 0.0, 1.0, 0.0, 0.0

    def words(self, words: list[bytes]) -> np.ndarray:
        """The evidence of each word, one column."""
        out = np.zeros((len(words), 1))
        own = [k for k, w in enumerate(words) if is_word(w)]
        if own and len(self.keys):
            h, ends = grams([words[k] for k in own])
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            each = np.where(self.keys[at] == h, (self.e @ (self.w[:, 1] - self.w[:, 0]))[at], 0.0)
            sums = np.concatenate([[0], np.cumsum(each)])
            n = np.diff(ends)
            out[own, 0] = _softplus((sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(n, 1) + self.bias)
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(evidence), self.share)
        return _sigmoid(self.slope * np.log(evidence + FLOOR) + self.offset)

    def fit(self, texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
        self.share = float(labels.mean()) if len(labels) else 0.0
        if not 0 < self.share < 1:
            return self
        buf, offsets = flat(pa.array(texts, pa.string()))
        buf = LOWER[buf]
        cuts = word_cuts(buf, offsets)
        at, distinct = uniques(buf, cuts)
        words = [c.strip() for c in distinct]
        begin = np.searchsorted(cuts[:-1], offsets)
        doc = np.repeat(np.arange(len(texts)), np.diff(begin))
        real = np.array([is_word(w) for w in words])
        # (document, word, times)
        pair, times = np.unique(doc[real[at]] * len(words) + at[real[at]], return_counts=True)
        doc, word = pair // len(words), pair % len(words)
        used, word = np.unique(word, return_inverse=True)
        h, ends = grams([words[k] for k in used])
        keys, gram = np.unique(h, return_inverse=True)
        gram, h = gram.astype(np.int32), None
        # documents of each n-gram, counting each once
        n = np.diff(ends)
        docs_of = np.zeros(len(keys), dtype=np.int64)
        for part in np.array_split(np.arange(len(texts)), max(1, len(texts) // 50)):
            a, b = np.searchsorted(doc, [part[0], part[-1] + 1])
            w = word[a:b]
            seen = np.unique(np.repeat(doc[a:b], n[w]) * len(keys) + gram[ragged(ends[:-1][w], n[w])])
            docs_of += np.bincount(seen % len(keys), minlength=len(keys))
        known = docs_of >= LEAST_DOCS
        number = np.where(known, np.cumsum(known) - 1, known.sum()).astype(np.int32)
        self.keys, gram = keys[known], number[gram]  # the last number: no vector
        aside = np.random.default_rng(seed).random(len(texts)) < 0.25  # documents that only set slope and offset
        fit = ~aside if 0 < labels[~aside].sum() < (~aside).sum() else np.ones(len(texts), dtype=bool)
        pairs = fit[doc]
        self._train(doc[pairs], word[pairs], times[pairs], np.repeat(np.arange(len(used), dtype=np.int32), n), gram, n, labels, fit, seed)
        evidence = np.bincount(doc, weights=times * self.words([words[k] for k in used])[word, 0], minlength=len(texts)) + FLOOR
        some = aside if len(set(labels[aside])) == 2 else np.ones(len(texts), dtype=bool)
        self.slope, self.offset = _logistic(np.log(evidence[some]), labels[some])
        return self

    def _train(self, doc, word, times, owner, gram, n, labels, fit, seed) -> None:
        """Gradient steps over all sampled documents. Vectors start along the softmax's direction, at their n-gram's smoothed log-odds."""
        rng = np.random.default_rng(seed)
        w = rng.standard_normal((DIM, 2)) * 0.5
        direction = w[:, 1] - w[:, 0]
        size = len(self.keys)
        bad = np.bincount(word, weights=labels[doc], minlength=len(n))
        good = np.bincount(word, weights=1 - labels[doc], minlength=len(n))
        t, c = (np.bincount(gram, weights=x[owner], minlength=size + 1)[:size] for x in (bad, good))
        start = np.log((t + 0.5) / (bad.sum() + 1)) - np.log((c + 0.5) / (good.sum() + 1))
        start = np.clip(start, -3, None) * (t + c) / (t + c + 10)
        p = {"e": (np.outer(np.append(start, 0), direction) / (direction @ direction)).astype(np.float32), "w": w, "bias": np.array(-6.0), "slope": np.array(1.0), "offset": np.array(0.0)}
        p["e"] += rng.standard_normal(p["e"].shape, dtype=np.float32) * np.float32(0.01)
        p["e"][-1] = 0
        m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        least = dict.fromkeys(p, 0.0)
        weight = np.where(labels == 1, 0.5 / max(1, labels[fit].sum()), 0.5 / max(1, (fit & (labels == 0)).sum())) * fit
        for step in range(1, STEPS + 1):
            direction = p["w"][:, 1] - p["w"][:, 0]
            logit = np.bincount(owner, weights=(p["e"] @ direction)[gram], minlength=len(n)) / np.maximum(n, 1) + p["bias"]
            evidence = np.bincount(doc, weights=times * _softplus(logit)[word], minlength=len(labels)) + FLOOR
            log = np.log(evidence)
            off = (_sigmoid(p["slope"] * log + p["offset"]) - labels) * weight
            d_logit = np.bincount(word, weights=(off * p["slope"] / evidence)[doc] * times, minlength=len(n)) * _sigmoid(logit)
            d_value = np.bincount(gram, weights=(d_logit / np.maximum(n, 1))[owner], minlength=size + 1)
            d_value[-1] = 0
            d_direction = p["e"].T @ d_value
            g = {"e": np.outer(d_value, direction), "w": np.stack([-d_direction, d_direction], axis=1), "bias": d_logit.sum(), "slope": (off * log).sum(), "offset": off.sum()}
            for k, v in g.items():
                v = np.asarray(v, dtype=p[k].dtype)
                least[k] = max(least[k], float(np.abs(v).max()) * 0.02) if k == "e" else 1e-8
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * v, 0.99 * m2[k] + 0.01 * v * v
                p[k] = (p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + least[k])).astype(p[k].dtype)
        self.e, self.w, self.bias = p["e"][:-1], p["w"], float(p["bias"])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit by Newton's method, with a slight pull to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        q = _sigmoid(a * x + b)
        v = np.maximum(q * (1 - q), 1e-9)
        ga, gb = ((q - y) * x).sum() + 0.1 * (a - 1), (q - y).sum() + 1e-3 * b
        haa, hab, hbb = (v * x * x).sum() + 0.1, (v * x).sum(), v.sum() + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - scale * da, b - scale * db
        if max(abs(da), abs(db)) < 1e-8:
            break
    return float(a), float(b)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.memo = model, Rows(1, MEMO)

    def documents(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.model.score(chunk_sums(buf, offsets, self.memo, self.model.words)[:, 0])


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted of every row."""
    prepare(docs.sparkSession)
    state = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    token, kind = uuid.uuid4().hex, docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(token, lambda: Scorer(state.value))
        for rows, buf, offsets in slices(batches, "t"):
            s = own.documents(buf, offsets)
            yield pa.RecordBatch.from_arrays([rows.column("d"), pa.array(s), pa.array((s >= LABEL_AT).astype(np.int32))], names=["d", "score", "predicted"])

    return docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).mapInArrow(run, f"d {kind}, score double, predicted int").withColumnRenamed("d", id_col)


def learn(docs: DataFrame, labels: DataFrame, where: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of a bounded sample of the labelled rows where `where` (of the id) holds."""
    marked = labels.where(where & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = bounded_sample(marked, "y", SAMPLE_DOCS, 2)
    if not chosen:
        return Model()
    ids = docs.sparkSession.createDataFrame([(r["i"], r["y"]) for r in chosen], marked.schema)
    texts = docs.select(F.col(f"`{id_col}`").alias("i"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    rows = texts.join(F.broadcast(ids), "i")  # at most 2 * SAMPLE_DOCS ids
    sample = bounded_texts(rows.groupBy("i").agg(F.min("y").alias("y"), F.min("t").alias("t")), "y", "i", "t", SAMPLE_BYTES)
    return Model().fit([r["t"] for r in sample], np.array([r["y"] for r in sample], dtype=np.float64))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
