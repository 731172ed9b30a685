"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads a word's bytes (A-Z lower-cased) from both ends, labels every position with probabilities of the languages,
and a document's probability is the mean over all positions of all its words that have a letter. States start anew at each
word, so a word has the same labels wherever it stands and each distinct one of a slice is run once. It is trained by
backpropagation through time on all words of a bounded sample, with the document's language as the label of every position:
at most SAMPLE_DOCS distinct texts of a language, and of these as many as have SAMPLE_BYTES bytes together.

Defined cases: null texts and texts without a letter are `und` with score 0; words of over MOST bytes are read in pieces; ties
go to the first language in order of name; without any labelled text all are `und`; repeated rows each give a row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, Rows, bounded_sample, bounded_texts, chunk_sums, flat, fold, held, materialize, prepare, ragged, slices, table, uniques, word_cuts

#: Bounds of the training sample.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 8 << 20
#: Width of the byte vectors and of each direction's state, bytes of a piece, steps, words of a step, rate.
WIDTH, STATE, MOST, STEPS, BATCH, RATE = 12, 16, 24, 500, 256, 0.01
MEMO = 400_000


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words as rows padded with 0, and their lengths."""
    n = np.array([len(w) for w in words], dtype=np.int64)
    m = np.zeros((len(words), max(1, int(n.max(initial=1)))), dtype=np.int64)
    m[np.arange(m.shape[1])[None, :] < n[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
    return m, n


class Network:
    """Parameters p: byte vectors, per direction input and state weights of the gates (update, reset, candidate), output."""

    def __init__(self, langs: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.langs = langs
        r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": r(256, WIDTH) * 4, "o": r(2 * STATE, len(langs)), "ob": np.zeros(len(langs), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": r(WIDTH, 3 * STATE), f"u{d}": r(STATE, 3 * STATE), f"b{d}": np.zeros(3 * STATE, np.float32)}

    def _run(self, d: str, m: np.ndarray, n: np.ndarray, keep: list | None) -> np.ndarray:
        """States of a direction, words x positions x STATE."""
        p, h = self.p, np.zeros((len(m), STATE), dtype=np.float32)
        inputs = p["e"] @ p[f"w{d}"] + p[f"b{d}"]  # of every byte
        out = np.zeros((*m.shape, STATE), dtype=np.float32)
        for t in range(m.shape[1]) if d == "f" else range(m.shape[1] - 1, -1, -1):
            on = (t < n)[:, None]
            x = inputs[m[:, t]]
            g = h @ p[f"u{d}"][:, : 2 * STATE]
            z, r = _sigmoid(x[:, :STATE] + g[:, :STATE]), _sigmoid(x[:, STATE : 2 * STATE] + g[:, STATE:])
            c = np.tanh(x[:, 2 * STATE :] + (r * h) @ p[f"u{d}"][:, 2 * STATE :])
            new = np.where(on, (1 - z) * h + z * c, h)
            if keep is not None:
                keep.append((t, h, z, r, c, on))
            h = new
            out[:, t] = h
        return out

    def label(self, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probabilities, words x positions x languages."""
        states = np.concatenate([self._run("f", m, n, None), self._run("b", m, n, None)], axis=2)
        logits = states @ self.p["o"] + self.p["ob"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True)

    def gradients(self, m: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        p, kept = self.p, {"f": [], "b": []}
        states = np.concatenate([self._run(d, m, n, kept[d]) for d in "fb"], axis=2)
        logits = states @ p["o"] + p["ob"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        prob = e / e.sum(axis=2, keepdims=True)
        on = np.arange(m.shape[1])[None, :] < n[:, None]
        total = on.sum()
        loss = -np.log(np.take_along_axis(prob, y[:, None, None], axis=2)[:, :, 0] + 1e-9)[on].sum() / total
        delta = prob.copy()
        np.put_along_axis(delta, np.broadcast_to(y[:, None, None], (*m.shape, 1)), np.take_along_axis(delta, np.broadcast_to(y[:, None, None], (*m.shape, 1)), 2) - 1, 2)
        delta = (delta * on[:, :, None] / total).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"] = np.einsum("ijs,ijc->sc", states, delta)
        g["ob"] = delta.sum(axis=(0, 1))
        back = delta @ p["o"].T
        for d, part in (("f", back[:, :, :STATE]), ("b", back[:, :, STATE:])):
            u, w = p[f"u{d}"], p[f"w{d}"]
            inputs = np.zeros((256, 3 * STATE), dtype=np.float32)
            later = np.zeros((len(m), STATE), dtype=np.float32)
            for t, h, z, r, c, live in reversed(kept[d]):  # backpropagation through time
                dh = later + part[:, t] * live
                own = dh * live
                dz, dc = own * (c - h) * z * (1 - z), own * z * (1 - c * c)
                dr = (dc @ u[:, 2 * STATE :].T) * h * r * (1 - r)
                gates = np.concatenate([dz, dr, dc], axis=1)
                later = np.where(live, own * (1 - z) + (dc @ u[:, 2 * STATE :].T) * r + np.concatenate([dz, dr], axis=1) @ u[:, : 2 * STATE].T, dh)
                g[f"u{d}"][:, : 2 * STATE] += h.T @ gates[:, : 2 * STATE]
                g[f"u{d}"][:, 2 * STATE :] += (r * h).T @ dc
                np.add.at(inputs, m[:, t], gates)
            g[f"w{d}"] += p["e"].T @ inputs
            g[f"b{d}"] += inputs.sum(axis=0)
            g["e"] += inputs @ w.T
        return float(loss), g

    def fit(self, words: list[bytes], which: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 5) -> Network:
        """Adam over batches of words of about one length. which, y: number of each occurring word, and its language."""
        rng, m1, m2 = np.random.default_rng(seed), {}, {}
        order = np.argsort(np.array([len(w) for w in words])[which], kind="stable")
        for step in range(1, steps + 1):
            at = rng.integers(0, max(1, len(which) - BATCH // 2))
            near = order[at : at + 4 * BATCH]
            pick = rng.choice(near, size=min(BATCH, len(near)), replace=False)
            _, g = self.gradients(*matrix([words[k] for k in which[pick]]), y[pick])
            rate = RATE * min(1, 2 - 2 * step / (steps + 1))
            for k, v in g.items():
                v = np.clip(v, -1, 1)
                m1[k], m2[k] = 0.9 * m1.get(k, 0) + 0.1 * v, 0.99 * m2.get(k, 0) + 0.01 * v * v
                self.p[k] = (self.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def pieces(word: bytes) -> list[bytes]:
    """A space and the word, cut to MOST bytes each; none without a letter."""
    if not (word.isalpha() or any(ch.isalpha() for ch in word.decode(errors="ignore"))):
        return []
    word = b" " + word
    return [word[k : k + MOST] for k in range(0, len(word), MOST)]


def train(rows: list[tuple[str, str]]) -> Network:
    """Fit a network to (text, language) rows."""
    langs = sorted({lang for _, lang in rows})
    net = Network(langs)
    words, which, y = [], [], []
    for k, lang in enumerate(langs):
        buf, offsets = flat(pa.array([t for t, own in rows if own == lang], pa.string()))
        if not len(buf):
            continue
        buf = LOWER[buf]
        at, distinct = uniques(buf, word_cuts(buf, offsets))
        cut = [pieces(c.strip()) for c in distinct]
        count = np.array([len(c) for c in cut])
        first = len(words) + np.cumsum(count) - count
        which.append(ragged(first[at], count[at]))
        y.append(np.full(len(which[-1]), k))
        words += [p for c in cut for p in c]
    if words and len(langs) > 1:
        net.fit(words, np.concatenate(which), np.concatenate(y))
    return net


class Labeller:
    def __init__(self, net: Network):
        self.net, self.memo = net, Rows(len(net.langs) + 1, MEMO)

    def words(self, words: list[bytes]) -> np.ndarray:
        """Per word the summed probabilities of its positions, and their number."""
        out = np.zeros((len(words), len(self.net.langs) + 1))
        cut = [(k, p) for k, w in enumerate(words) for p in pieces(w)]
        cut.sort(key=lambda x: len(x[1]))
        for start in range(0, len(cut), 2048):
            part = cut[start : start + 2048]
            m, n = matrix([p for _, p in part])
            prob = self.net.label(m, n) * (np.arange(m.shape[1])[None, :] < n[:, None])[:, :, None]
            np.add.at(out, [k for k, _ in part], np.concatenate([prob.sum(axis=1), n[:, None]], axis=1))
        return out

    def documents(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities, documents x languages; zeros without a letter."""
        sums = chunk_sums(buf, offsets, self.memo, self.words)
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1)


def identify(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """id, lang_pred and score of every row; with whole=True a struct `row` of all its columns, whatever their names, takes the id's place."""
    prepare(docs.sparkSession)
    state = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers, whatever the input
    token = uuid.uuid4().hex
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if whole else [id_col])]).alias("row"), F.col(f"`{text_col}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(token, lambda: Labeller(state.value))
        langs = [*own.net.langs, "und"]
        for rows, buf, offsets in slices(batches, "t"):
            if own.net.langs:
                prob = own.documents(buf, offsets)
                best, score = prob.argmax(axis=1), prob.max(axis=1)
                best[score == 0] = len(langs) - 1
            else:
                best, score = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array([langs[k] for k in best]), pa.array(np.minimum(score, 1.0))], names=["row", "lang_pred", "score"])

    found = carried.mapInArrow(run, carried.select("row").schema.add("lang_pred", "string").add("score", "double"))
    return found if whole else found.select(F.col(f"row.`{id_col}`").alias(id_col), "lang_pred", "score")


def learn(docs: DataFrame, where: Column, *, text_col: str = "text", lang_col: str = "lang") -> Network:
    """A network of a bounded sample of the distinct texts of each language, of the rows where `where` holds.

    Only hashes of texts are shuffled to tell copies; the texts of the chosen ones are read afterwards.
    """
    rows = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    rows = rows.withColumn("k", F.xxhash64("t"))
    chosen = bounded_sample(materialize(rows.select("k", "l").distinct(), "languages"), "l", SAMPLE_DOCS, 1)
    if not chosen:
        return train([])
    keys = docs.sparkSession.createDataFrame([(r["k"], r["l"]) for r in chosen], rows.select("k", "l").schema)
    sample = rows.join(F.broadcast(keys), ["k", "l"])  # at most SAMPLE_DOCS keys of a language
    return train([(r["t"], r["l"]) for r in bounded_texts(sample.groupBy("k", "l").agg(F.min("t").alias("t")), "l", "k", "t", SAMPLE_BYTES)])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = learn(docs, fold(F.col("doc_id"), 4) != 2)
    return identify(docs, net).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
