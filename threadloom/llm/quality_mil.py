"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded from the frequencies of byte
classes and of pairs of them, and from how many of its four-byte runs are distinct. A hidden layer, gated
attention (tanh times sigmoid) and a logistic output are learned from document labels; the score is that
of the weighted passage representation. The fit uses at most ``TRAIN_DOCS`` labelled documents, those with
the smallest hash of their id, and of a long one a part of ``TRAIN_CHARS`` characters; scoring covers all passages of
all texts.

Defined results: null and empty texts are one passage of zeros and get a score. Without labels of both classes every
score is the share of label 1, or 0.5. Repeated labels of a document count as the largest; of repeated rows of one id
the smallest text trains, and each row gets its score, equal texts equal ones. Null ids are not held out. An empty
table gives an empty result. A score of exactly 0.5 counts as label 1. Extra columns of any name pass through
``keep_mask`` and are not read by ``scored``. A very long text is scored alone; its features are held in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import lean, slices
from threadloom.llm.language_crf import held_out

PASSAGE, TRAIN_DOCS, TRAIN_CHARS, HIDDEN, GATE, EPOCHS, RATE = 512, 3000, 30_000, 24, 12, 30, 0.01
#: Byte classes; the last is padding.
GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"#*$%&", b"\"'`", b"()[]{}<>", b"-_", b":;/\\=+|@^~")
HIGH, OTHER, PAD = len(GROUPS), len(GROUPS) + 1, len(GROUPS) + 2
N = PAD + 1
DIM = N * N + 2
#: Passages encoded at once, and bytes of text scored at once; they bound memory and have no part in the result.
AT_ONCE, SCORED_BYTES = 1024, 1 << 20


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.int64)
    table[128:] = HIGH
    for i, chars in enumerate(GROUPS):
        table[np.frombuffer(chars, np.uint8)] = i
    return table


CLASS = _classes()


def _features(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Features of passages: rows of ``PASSAGE`` bytes, of which the first ``sizes`` are text."""
    kinds = np.where(np.arange(PASSAGE) < sizes[:, None], CLASS[data], PAD)
    pair = kinds[:, :-1] * N + kinds[:, 1:] + (np.arange(len(data)) * (N * N))[:, None]
    hist = np.bincount(pair.ravel(), minlength=len(data) * N * N).reshape(len(data), N, N).astype(np.float32)
    hist[:, PAD], hist[:, :, PAD] = 0, 0
    runs = np.sort(np.lib.stride_tricks.sliding_window_view(data, 4, 1).copy().view(np.uint32)[:, :, 0], 1)
    distinct = (np.diff(runs, axis=1) != 0).sum(1) + 1
    out = np.empty((len(data), DIM), np.float32)
    out[:, : N * N] = np.sqrt(hist.reshape(len(data), -1) / np.maximum(sizes, 1)[:, None])
    out[:, -2], out[:, -1] = np.minimum(1.0, distinct / np.maximum(sizes - 3, 1)), np.log1p(sizes) / 7
    return out


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (rows x DIM) and the number of passages of each text."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([max(1, -(-len(r) // PASSAGE)) for r in raws])
    joined = b"".join(r.ljust(int(c) * PASSAGE, b"\x00") for r, c in zip(raws, counts, strict=True))
    data = np.frombuffer(joined, np.uint8).reshape(-1, PASSAGE)
    lasts = np.cumsum(counts) - 1
    sizes = np.full(len(data), PASSAGE)
    sizes[lasts] = [len(r) - (int(c) - 1) * PASSAGE for r, c in zip(raws, counts, strict=True)]
    out = np.empty((len(data), DIM), np.float32)
    for k in range(0, len(data), AT_ONCE):
        out[k : k + AT_ONCE] = _features(data[k : k + AT_ONCE], sizes[k : k + AT_ONCE])
    return out, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Weights: w (DIM, HIDDEN), c, v and u (HIDDEN, GATE), q (GATE), o (HIDDEN), b; all by name."""

    def __init__(self, weights: dict[str, np.ndarray] | None, share: float = 0.5):
        self.weights, self.share = weights, share

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple:
        w = self.weights
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])
        bag = np.repeat(np.arange(len(counts)), counts)
        h = np.tanh(x @ w["w"] + w["c"])
        t, s = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
        e = (t * s) @ w["q"]
        a = np.exp(e - np.maximum.reduceat(e, at)[bag])
        a = a / np.add.reduceat(a, at)[bag]
        z = np.add.reduceat(a[:, None] * h, at)
        return _sigmoid(z @ w["o"] + w["b"]), (at, bag, h, t, s, a, z)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of texts, attention of all passages, passages of each text."""
        x, counts = encode(texts)
        if self.weights is None:
            return np.full(len(texts), self.share), np.ones(len(x)), counts
        p, (_, _, _, _, _, a, _) = self.forward(x, counts)
        return p.astype(float), a, counts


def fit(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    y_all = np.array(labels, np.float32)
    if not len(y_all) or y_all.min() == y_all.max():
        return Model(None, float(y_all.mean()) if len(y_all) else 0.5)
    x_all, counts = encode(texts)
    starts = np.concatenate([[0], np.cumsum(counts)])
    rng = np.random.default_rng(seed)
    shape = {"w": (DIM, HIDDEN), "c": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "q": (GATE,), "o": (HIDDEN,), "b": ()}
    m = Model({k: np.asarray(rng.normal(0, (s[0] if s else 1) ** -0.5, s) * (k not in "cb"), np.float32) for k, s in shape.items()})
    first = {k: np.zeros(s, np.float32) for k, s in shape.items()}
    second = {k: np.zeros(s, np.float32) for k, s in shape.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y_all))
        for k0 in range(0, len(order), 64):
            pick = order[k0 : k0 + 64]
            x, n, y = np.concatenate([x_all[starts[i] : starts[i + 1]] for i in pick]), counts[pick], y_all[pick]
            p, (at, bag, h, t, s, a, z) = m.forward(x, n)
            w, d = m.weights, (p - y) / len(y)
            dz = d[:, None] * w["o"]
            da = (dz[bag] * h).sum(1)
            de = a * (da - np.add.reduceat(a * da, at)[bag])
            dt, ds = de[:, None] * w["q"] * s * (1 - t * t), de[:, None] * w["q"] * t * s * (1 - s)
            dh = (a[:, None] * dz[bag] + dt @ w["v"].T + ds @ w["u"].T) * (1 - h * h)
            grads = {"w": x.T @ dh, "c": dh.sum(0), "v": h.T @ dt, "u": h.T @ ds, "q": (t * s).T @ de, "o": z.T @ d, "b": d.sum()}
            step += 1
            for name, g in grads.items():
                g = g + 1e-4 * w[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                w[name] = np.asarray(w[name] - RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8), np.float32)
    return m


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Model:
    """Ids of the sample come from ``labels`` alone; the join with texts then keeps only those, and of a long text the
    part of ``chars`` characters that the hash of its id picks."""
    one = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    t = F.coalesce("text", F.lit(""))
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length(t) - chars + 1)).cast("int") + 1
    texts = docs.select("doc_id", F.when(F.length(t) > chars, F.substr(t, at, F.lit(chars))).otherwise(t).alias("text"))
    chosen = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))  # train_docs rows at most
    rows = sorted((r["doc_id"], r["text"], r["y"]) for r in chosen.collect())
    return fit([r[1] for r in rows], [int(r[2] == 1) for r in rows])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, attention_on (the passage with the largest weight), n_passages, in scan order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SCORED_BYTES):
                p, a, counts = model.score(part.column(1).to_pylist())
                at = np.concatenate([[0], np.cumsum(counts)])
                on = [int(a[at[i] : at[i + 1]].argmax()) for i in range(len(counts))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(p, pa.float64()), pa.array(on, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "score", "attention_on", "n_passages"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, score double, attention_on long, n_passages long")


def keep_mask(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``least``, all columns as they were."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, SCORED_BYTES):
                p, _, _ = model.score(part.column(at).to_pylist())
                yield part.filter(pa.array(p >= least))

    return docs.mapInArrow(lean(run), docs.schema)


def quality(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1) -> DataFrame:
    model = train(docs, labels.filter(~held_out(F.col("doc_id"), parts, part)))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "attention_on", "n_passages")
