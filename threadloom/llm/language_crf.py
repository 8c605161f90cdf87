"""Language of words and documents by a linear-chain conditional random field.

Emission weights come from hashed affixes, character n-grams and the whole word as a lexicon entry;
transition weights between languages are learned with them, by the gradient of the chain likelihood
(forward-backward). Training chains are spliced from labelled documents so that switches occur. The fit
uses at most ``PER_LANG`` labelled documents of each language, those with the smallest hash of their id, and
of a long one a passage of ``TRAIN_CHARS`` characters that the hash picks; what comes to the driver is that
many passages for each language of the table.

Prediction covers every word of every text, and a text is one chain, however long. It is worked in segments of
``CHAIN`` words: a segment's transfer matrix tells what it does to a message, messages go from segment to segment
in both directions, and then all segments are summed at once with the right messages at their ends. Words of over
``PIECE`` signs are several words of the chain, which overlap by two signs, so no n-gram is left out and texts
without blanks count whole. A document's language has the largest mean posterior over its words with a letter.

Defined results: null texts, empty texts and texts without a letter get ``und`` with score 0; without any labelled
row all get that. An empty table gives an empty result. Rows with a null id or language train nothing; null ids are
not held out. Of repeated ids with one language the smallest passage trains. Repeated rows get equal predictions. Of
languages that tie the first by name is taken. Only doc_id, text and lang are read, so extra columns of any name do
no harm. A very long text is held once, with four bytes for each word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAIN, PER_LANG, TRAIN_CHARS, PIECE = 64, 250, 20_000, 40
HASH_BITS, STEPS, BATCH, RATE, DECAY = 15, 60, 256, 0.15, 1e-5
#: Words and stems that a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 700_000
#: Characters of a text that are split into words at once, and segments that are worked on at once.
SPLIT_CHARS, SEGMENTS = 1 << 20, 2048
EDGE = ".,;:!?*#$%&\"'()[]{}<>«»¿¡-_=+/\\|~^`@0123456789"
BLANK = re.compile(r"\s")


def held_out(key: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % parts == part, F.lit(False))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


POWERS = np.cumprod(np.full(3 * PIECE + 8, 0x100000001B3, np.uint64))


def features(stems: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of the weight table for each kind of feature, with where the rows of each stem begin: runs of two and
    three signs of ``<stem>``, beginnings and ends of up to three, and the whole."""
    sizes = np.array([len(s) for s in stems]) + 2
    code = np.frombuffer("".join(f"<{s}>" for s in stems).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(code)) - np.repeat(begin, sizes)
    out = []
    for n in (2, 3):
        h = np.full(len(code) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * POWERS[0] + code[i : len(code) - n + 1 + i]
        inside = (place < np.repeat(sizes, sizes) - n + 1)[: len(h)]
        out.append((_mixed(h)[inside], begin - np.arange(len(stems)) * (n - 1)))
    for n in (1, 2, 3):
        for kind, at in ((4, begin + 1), (8, begin + np.maximum(sizes - 1 - n, 0))):
            h = np.full(len(stems), n + kind, np.uint64)
            for i in range(n):
                h = h * POWERS[0] + code[np.minimum(at + i, begin + sizes - 1)]
            out.append((_mixed(h), np.arange(len(stems))))
    out.append((_mixed(np.add.reduceat(code * POWERS[place], begin) + np.uint64(16)), np.arange(len(stems))))
    return out


def feature_counts(stems: list[str]) -> np.ndarray:
    return np.array([2 * len(s) + 8 for s in stems])


class Scores(dict):
    """Row of the emission table by word; row 0 is for words without a letter. Unseen words get a row at once and
    their scores together, by ``learn``."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights, self.stems, self.new = weights, {}, []
        self.table = np.zeros((1, weights.shape[1]), np.float32)

    def room(self) -> None:
        """Between batches only, as rows given out before would lose their meaning."""
        if len(self) > CACHE_WORDS:
            self.clear()
            self.stems.clear()
            self.table = self.table[:1]

    def __missing__(self, word: str) -> int:
        stem = word.strip(EDGE).lower()  # three times as long at most
        row = self.stems.get(stem)
        if row is None:
            row = 0
            if any(map(str.isalpha, stem)):
                row = self.stems[stem] = len(self.stems) + 1
                self.new.append(stem)
        self[word] = row
        return row

    def learn(self) -> None:
        for at in range(0, len(self.new), 1 << 14):
            stems = self.new[at : at + (1 << 14)]
            total = sum(np.add.reduceat(self.weights[rows], begin) for rows, begin in features(stems))
            self.table = np.concatenate([self.table, (total / feature_counts(stems)[:, None] ** 0.5).astype(np.float32)])
        self.new = []

    def rows(self, text: str) -> np.ndarray:
        """Rows of the words of a text, which is split in slices."""
        out, at = [np.empty(0, np.int32)], 0
        while at < len(text):
            end = at + SPLIT_CHARS
            if end < len(text):
                blank = BLANK.search(text, end)
                end = blank.start() if blank else len(text)
            words = (text[at:end] if at or end < len(text) else text).split()
            if words and len(max(words, key=len)) > PIECE:
                words = [p for w in words for p in ([w] if len(w) <= PIECE else (w[i : i + PIECE] for i in range(0, len(w) - 2, PIECE - 2)))]
            out.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
            at = end
        return np.concatenate(out) if len(out) > 2 else out[-1]


def forward_backward(emission: np.ndarray, mask: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of states, expected transitions and log normalisers of chains (n, steps, states).

    ``mask`` is false after a chain's end; scores are logarithms."""
    n, steps, k = emission.shape
    top = emission.max(2, keepdims=True)
    obs, m, start = np.exp(emission - top), np.exp(move), np.exp(first)
    alpha, beta, scale = np.empty_like(obs), np.ones_like(obs), np.ones((n, steps), obs.dtype)
    a = obs[:, 0] * start
    for t in range(steps):
        if t:
            a = (a @ m) * obs[:, t]
        s = a.sum(1)
        a = a / s[:, None]
        alpha[:, t], scale[:, t] = a, s
    for t in range(steps - 2, -1, -1):
        b = (obs[:, t + 1] * beta[:, t + 1]) @ m.T
        b /= b.sum(1, keepdims=True)
        beta[:, t] = np.where(mask[:, t + 1, None], b, 1.0)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    right = obs[:, 1:] * beta[:, 1:]
    z = np.einsum("ntk,kl,ntl->nt", alpha[:, :-1], m, right)
    pairs = np.einsum("ntk,ntl->kl", alpha[:, :-1] * (mask[:, 1:] / np.maximum(z, 1e-30))[:, :, None], right) * m
    logz = ((np.log(scale) + top[:, :, 0]) * mask).sum(1)
    return post, pairs, logz


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, first: np.ndarray, move: np.ndarray):
        self.langs, self.weights, self.first, self.move = langs, weights, first, move


def fit(rows: list[tuple[str, str]], langs: list[str], seed: int = 7) -> Model:
    """From (text, lang): Adagrad steps on batches of spliced chains."""
    k, rng = len(langs), np.random.default_rng(seed)
    weights, first, move = np.zeros((1 << HASH_BITS, k), np.float32), np.zeros(k), np.zeros((k, k))
    words, pieces = Scores(weights), []
    for text, lang in rows:
        ids = words.rows(text)
        for at in range(0, len(ids), 16):
            if len(ids) - at >= 4:
                pieces.append((ids[at : at + 16], langs.index(lang)))
    if not pieces or not words.new:
        return Model(langs, weights, first, move)
    stems = words.new
    grid = np.full((len(stems) + 1, 2 * max(map(len, stems)) + 8), -1)
    filled = np.zeros(len(stems), np.int64)
    for found, begin in features(stems):
        sizes = np.diff(np.append(begin, len(found)))
        owner = np.repeat(np.arange(len(stems)), sizes)
        grid[owner + 1, filled[owner] + np.arange(len(found)) - np.repeat(begin, sizes)] = found
        filled += sizes
    width = grid.shape[1]
    norm = np.maximum(1, (grid >= 0).sum(1)) ** -0.5
    by_lang = [[p for p, y in pieces if y == c] for c in range(k)]
    sums = [np.full_like(x, 1e-6, dtype=np.float64) for x in (weights, first, move)]
    for _ in range(STEPS):
        x, y = np.zeros((BATCH, CHAIN), int), np.zeros((BATCH, CHAIN), int)
        mask = np.zeros((BATCH, CHAIN), bool)
        for b in range(BATCH):
            at, lang = 0, int(rng.integers(k))
            while at < CHAIN:
                if rng.random() < 0.15:
                    lang = int(rng.integers(k))
                if not by_lang[lang]:
                    lang = next(c for c in range(k) if by_lang[c])
                p = by_lang[lang][rng.integers(len(by_lang[lang]))][: CHAIN - at]
                x[b, at : at + len(p)], y[b, at : at + len(p)], mask[b, at : at + len(p)] = p, lang, True
                at += len(p)
        used, inverse = np.unique(x, return_inverse=True)
        g = grid[used]
        table = (weights[g] * (g >= 0)[:, :, None]).sum(1) * norm[used, None]
        post, pairs, _ = forward_backward(table[inverse].reshape(BATCH, CHAIN, k).astype(np.float64), mask, first, move)
        real = np.eye(k)[y]
        miss = ((real - post) * mask[:, :, None]).reshape(-1, k)
        by_type = np.zeros((len(used), k))
        np.add.at(by_type, inverse.ravel(), miss)
        spread = np.repeat((by_type * norm[used, None])[:, None], width, 1)[g >= 0]
        grad_w = np.stack([np.bincount(g[g >= 0], spread[:, c], 1 << HASH_BITS) for c in range(k)], 1)
        seen = np.zeros((k, k))
        np.add.at(seen, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1.0)
        grads = (grad_w - DECAY * weights, (real[:, 0] - post[:, 0]).sum(0), seen - pairs)
        for value, grad, square in zip((weights, first, move), grads, sums, strict=True):
            square += grad * grad
            value += (RATE * grad / np.sqrt(square)).astype(value.dtype)
    return Model(langs, weights, first, move)


def train(docs: DataFrame, per_lang: int = PER_LANG, chars: int = TRAIN_CHARS) -> Model:
    """Fits on rows (doc_id, text, lang). Ids are ranked without their texts: counts by language give the share of
    hashes that surely holds enough ids, and only those are sorted."""
    ok = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), "text")
    counts = ok.groupBy("lang").count()
    share = F.pmod("h", F.lit(1 << 30)) * F.col("count") < F.lit((1 << 30) * (4 * per_lang + 100))
    some = ok.select("doc_id", "lang", "h").join(F.broadcast(counts), "lang").filter(share).select("doc_id", "lang", "h").distinct()  # a row per language
    rank = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "doc_id")
    chosen = some.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= per_lang).select("doc_id", "lang")
    at = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - chars + 1)).cast("int") + 1
    passages = ok.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", F.substr("text", at, F.lit(chars)).alias("text"))  # per_lang rows of a language
    rows = sorted((r["lang"], r["doc_id"], r["text"]) for r in passages.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect())  # bounded by per_lang and chars
    return fit([(t, lang) for lang, _, t in rows], sorted({r[0] for r in rows}))


def posteriors(rows: list[np.ndarray], model: Model, table: np.ndarray, whole: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """For chains of table rows: sums of the posteriors of words with a letter (chains, languages), and with
    ``whole`` those of every word (zeros for words without a letter)."""
    k = len(model.langs)
    obs = np.exp(table - table.max(1, keepdims=True))
    move, first = np.exp(model.move).astype(np.float32), np.exp(model.first).astype(np.float32)
    sizes = np.array([len(r) for r in rows])
    segs = -(-sizes // CHAIN)
    n, ends = int(segs.sum()), np.cumsum(segs)
    x = np.zeros((n, CHAIN), np.int32)
    for r, e, c in zip(rows, ends, segs, strict=True):
        x.reshape(-1)[(e - c) * CHAIN : (e - c) * CHAIN + len(r)] = r
    chain = np.repeat(np.arange(len(rows)), segs)
    at = np.arange(n) - np.repeat(ends - segs, segs)
    last = at == segs[chain] - 1
    length = np.where(last, sizes[chain] - at * CHAIN, CHAIN)
    unit = lambda v: v / v.sum(-1, keepdims=True)

    def backward(which: np.ndarray, o: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        beta = right[which]
        for t in range(CHAIN - 1, -1, -1):
            if t < CHAIN - 1:
                beta = np.where((t + 1 < length[which])[:, None], unit((o[t + 1] * beta) @ move.T), beta)
            yield t, beta

    left, right = np.tile(first, (n, 1)), np.ones((n, k), np.float32)
    if n > len(rows):  # messages over the cuts of long chains
        transfer, into = np.empty((n, k, k), np.float32), np.ones((n, k), np.float32)
        for b in range(0, n, SEGMENTS):
            which = np.arange(b, min(n, b + SEGMENTS))
            inner, outer = which[~last[which]], which[last[which] & (at[which] > 0)]
            o, p = obs[x[inner].T], np.tile(np.eye(k, dtype=np.float32), (len(inner), 1, 1))
            for t in range(CHAIN):
                p = ((p * o[t][:, None, :]).reshape(-1, k) @ move).reshape(-1, k, k)
                p /= p.sum((1, 2), keepdims=True)
            transfer[inner] = p
            if len(outer):
                o = obs[x[outer].T]
                *_, (_, beta) = backward(outer, o, right)
                into[outer] = unit(o[0] * beta)
        by_place = np.argsort(at, kind="stable")
        cuts = np.cumsum(np.bincount(at))
        for j in range(1, len(cuts)):
            s = by_place[cuts[j - 1] : cuts[j]]
            left[s] = unit(np.einsum("bk,bkl->bl", left[s - 1], transfer[s - 1]))
        for j in range(len(cuts) - 1, 0, -1):
            s = by_place[cuts[j - 1] : cuts[j]]
            right[s - 1] = unit(into[s] @ move.T)
            into[s - 1] = unit(np.einsum("bkl,bl->bk", transfer[s - 1], into[s]))
    sums, kept = np.zeros((n, k), np.float64), np.zeros((n, CHAIN, k), np.float32) if whole else None
    for b in range(0, n, SEGMENTS):
        which = np.arange(b, min(n, b + SEGMENTS))
        o, seen = obs[x[which].T], x[which].T > 0
        alpha = np.empty_like(o)
        for t in range(CHAIN):
            alpha[t] = unit((alpha[t - 1] @ move if t else left[which]) * o[t])
        for t, beta in backward(which, o, right):
            post = unit(alpha[t] * beta) * seen[t][:, None]
            sums[which] += post
            if whole:
                kept[which, t] = post
    total = np.zeros((len(rows), k))
    np.add.at(total, chain, sums)
    return total, [kept.reshape(-1, k)[(e - c) * CHAIN :][: len(r)] for r, e, c in zip(rows, ends, segs, strict=True)] if whole else []


def word_posteriors(texts: list[str | None], model: Model, scores: Scores) -> list[np.ndarray]:
    """For each text an array (words, languages); words without a letter have zeros."""
    scores.room()
    rows = [scores.rows(t or "") for t in texts]
    scores.learn()
    return posteriors(rows, model, scores.table, whole=True)[1]


def predict(docs: DataFrame, model: Model, words_at_once: int = 1 << 17) -> DataFrame:
    """doc_id, lang_pred, score."""
    k = len(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model.weights) if k else None

        def judged(keys: list, rows: list[np.ndarray]) -> pa.RecordBatch:
            if k:
                scores.learn()
            total = posteriors(rows, model, scores.table)[0] if k else np.zeros((len(rows), 1))
            n = total.sum(1)
            known = n > 0.5
            names = [model.langs[i] if ok else "und" for i, ok in zip(total.argmax(1), known, strict=True)]
            values = np.where(known, np.minimum(1.0, total.max(1) / np.maximum(n, 0.5)), 0.0)
            if k:
                scores.room()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.string()), pa.array(values, pa.float64())], ["doc_id", "lang_pred", "score"])

        for batch in batches:
            keys, rows, held = [], [], 0
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(key.as_py())
                rows.append(scores.rows(text.as_py() or "") if k else np.empty(0, np.int32))
                held += len(rows[-1])
                if held >= words_at_once:
                    yield judged(keys, rows)
                    keys, rows, held = [], [], 0
            if keys:
                yield judged(keys, rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, parts: int = 5, part: int = 0) -> DataFrame:
    model = train(docs.filter(~held_out(F.col("doc_id"), parts, part)))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "lang_pred", "score")
