"""Packing: concatenate all documents' tokens and cut at fixed windows.

Pass 1 tokenises each document once and writes, per scan partition, its ids and the running token count
within that partition. A prefix sum over the partition totals (a row per partition) turns local starts
into global offsets. Pass 2 reads the written table and emits a boundary record per piece, where a
document crosses windows. Only partition totals are shuffled; no document moves.

Defined results: order is that of the written table, so all but the last sequence are full and no order of rows is
needed. Null or empty text packs as the end token alone. Repeated rows are packed again. A very long document spans
many windows; its ids are held once. An empty table gives no pieces. Null ids stay null. Only doc_id and text are
read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import lean, stage

MAX_TOKENS, END_ID = 4096, 2
#: Words kept per worker; beyond it the cache starts anew.
CACHE_WORDS = 600_000
TRAIL = ".,;:!?*#$%&"
#: Texts on which the ids of words must be those of the whole, or the tokenizer is not one that parts at blanks.
PROBES = ("It's a test, isn't it?! One two", "Tab\tword\r\nnext. a1 b-c 42", "\u00e9t\u00e9, caf\u00e9! \ud55c\uad6d\uc5b4 word", "  two  blanks ", "x")
_cached: dict[tuple[int, str], object] = {}


class WordIds(dict):
    """Ids of a word as little-endian bytes. The tokenizer splits at blanks and between letters and other
    signs, so a word's ids are those of its stem followed by those of its trailing signs."""

    def __init__(self, tokenizer: object, kind: str):
        super().__init__()
        self.tokenizer, self.kind = tokenizer, kind
        mark = getattr(tokenizer.model, "end_of_word_suffix", None)
        vocab = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if mark and token.endswith(mark)]] = True

    def learn(self, words: list[str]) -> None:
        """Encodes the unseen stems of letters in one call. Each is one word to the tokenizer, so its ids end at
        the first id that ends a word; if there are not as many ends as stems, they are left to ``__missing__``."""
        stems = list({stem for word in set(words) if word not in self and (stem := word.rstrip(TRAIL)).isalpha() and stem not in self})
        if len(stems) < 2:
            return
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, self.kind)
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
        if len(cuts) == len(stems) and cuts[-1] == ids.nbytes:
            raw = ids.tobytes()
            self.update((stem, raw[a:b]) for stem, a, b in zip(stems, [0, *cuts], cuts, strict=False))

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        stem = word.rstrip(TRAIL)
        if stem and len(stem) < len(word) and stem[-1].isalpha():
            found = self[stem] + self[word[len(stem) :]]
        else:
            found = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.kind).tobytes()
        self[word] = found
        return found


def word_ids(tokenizer_json: str, kind: str) -> WordIds:
    from tokenizers import Tokenizer

    key = (zlib.crc32(tokenizer_json.encode()), kind)
    if key not in _cached:
        _cached[key] = WordIds(Tokenizer.from_str(tokenizer_json), kind)
    return _cached[key]


def text_ids(tokenizer_json: str, kind: str) -> Callable[[str], bytes]:
    """Ids of a text as bytes: by its words, kept for the next texts, if the tokenizer gives the probes the same ids
    by words as whole; else by the tokenizer on whole texts."""
    ids_of = word_ids(tokenizer_json, kind)

    def by_words(text: str) -> bytes:
        words = words_of(text)
        ids_of.learn(words)
        return b"".join(map(ids_of.__getitem__, words))

    def whole(text: str) -> bytes:
        return np.array(ids_of.tokenizer.encode(text, add_special_tokens=False).ids, kind).tobytes()

    return by_words if all(by_words(t) == whole(t) for t in PROBES) else whole


def words_of(text: str) -> list[str]:
    if text.isascii() and "<|" not in text:
        text = text.lower()  # beyond ASCII the tokenizer's own normaliser decides, and special tokens are matched before it
    return text.replace("\n", " ").split(" ")


def tokenised(docs: DataFrame, tokenizer_json: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, local_start, doc_tokens and ids (two bytes each if the vocabulary allows, else four)."""
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_str(tokenizer_json).get_vocab_size(), end_id + 1)
    kind = "<u2" if size <= 65536 else "<u4"
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary file, whatever the input's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end, width = text_ids(shared.value, kind), np.array([end_id], kind).tobytes(), int(kind[-1])
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, starts, held = [], [], 0
            keys, texts = batch.column(0), batch.column(1)
            first = 0
            for i in range(len(batch)):
                text = texts[i].as_py()
                ids = (ids_of(text) if text else b"") + end
                rows.append(ids)
                starts.append(at)
                at += len(ids) // width
                held += len(ids)
                if held > 8 << 20 or i + 1 == len(batch):
                    n = [len(x) // width for x in rows]
                    yield pa.RecordBatch.from_arrays([keys.slice(first, len(rows)), pa.array([part] * len(rows), pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "part", "local_start", "doc_tokens", "ids"])
                    first, rows, starts, held = i + 1, [], [], 0

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, part int, local_start long, doc_tokens long, ids binary")


def concat_and_cut(docs: DataFrame, tokenizer_json: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    table = stage(tokenised(docs, tokenizer_json, end_id), "tokens")
    totals = table.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("part", before.alias("base"))
    placed = table.join(F.broadcast(bases), "part")  # a row per scan partition

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            keys, begins, counts, idss = (batch.column(k) for k in range(4))
            for i in range(len(batch)):
                key, at, n, raw = keys[i].as_py(), begins[i].as_py(), counts[i].as_py(), idss[i].as_buffer()
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4", copy=False)
                start = 0
                while start < n:
                    offset = (at + start) % max_tokens
                    length = min(max_tokens - offset, n - start)
                    row = (key, start, length, zlib.crc32(ids[start : start + length].tobytes()), n, (at + start) // max_tokens, offset)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    rows = placed.select("doc_id", (F.col("base") + F.col("local_start")).alias("at"), "doc_tokens", "ids")
    return rows.mapInArrow(lean(cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
