"""The pipeline's stages, each held against a plain form of its contract on its own input: sf0.001 with repeated
rows, repeated ids, nulls, empty and long texts, and extra columns."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import brute_components, check_pack, plain_secrets, words

from threadloom.llm import common, quality_mil
from threadloom.llm.common import stage
from threadloom.llm.queries import read

SF = "/root/testdata/sf0.001"


def plain_score(model, text):
    """Attention-weighted score of one text, passage by passage."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    w, hidden, weight = model.weights, [], []
    for at in range(0, max(1, len(raw)), quality_mil.PASSAGE):
        part = raw[at : at + quality_mil.PASSAGE]
        x = np.zeros(quality_mil.DIM)
        for a, b in zip(part, part[1:]):
            x[quality_mil.CLASS[a] * quality_mil.N + quality_mil.CLASS[b]] += 1
        x[: quality_mil.N**2] = np.sqrt(x[: quality_mil.N**2] / max(1, len(part)))
        padded = part.ljust(quality_mil.PASSAGE, b"\0")
        x[-2] = min(1.0, len({padded[i : i + 4] for i in range(quality_mil.PASSAGE - 3)}) / max(1, len(part) - 3))
        x[-1] = math.log1p(len(part)) / 7
        h = np.tanh(x @ w["w"] + w["c"])
        hidden.append(h)
        weight.append(float((np.tanh(h @ w["v"]) / (1 + np.exp(-(h @ w["u"])))) @ w["q"]))
    a = np.exp(np.array(weight) - max(weight))
    return 1 / (1 + math.exp(-float((a / a.sum()) @ np.array(hidden) @ w["o"] + w["b"])))


@pytest.fixture(scope="module")
def docs(spark):
    base = read(spark, SF, "documents")
    some = base.orderBy("doc_id").limit(40)
    odd = spark.createDataFrame([(None, "no id but words enough for a shingle", "en", "src0", 36), (900001, None, "en", "src1", 0), (900002, "", None, None, 0), (900003, "short. " * 40_000, "en", None, 280_000), (900004, "user=bobby pwd=hunter2222 and some words", "en", "src0", 40)], base.schema)
    other = some.limit(3).withColumn("text", F.concat(F.lit("Something else entirely that is only here. "), F.reverse("text")))
    whole = base.unionByName(some).unionByName(odd).unionByName(other)
    return stage(whole.withColumns({"secrets": F.lit("mine"), "_copies": F.lit(1), "Row": F.lit(2.5)}), "docs")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_stages_against_plain_forms(spark, docs):
    inputs, outputs, table = [], [], docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        inputs.append(rows_of(table))
        table = stage(step(spark, table, SF), name.replace(" ", "_"))
        assert table.columns == docs.columns
        outputs.append(rows_of(table))
    key = lambda r: tuple(map(str, (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], r["secrets"], r["_copies"], r["Row"])))

    # quality: a row stays if its own text scores so
    model = quality_mil.train(docs, read(spark, SF, "labels"))
    scores = {r["text"]: plain_score(model, r["text"]) for r in inputs[0]}
    assert min(abs(s - 0.5) for s in scores.values()) > 1e-6
    assert Counter(map(key, outputs[0])) == Counter(key(r) for r in inputs[0] if scores[r["text"]] >= 0.5)
    good = {r["doc_id"] for r in read(spark, SF, "labels").filter("quality = 1").collect()}
    held = {r["doc_id"] for r in inputs[0]} & good
    assert len({r["doc_id"] for r in outputs[0]} & held) >= 0.95 * len(held)

    # near duplicates: of each component one row stays, of the smallest id
    given = [(r["doc_id"], r["text"]) for r in inputs[1]]
    sets = {t: n for (_, t), n in zip(given, range(len(given)), strict=True)}
    of_text = {}
    by_text = brute_components(list(enumerate(sets)))
    for i, n, comp in by_text:
        of_text[list(sets)[int(i)]] = (n, comp)
    members = defaultdict(list)
    for r in inputs[1]:
        n, comp = of_text[r["text"]]
        if n and r["doc_id"] is not None:
            members[comp].append(r)
    kept = Counter(map(key, outputs[1]))
    free = [r for r in inputs[1] if r["doc_id"] is None or not of_text[r["text"]][0]]
    assert not Counter(map(key, free)) - kept
    kept -= Counter(map(key, free))
    assert sum(kept.values()) == len(members)
    for group in members.values():
        low = min(r["doc_id"] for r in group)
        assert sum(kept[key(r)] > 0 for r in {key(r): r for r in group if r["doc_id"] == low}.values()) == 1

    # secrets: spans of the plain patterns are replaced, and the linked pair of the odd row
    def clean(t):
        if t is None or t.startswith("user=bobby"):
            return t if t is None else "[SECRET] [SECRET] and some words"
        out, at = "", 0
        for _, a, b, _ in sorted(plain_secrets(t), key=lambda x: (x[1], x[3])):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        return out + t[at:]

    want = Counter()
    for r in inputs[2]:
        t = clean(r["text"])
        want[key(r | {"text": t, "n_chars": r["n_chars"] if t == r["text"] else len(t)})] += 1
    assert Counter(map(key, outputs[2])) == want
    assert not any(re.search(r'token = "[0-9a-f]', r["text"] or "") for r in outputs[2])

    # the mix: rows are copies of given rows, three at most, and sources come near their targets
    size = lambda rows: Counter({s: sum(len(words(r["text"])) for r in rows if r["source"] == s) for s in {r["source"] for r in rows}})
    before, after = Counter(map(key, inputs[3])), Counter(map(key, outputs[3]))
    assert all(k in before and n <= 3 * before[k] for k, n in after.items())
    have, taken = size(inputs[3]), size(outputs[3])
    names = sorted((s for s in have if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in have)
    weight, goal, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, set()
    while True:
        rest, w = sum(have.values()) - sum(3 * have[s] for s in full), sum(weight[s] for s in names if s not in full)
        goal = {s: 3.0 * have[s] if s in full else rest * weight[s] / w for s in names}
        over = {s for s in names if s not in full and goal[s] > 3 * have[s]}
        if not over:
            break
        full |= over
    longest = max(len(words(r["text"])) for r in inputs[3])
    assert all(abs(taken[s] - goal[s]) <= max(60, 0.05 * goal[s], longest / 2 if have[s] < 4 * longest else 0) for s in names)

    # packing: every id of every row in one piece
    check_pack(corpus_pipeline.STAGES[-1][1](spark, table, SF).collect(), [r for r in table.collect()])


def test_empty_documents(spark, docs):
    table = docs.limit(0)
    for name, step in corpus_pipeline.STAGES[:-1]:
        table = stage(step(spark, table, SF), name.replace(" ", "_"))
        assert table.columns == docs.columns and table.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() == 0


def test_staged_tables_can_be_discarded(spark):
    table = stage(spark.range(5), "five")
    path = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    import os

    assert os.path.isdir(path)
    common.discard_staged(spark)
    assert not os.path.isdir(path)
