"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are made unit length; equal vectors are first joined into one class with its smallest ids, which
is exact as ties go to smaller ids. Classes are dealt to shards by hash; a shard holds the mean of ``SHARD`` and of
all that there are, at most ``LARGEST``, so that shards grow with the table while a task's memory stays bounded. Each
shard builds its graph: levels drawn by hash, points inserted in blocks by beam search over flat
neighbour arrays, neighbours chosen by the diversity rule, back links cut to the nearest. All queries
search all shards by beam; a task is a shard with at most about ``QUERIES`` of them, and beyond that the shard's graph
is built in several tasks. Shard results merge by a top-k per query, and the found vectors are scored
again in double precision on the original values. Work grows with queries times shards.

Defined results: an empty table gives an empty result. Ties in score go to the smaller vec_id. Only vec_id and
embedding are read, so extra columns of any name do no harm. Vectors that are null, zero, or hold null or non-finite components take no part, neither as queries. With
fewer than k candidates all are returned. Vectors of another length than the query's are never compared:
shards are dealt by length as well. Null ids take no part.

Repeated rows (same vec_id, equal vector) count once, as neighbours and as queries. Rows of one vec_id with
other vectors all take part: the id is asked with each of its vectors, and a neighbour has one rank, by the
best score of its vectors. An id is never its own neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import stage

SHARD, LARGEST, QUERIES, LINKS, EF_BUILD, EF, BLOCK = 8192, 65_536, 250_000, 16, 64, 96, 256


def _hash01(x: np.ndarray) -> np.ndarray:
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


class Graph:
    """Points ``x`` (unit rows); ``near[level]`` is a flat array (points, width) of neighbours, -1 for none."""

    def __init__(self, x: np.ndarray, keys: np.ndarray):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        level = np.minimum((-np.log(np.maximum(_hash01(keys), 1e-12)) / np.log(LINKS)).astype(int), 6)
        order = np.lexsort((keys, -level))  # the highest first, so that the entry point is never replaced
        self.level, self.entry = level, int(order[0])
        self.near = [np.full((n, LINKS * (2 if lv == 0 else 1)), -1, np.int32) for lv in range(int(level.max()) + 1)]
        for k in range(0, n, BLOCK):
            self._insert(order[k : k + BLOCK], first=k == 0)

    def _insert(self, block: np.ndarray, first: bool) -> None:
        q = self.x[block]
        inner = q @ q.T
        start = np.full(len(block), self.entry)
        for lv in range(len(self.near) - 1, -1, -1):
            joins = self.level[block] >= lv
            if first:
                ids, sims = np.empty((len(block), 0), int), np.empty((len(block), 0), np.float32)
            else:
                ids, sims = self.beam(q, start[:, None], lv, EF_BUILD if joins.any() else 1)
                start = ids[:, 0]
            if not joins.any():
                continue
            # points of the block see those before them in it
            here = np.flatnonzero(joins)
            earlier = np.where(np.tril(np.ones((len(here), len(here)), bool), -1), inner[np.ix_(here, here)], -9.0)
            cand = np.concatenate([ids[here], np.where(earlier > -9, block[here][None, :], -1)], 1)
            sim = np.concatenate([sims[here], earlier.astype(np.float32)], 1)
            top = np.argsort(-sim, 1, kind="stable")[:, :EF_BUILD]
            self._link(block[here], np.take_along_axis(cand, top, 1), np.take_along_axis(sim, top, 1), lv)

    def _link(self, who: np.ndarray, cand: np.ndarray, sim: np.ndarray, lv: int) -> None:
        if not cand.shape[1]:
            return
        valid = (cand >= 0) & (sim > -5)
        vec = self.x[np.where(valid, cand, 0)]
        mutual = np.einsum("bcd,bed->bce", vec, vec)
        chosen, count = np.zeros_like(valid), np.zeros(len(who), int)
        for c in range(cand.shape[1]):  # keep a candidate that is nearer to the point than to any kept one
            clash = (chosen & (mutual[:, c] > sim[:, c, None])).any(1)
            take = valid[:, c] & ~clash & (count < LINKS)
            chosen[:, c] = take
            count += take
        for c in range(cand.shape[1]):  # then fill up with the nearest left
            take = valid[:, c] & ~chosen[:, c] & (count < LINKS)
            chosen[:, c] |= take
            count += take
        rows, cols = np.nonzero(chosen)
        a, b, s = who[rows], cand[rows, cols], sim[rows, cols]
        self._merge(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s]), lv)

    def _merge(self, at: np.ndarray, to: np.ndarray, sim: np.ndarray, lv: int) -> None:
        if not len(at):
            return
        near = self.near[lv]
        nodes = np.unique(at)
        old = near[nodes]
        r, c = np.nonzero(old >= 0)
        a0, t0 = nodes[r], old[r, c]
        at, to = np.concatenate([a0, at]), np.concatenate([t0, to])
        sim = np.concatenate([np.einsum("nd,nd->n", self.x[a0], self.x[t0]), sim])
        order = np.lexsort((to, -sim, at))
        at, to = at[order], to[order]
        same = np.concatenate([[False], (at[1:] == at[:-1]) & (to[1:] == to[:-1])])
        at, to = at[~same], to[~same]
        begin = np.concatenate([[True], at[1:] != at[:-1]])
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
        ok = rank < near.shape[1]
        near[nodes] = -1
        near[at[ok], rank[ok]] = to[ok]

    def beam(self, q: np.ndarray, start: np.ndarray, lv: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``ef`` found for each query: ids (-1 for none) and similarities, best first."""
        near, b = self.near[lv], len(q)
        ids = np.full((b, ef), -1, np.int64)
        sims, done = np.full((b, ef), -9.0, np.float32), np.ones((b, ef), bool)
        m = start.shape[1]
        ids[:, :m] = start
        sims[:, :m] = np.einsum("bd,bmd->bm", q, self.x[start])
        done[:, :m] = False
        seen = np.zeros((b, len(self.x)), bool)
        np.put_along_axis(seen, start, True, 1)
        live = np.arange(b)
        while len(live):
            open_sim = np.where(done[live], -9.0, sims[live])
            pick = open_sim.argmax(1)
            more = open_sim[np.arange(len(live)), pick] > -9
            live, pick = live[more], pick[more]
            if not len(live):
                break
            done[live, pick] = True
            to = near[ids[live, pick]]
            fresh = (to >= 0) & ~seen[live[:, None], np.where(to >= 0, to, 0)]
            r, c = np.nonzero(fresh)
            seen[live[r], to[r, c]] = True
            new = np.full(to.shape, -9.0, np.float32)
            new[r, c] = np.einsum("nd,nd->n", q[live[r]], self.x[to[r, c]])
            all_sims = np.concatenate([sims[live], new], 1)
            keep = np.argpartition(-all_sims, ef - 1, 1)[:, :ef]
            sims[live] = np.take_along_axis(all_sims, keep, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, to, -1)], 1), keep, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), keep, 1)
        order = np.argsort(-sims, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full((len(q), 1), self.entry)
        for lv in range(len(self.near) - 1, 0, -1):
            start = self.beam(q, start, lv, 1)[0][:, :1]
        return self.beam(q, start, 0, max(ef, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, components as doubles."""
    table = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    some = table.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(finite).filter(F.exists("v", lambda c: c != 0))
    # a power of two takes very large or small components to where squares neither overflow nor vanish; cosines stay
    by = F.pow(F.lit(2.0), F.greatest(F.least(-F.floor(F.log2(F.array_max(F.transform("v", F.abs)))), F.lit(1000)), F.lit(-1000)))
    return some.withColumn("by", by).select("vec_id", F.transform("v", lambda c: c * F.col("by")).alias("v"))


def search(vectors: DataFrame, every: int = 50, k: int = 5, shard: int = SHARD, ef: int = EF) -> DataFrame:
    """query_id, rank, vec_id, score for queries with ``vec_id % every == 0`` against all other rows."""
    table = stage(usable(vectors), "vectors")
    # at most k + 1 ids of a class can be among a query's k nearest, the smallest
    by_id = Window.partitionBy("cls").orderBy("vec_id")
    whole = table.withColumn("cls", F.sha2(F.concat_ws(",", F.transform("v", lambda c: (c + 0.0).cast("string"))), 256))
    rows = stage(whole.dropDuplicates(["vec_id", "cls"]).withColumn("mark", F.xxhash64("cls")), "rows")
    ranked = rows.withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= k + 1)
    classes = stage(ranked.groupBy("cls", "mark").agg(F.min_by("v", "vec_id").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")  # k + 1 ids at most
    total = classes.count()
    n = max(1, -(-total // min(LARGEST, max(shard, int((shard * total) ** 0.5)))))
    # an id has so many vectors at most, and k ids besides the query's are among so many classes
    wide = (2 * k + 2) * (rows.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1)
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("mark").alias("query_mark"), "v")
    turns = max(1, -(-asked.count() // QUERIES))
    every_shard, every_turn = (F.explode(F.sequence(F.lit(0), F.lit(k - 1))) for k in (n, turns))
    turn = F.pmod(F.xxhash64("query_id", "query_mark"), F.lit(turns)).cast("int")
    blocks = asked.select("query_id", "v", turn.alias("turn"), every_shard.alias("shard"), F.lit(1).alias("asks"), "query_mark")
    # classes may begin with the same id, so a class is known by its first id and mark
    dealt = classes.select(F.col("ids")[0].alias("query_id"), "v", every_turn.alias("turn"), F.pmod("mark", F.lit(n)).cast("int").alias("shard"), F.lit(0).alias("asks"), F.col("mark").alias("query_mark"))
    task = (F.col("shard") * turns + F.col("turn")).cast("int")
    both = blocks.unionByName(dealt).select("query_id", "v", task.alias("task"), "asks", "query_mark").repartitionById(n * turns, "task").sortWithinPartitions("task", "asks", "query_id", "query_mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a shard come together, its points before its queries; queries pass in blocks."""
        state: dict = {"shard": None, "points": {}, "keys": {}, "marks": {}, "graphs": None}

        def built() -> dict:
            if state["graphs"] is None:
                state["graphs"] = {d: (Graph(_unit(np.array(p)), np.array(state["keys"][d])), np.array(state["keys"][d]), np.array(state["marks"][d])) for d, p in state["points"].items()}
                state["points"] = {}
            return state["graphs"]

        for batch in batches:
            out: list[tuple] = []
            keys, shards, asks = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            marks = batch.column(4).to_pylist()
            vecs = batch.column(1).to_pylist()
            queries: dict[int, list[int]] = {}

            def flush() -> None:
                for d, rows in queries.items():
                    if d in built():
                        graph, ids, seconds = state["graphs"][d]
                        most = min(wide, len(ids))
                        for at in range(0, len(rows), BLOCK):
                            part = rows[at : at + BLOCK]
                            found, sims = graph.search(_unit(np.array([vecs[i] for i in part])).astype(np.float32), max(ef, most))
                            for i, f, s in zip(part, found[:, :most], sims[:, :most], strict=True):  # noqa: B023
                                out.extend((keys[i], marks[i], int(ids[j]), int(seconds[j]), float(x)) for j, x in zip(f, s, strict=True) if j >= 0 and x > -5)  # noqa: B023
                queries.clear()  # noqa: B023

            for i, (sh, ask) in enumerate(zip(shards, asks, strict=True)):
                if sh != state["shard"]:
                    flush()
                    state.update(shard=sh, points={}, keys={}, marks={}, graphs=None)
                d = len(vecs[i])
                if ask:
                    queries.setdefault(d, []).append(i)
                else:
                    state["points"].setdefault(d, []).append(vecs[i])
                    state["keys"].setdefault(d, []).append(keys[i])
                    state["marks"].setdefault(d, []).append(marks[i])
            flush()
            names = ["query_id", "query_mark", "found", "mark"]
            *found, near = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in found), pa.array(near, pa.float64())], [*names, "near"])

    hits = both.mapInArrow(run, "query_id long, query_mark long, found long, mark long, near double")
    best = Window.partitionBy("query_id", "query_mark").orderBy(F.desc("near"), "found", "mark")
    merged = hits.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= wide).drop("r", "near")
    members = classes.select(F.col("ids")[0].alias("found"), "mark", "ids", F.col("v").alias("w"))
    pairs = merged.join(members, ["found", "mark"]).join(asked, ["query_id", "query_mark"])
    sums = F.aggregate(F.arrays_zip("v", "w"), F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda acc, x: F.struct((acc["d"] + x["v"] * x["w"]).alias("d"), (acc["a"] + x["v"] * x["v"]).alias("a"), (acc["b"] + x["w"] * x["w"]).alias("b")), lambda acc: acc["d"] / (F.sqrt(acc["a"]) * F.sqrt(acc["b"])))
    scored = pairs.select("query_id", F.explode("ids").alias("vec_id"), sums.alias("score")).filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(last).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute_force(pdf: pd.DataFrame, every: int = 50, k: int = 5) -> pd.DataFrame:
    """The exact answer for small tables, for tests and recall figures."""
    rows = []
    x, ids = _unit(np.stack(pdf["embedding"]).astype(float)), pdf["vec_id"].to_numpy()
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        rows += [(int(ids[i]), r, int(ids[j]), float(s[j])) for r, j in enumerate(order, 1)]
    return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])
