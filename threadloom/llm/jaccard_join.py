"""Exact Jaccard join on word shingles, as a metric-space join.

Equal shingle sets are one class, so copies are never paired. Sets at distance 1/4 or less share at least
1/16 of the smaller one's hashes among the first 5/16 of either, in any order that all sets share, and 3/4 of
either's among all. Two rounds of counts, the second over what the first left, drop sets that cannot have a
partner. What is left is joined through pivots and Voronoi regions:

* **Pivots.** Of the classes with one prefix shingle the smallest is a pivot. Each class goes to the pivot that it
  meets most often and joins its component if near enough. Prefixes take frequent shingles last.
* **Regions.** Components whose classes share enough prefix shingles to hold a link lie in one region. A region is
  done if it is one component.
* **Cells and windows.** A region of more than ``LEAF_BYTES`` is split by ``PIVOTS`` pivots of its own: every class
  belongs to the Voronoi cell of its nearest pivot, or to the rest if it is farther than ``NEAR`` from all, and is
  copied over each border that a partner can lie behind: into the cell of q where ``d(x, q) <= d(x, p) + 1/2`` and
  ``d(x, q) <= NEAR + 1/4``, into the rest where ``d(x, p) > NEAR - 1/4``. Cells are regions again and split on.
  Each split is a Spark job; region and cell are the keys of its rows.
* **Leaves.** A region within ``LEAF_BYTES`` is joined exactly in one task (again by pivots, cells and windows
  where it is more than ``LEAF`` sets). A region that cells cannot make smaller is dealt by pairs of blocks.

Pairs inside one component need no test, and all others that can link get one, so components are exact.
Set keys and shingles are 64-bit hashes.

Defined results: null and empty texts have an empty set and link with nothing; a text of fewer words than the
shingle is one shingle; repeated rows fall in one class; an empty table gives an empty result. Ties have no part in
it: component_id is the smallest doc_id. Rows without doc_id take part through rows of the same set; a set that only
they have links with nothing. Only doc_id and text are read, so extra columns of any name do no harm;
``representatives`` keeps them. A very long text is one set of eight bytes for each distinct shingle, and a leaf
holds at least one set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from threadloom.llm.common import BROADCAST_ROWS, even_join, fresh, lean, release, slices, spread_join, stage

WORDS, NUM, DEN = 5, 3, 4  # five words; similarity of NUM / DEN or more
LEAF, PIVOTS, NEAR = 128, 8, 0.5
#: Bytes of hashes that one task joins, and how often a region is split by cells before it is dealt by blocks.
LEAF_BYTES, SPLITS = 1 << 20, 8
#: Components with one prefix shingle are told apart by pairs up to so many; of more, all are taken to be near.
CROWD = 64
#: Shingles of more than ``HOT`` classes come last in prefixes, the ``HOT_MOST`` most frequent of them at most.
HOT, HOT_MOST = 64, 200_000
#: Ids of documents alone are broadcast up to so many, as the other way shuffles all texts.
ID_ROWS = 1_000_000
CHUNK, GROUP, LONGEST = 1 << 18, 1 << 18, 128
#: A set of n has n / PART more hashes in its prefix, and needs about as many shared.
PART = 16
MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Tabulation hashing: a word's hash sums a random number for each byte and place.
TABLE = _mix(np.arange(1, LONGEST * 256 + 1, dtype=np.uint64) * MUL)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a byte array; only ASCII blanks part words, only A-Z are lowered."""
    at = np.flatnonzero(~BLANK[data])
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
    sizes = np.diff(np.append(begin, len(at)))
    place = (np.arange(len(at)) - np.repeat(begin, sizes)) % LONGEST
    h = _mix(np.add.reduceat(TABLE[place * 256 + LOWER[data[at]]], begin) + sizes.astype(np.uint64) * MUL)
    for i in np.flatnonzero(sizes > LONGEST):
        h[i] = xxhash.xxh3_64_intdigest(LOWER[data[at[begin[i]] : at[begin[i]] + sizes[i]]].tobytes())
    return h, at[begin]


def shingle_sets(texts: list[str | None], size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words, starts = word_hashes(np.frombuffer(b" ".join(raws), np.uint8))
    ends = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws])).tolist()
    h = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for i in range(size):
        h = h * MUL + words[i : i + len(h)]
    h, out, first = _mix(h), [], 0
    for end in ends:
        if end - first >= size:
            s = np.sort(h[first : end - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif end > first:
            one = np.full(1, end - first, np.uint64)
            for w in words[first:end]:
                one = one * MUL + w
            out.append(_mix(one))
        else:
            out.append(np.empty(0, np.uint64))
        first = end
    return out


def sets_of(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Shingle sets of a column of texts, in groups of about ``GROUP`` characters."""
    held, total = [], 0
    for t in column:
        held.append(t.as_py())
        total += len(held[-1] or "")
        if total > GROUP:
            yield from shingle_sets(held, size)
            held, total = [], 0
    if held:
        yield from shingle_sets(held, size)


def set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def least_shared(n: int, part: int) -> int:
    return max(1, n // part)


def prefix_size(n: int, part: int = 0) -> int:
    """How many of the smallest hashes of a set to look at. Sets that link share ``least_shared(n, part)`` of
    them, n being the smaller size, or one with part 0: of the shared hashes in order, the j-th has at least
    ``shared - j`` of its set after it, and at least NUM / DEN of a set are shared."""
    return min(n, n - (n * NUM + DEN - 1) // DEN + (least_shared(n, part) if part else 1))


def _batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def classes_of(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = [], []
            for s in sets_of(batch.column(1), size):
                n.append(len(s))
                k.append(set_key(s) if len(s) else None)
            yield _batch(["doc_id", "n_shingles", "k"], [batch.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64())])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n_shingles long, k long")


def _combined(h: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
    """Rows to shuffle for (hash, class) entries. Where a hash has several classes here already, one entry
    tells other tasks how many (c < 0) and the classes' counts (c > 0) are known; others have c = 0."""
    order = np.lexsort((k, h))
    h, k = h[order], k[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])])
    h, k = h[fresh], k[fresh]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff(np.append(begin, len(h)))
    many = np.repeat(sizes > 1, sizes)
    keys, counts = np.unique(k[many], return_counts=True)
    heads = begin[sizes > 1]
    out_h = np.concatenate([h[~many].view(np.int64), h[heads].view(np.int64), keys])
    out_k = np.concatenate([k[~many], k[heads], keys])
    out_c = np.concatenate([np.zeros(int((~many).sum()), np.int32), -sizes[sizes > 1].astype(np.int32), counts.astype(np.int32)])
    return _batch(["h", "k", "c"], [out_h, out_k, out_c])


def _entries(source: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]], columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, keys, total = set(), [], [], 0
        for batch in batches:
            for k, h in hashes_of(batch):
                if k not in seen:
                    seen.add(k)
                    held.append(h)
                    keys.append(k)
                    total += len(h)
                if total > CHUNK:
                    yield _combined(np.concatenate(held), np.repeat(np.array(keys, np.int64), list(map(len, held))))
                    held, keys, total = [], [], 0
        if held:
            yield _combined(np.concatenate(held), np.repeat(np.array(keys, np.int64), list(map(len, held))))

    return source.select(*columns).mapInArrow(lean(run), "h long, k long, c int")


def _runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut so that no run of the first column is split."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if len(held[0]) and held[0][0] != held[0][-1]:
            cut = int(np.searchsorted(held[0], held[0][-1], "left"))
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield held


def shared_counts(entries: DataFrame) -> DataFrame:
    """(k, shared): parts of the counts of a class's entries that occur in another class; and (h, -n) for a hash of
    more than ``HOT`` classes, n of about as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, k, c in _runs(batches, 3):
            direct = c > 0
            hh, kk, cc = h[~direct], k[~direct], c[~direct]
            keys, weights = k[direct], c[direct].astype(np.int64)
            if len(hh):
                begin = np.flatnonzero(np.concatenate([[True], hh[1:] != hh[:-1]]))
                sizes = np.diff(np.append(begin, len(hh)))
                often = np.add.reduceat(np.where(cc < 0, -cc.astype(np.int64), 1), begin)
                if (often > HOT).any():
                    yield _batch(["k", "shared"], [hh[begin][often > HOT], -often[often > HOT]])
                ends = begin + sizes - 1
                multi = (kk[begin] != kk[ends]) | (np.minimum.reduceat(cc, begin) < 0)  # sorted by class within a hash
                counted = np.repeat(multi, sizes) & (cc == 0)
                first = np.concatenate([[True], (hh[1:] != hh[:-1]) | (kk[1:] != kk[:-1])])
                # a class that another task knows as shared has its count there
                known = np.concatenate([[False], (hh[1:] == hh[:-1]) & (kk[1:] == kk[:-1]) & (cc[:-1] < 0)])
                keys = np.concatenate([keys, kk[counted & first & ~known]])
                weights = np.concatenate([weights, np.ones(len(keys) - len(weights), np.int64)])
            if len(keys):
                u, inv = np.unique(keys, return_inverse=True)
                yield _batch(["k", "shared"], [u, np.bincount(inv, weights).astype(np.int64)])

    dealt = entries.repartition("h").sortWithinPartitions("h", "k", "c")
    return dealt.mapInArrow(lean(run), "k long, shared long")


def summed(counts: DataFrame) -> DataFrame:
    return counts.filter("shared > 0").groupBy("k").agg(F.sum("shared").alias("shared"))


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for the vertices of edges (a, b): label is the smallest vertex that is reached.

    Labels go to neighbours, then each takes its label's label; every step is a written table."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")), "labels")
    while True:
        from_near = spread_join(both, labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        told = stage(labels.join(from_near, labels["v"] == from_near["a"], "left").select("v", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label")), "told")
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("above"))
        new = stage(spread_join(told, up, "label").select("v", F.least("label", "above").alias("label"), "old"), "labels")
        moved = new.filter("label <> old").limit(1).count()
        labels = new.select("v", "label")
        if not moved:
            return labels


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) * DEN < len(large) * NUM:
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return both * DEN >= (len(a) + len(b) - both) * NUM


WINDOW = 1 - NUM / DEN


def distance(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 1 - both / max(1, len(a) + len(b) - both)


def region_key(region: int, cell: int | None) -> int:
    return xxhash.xxh3_64_intdigest(f"{region} {cell}") - (1 << 63)


class _Union(dict):
    def root(self, x: int) -> int:
        while self.get(x, x) != x:
            self[x] = x = self.get(self[x], self[x])
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self[max(a, b)] = min(a, b)


def _inverted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each hash of the joined sets, the sets that have each hash by number, and where they begin.
    Large arrays go as soon as they are used, and numbers are short."""
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
    del flat
    begin = np.append(np.flatnonzero(fresh), len(order))
    numbers = np.empty(len(order), np.int32)
    numbers[order] = np.cumsum(fresh, dtype=np.int32) - 1
    owners = np.repeat(np.arange(len(sets), dtype=np.int32), list(map(len, sets)))[order]
    return numbers, owners, begin


def region_join(sets: list[np.ndarray], comps: list[int], left: np.ndarray, right: np.ndarray, union: _Union, out: list[tuple[int, int]], members: np.ndarray | None = None, own: np.ndarray | None = None) -> None:
    """Adds to ``out`` enough linked pairs (positions) to connect what is linked across components.

    ``left``/``right`` tell which positions belong to either block; a pair needs one of each, and one of ``own``."""
    idx = np.arange(len(sets)) if members is None else members
    own = np.ones(len(sets), bool) if own is None else own
    sizes = np.array([len(sets[i]) for i in idx])
    if len(idx) < 2 or len({union.root(comps[i]) for i in idx}) < 2:
        return
    inverse, owners, begin = _inverted([sets[i] for i in idx])
    first = np.cumsum(sizes) - sizes

    def overlaps(i: int) -> np.ndarray:
        mine = inverse[first[i] : first[i] + sizes[i]]
        lens = begin[mine + 1] - begin[mine]
        at = np.repeat(begin[mine] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        return np.bincount(owners[at], minlength=len(idx))

    if len(idx) > LEAF:
        picks = np.linspace(0, len(idx) - 1, PIVOTS).astype(int)
        inter = np.stack([overlaps(i) for i in picks], 1)
        dist = 1 - inter / (sizes[:, None] + sizes[picks][None, :] - inter)
        cell = dist.argmin(1)
        near = dist <= dist.min(1, keepdims=True) + 2 * (1 - NUM / DEN) + 1e-9  # the window over the border
        if near.sum(0).max() <= 0.7 * len(idx):
            del inverse, owners, begin
            for p in range(PIVOTS):
                if (cell == p).any():
                    region_join(sets, comps, left, right, union, out, idx[near[:, p]], own)
            return
    roots = np.array([union.root(comps[i]) for i in idx])
    most = np.bincount(np.unique(roots, return_inverse=True)[1])
    large = np.unique(roots)[most.argmax()]
    for i in np.flatnonzero(roots != large):  # pairs within the largest component need no test
        both = overlaps(i)
        ok = (both * DEN >= (sizes[i] + sizes - both) * NUM) & (left[idx[i]] & right[idx] | right[idx[i]] & left[idx]) & (own[idx[i]] | own[idx])
        for j in np.flatnonzero(ok):
            a, b = union.root(comps[idx[i]]), union.root(comps[idx[j]])
            if a != b:
                union.join(a, b)
                out.append((int(idx[i]), int(idx[j])))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (k, pivot) that link. A pivot may have very many classes."""
    a = sets.select("k", F.col("hashes").alias("x"))
    b = sets.select(F.col("k").alias("pivot"), F.col("hashes").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = [linked(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)) for i in range(len(batch))]
            yield batch.select(["k", "pivot"]).filter(pa.array(ok, pa.bool_()))

    both = even_join(stage(pairs, "asked"), b, "pivot", most=500).join(a, "k")
    return both.select("k", "pivot", "x", "y").mapInArrow(lean(run), "k long, pivot long")


def _hashes(column: pa.Array, i: int) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), np.uint64)


def _reaches(n: str, part: int) -> Column:
    """That ``shared`` is at least what a set of n has in its prefix if a set of compatible size links with it."""
    shorter = F.expr(f"({n} * {NUM} + {DEN - 1}) div {DEN}")
    return F.col("shared") >= F.greatest(F.lit(1), F.floor(shorter / F.lit(part)))


def links(docs: DataFrame, size: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_shingles, k), and (k, label) for the classes that link with another."""
    rows = stage(classes_of(docs, size), "classes")

    def from_text(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for x in sets_of(batch.column(0), size):
            if len(x):
                yield set_key(x), x[: prefix_size(len(x), PART)]

    one = rows.filter("n_shingles > 0").groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    met = summed(shared_counts(_entries(docs, from_text, ["text"])))
    chosen = stage(one.join(met, "k").filter(_reaches("n", PART)).select("doc_id").filter("doc_id is not null"), "chosen")
    few = chosen.count() <= ID_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen) if few else chosen, "doc_id")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 4 * GROUP):
                found = [x for x in sets_of(part.column(1), size) if len(x)]
                yield _batch(["k", "n", "hashes"], [pa.array([set_key(x) for x in found], pa.int64()), pa.array(list(map(len, found)), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())])

    sets = stage(texts.select("doc_id", "text").mapInArrow(lean(whole), "k long, n long, hashes binary"), "sets", "lz4")

    def from_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for i, k in enumerate(batch.column(0).to_pylist()):
            x = _hashes(batch.column(1), i)
            yield k, x

    counted = stage(shared_counts(_entries(sets, from_sets, ["k", "hashes"])), "counted")
    enough = sets.select("k", "n").distinct().join(summed(counted), "k").filter(F.col("shared") * DEN >= F.col("n") * NUM).select("k")
    left = stage(sets.join(enough, "k").dropDuplicates(["k"]), "left", "lz4")
    release(sets)
    # HOT_MOST rows at most; which shingles come last has a part in the work only, not in the result
    often = np.array([(r["k"], -r["shared"]) for r in counted.filter("shared < 0").orderBy("shared", "k").limit(HOT_MOST).collect()], np.int64).reshape(-1, 2)
    comps = components(stage(_verified(nearest_pivots(prefixes(left, often)), left).select(F.col("k").alias("a"), F.col("pivot").alias("b")), "first_links"))
    in_comp = comps.withColumnRenamed("v", "k").withColumnRenamed("label", "comp")
    named = stage(left.select("k").join(in_comp, "k", "left").select("k", F.coalesce("comp", "k").alias("comp")), "named")
    regions = components(near_components(prefixes(left.join(named, "k"), often)))
    placed = spread_join(named, regions.select(F.col("v").alias("comp"), F.col("label").alias("region")), "comp")
    active = stage(left.join(placed, "k").select("region", "comp", "k", "n", F.lit(True).alias("own"), "hashes"), "regions", "lz4")
    merged = components(stage(joined_leaves(split_regions(active)), "later_links"))
    final = spread_join(comps, merged.select(F.col("v").alias("label"), F.col("label").alias("up")), "label", "left").select(F.col("v").alias("k"), F.coalesce("up", "label").alias("label"))
    alone = merged.join(comps.select("v"), "v", "left_anti").select(F.col("v").alias("k"), "label")
    return rows, final.unionByName(alone)


def prefixes(sets: DataFrame, often: np.ndarray) -> DataFrame:
    """(h, k, n, comp) for the prefix of every set; ``often`` lists frequent hashes with their counts. Without a
    column comp every class is its own."""
    order = np.argsort(often[:, 0].view(np.uint64))
    hot, count = often[order, 0].view(np.uint64), often[order, 1]
    known = sets.sparkSession.sparkContext.broadcast((hot, count))  # HOT_MOST rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, count = known.value

        def first(x: np.ndarray) -> np.ndarray:
            size = prefix_size(len(x), PART)
            if not len(hot):
                return x[:size]
            at = np.minimum(np.searchsorted(hot, x), len(hot) - 1)
            is_hot = hot[at] == x
            rare = x[~is_hot]
            return rare[:size] if len(rare) >= size else np.concatenate([rare, x[is_hot][np.argsort(count[at[is_hot]], kind="stable")]])[:size]

        for batch in batches:
            for part in slices(batch, 1, 8 << 20):
                found = [first(_hashes(part.column(1), i)) for i in range(len(part))]
                k, n, comp = (np.repeat(part.column(c).to_numpy(), list(map(len, found))) for c in (0, 2, 3))
                yield _batch(["h", "k", "n", "comp"], [(np.concatenate(found) if found else np.empty(0, np.uint64)).view(np.int64), k, n, comp])

    comp = F.col("comp") if "comp" in sets.columns else F.col("k")
    return stage(sets.select("k", "hashes", "n", comp.alias("comp")).mapInArrow(lean(run), "h long, k long, n long, comp long"), "prefixes", "lz4")


def nearest_pivots(heads: DataFrame) -> DataFrame:
    """(k, pivot): of the smallest classes that share a prefix shingle with k, the one met most often."""
    heads = heads.select("h", "k")
    pivots = heads.groupBy("h").agg(F.min("k").alias("pivot"), F.max("k").alias("other")).filter("pivot < other").select("h", "pivot")
    met = even_join(heads, pivots, "h").filter("k <> pivot").groupBy("k", "pivot").count()
    return met.groupBy("k").agg(F.max(F.struct("count", (-F.col("pivot")).alias("m"), "pivot")).alias("b")).select("k", F.col("b.pivot").alias("pivot"))


def near_components(heads: DataFrame) -> DataFrame:
    """Edges (a, b) of components, such that a link between two of them is within one component of the edges. By
    pairs that share as many prefix shingles as a link needs; of shingles of a crowd all components are taken."""
    held = stage(heads.groupBy("h", "comp").agg(F.min("n").alias("n")), "held")
    runs = stage(held.groupBy("h").agg(F.min("comp").alias("low"), F.count("*").alias("c")).filter("c > 1"), "runs")
    crowd = even_join(held.select("h", "comp"), runs.filter(F.col("c") > CROWD).select("h", "low"), "h").select(F.col("comp").alias("a"), F.col("low").alias("b"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, comp, n in _runs(batches, 3):
            begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            sizes = np.diff(np.append(begin, len(h)))
            found = [np.empty((0, 3), np.int64)]
            for m in np.unique(sizes):
                rows = begin[sizes == m][:, None] + np.arange(m)
                i, j = np.triu_indices(m, 1)
                i, j = rows[:, i].ravel(), rows[:, j].ravel()
                found.append(np.stack([comp[i], comp[j], np.minimum(n[i], n[j])], 1))
            rows, counts = np.unique(np.concatenate(found), axis=0, return_counts=True)
            yield _batch(["a", "b", "n", "met"], [*(rows[:, c].copy() for c in range(3)), counts.astype(np.int64)])

    short = held.join(runs.filter(F.col("c") <= CROWD).select("h"), "h").select("h", "comp", "n")  # CROWD rows of a shingle
    dealt = short.repartition("h").sortWithinPartitions("h", "comp").mapInArrow(lean(pairs), "a long, b long, n long, met long")
    near = dealt.groupBy("a", "b").agg(F.sum("met").alias("met"), F.min("n").alias("n")).filter(F.col("met") >= F.greatest(F.lit(1), F.floor(F.col("n") / F.lit(PART))))
    return near.select("a", "b").unionByName(crowd)


def split_regions(active: DataFrame, leaf_bytes: int | None = None, pivots: int = PIVOTS, splits: int = SPLITS) -> DataFrame:
    """Leaves (region, i, j, block, comp, k, own, hashes) of regions (region, comp, k, n, own, hashes), a written
    table. Two classes that link and lie in different components meet in a leaf where one of them is ``own``."""
    leaf_bytes = leaf_bytes or LEAF_BYTES
    none = F.lit(0).cast("int")
    out = active.limit(0).select("region", none.alias("i"), none.alias("j"), none.alias("block"), "comp", "k", "own", "hashes")
    active = active.withColumn("up", F.lit(None).cast("long"))
    for depth in range(splits + 1):
        sizes = active.groupBy("region").agg((F.sum("n") * 8).alias("bytes"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("own").alias("some"), F.max("up").alias("before"))
        stuck = F.coalesce(F.col("bytes") > 0.7 * F.col("before"), F.lit(False)) | F.lit(depth == splits)
        todo = stage(sizes.filter("low < high and some").select("region", "bytes", F.when(F.col("bytes") <= leaf_bytes, 1).when(stuck, F.ceil(F.col("bytes") / leaf_bytes)).otherwise(0).cast("int").alias("blocks")), "sizes")
        held = spread_join(active, todo, "region")
        dealt = held.filter("blocks > 0").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        out = out.unionByName(dealt.select("region", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "comp", "k", "own", "hashes"))
        large = todo.filter("blocks = 0").select("region", "bytes")
        if large.isEmpty():
            break
        chosen = held.filter("blocks = 0").groupBy("region").agg(*(F.min_by("k", F.xxhash64("k", F.lit(depth * pivots + i))).alias(f"p{i}") for i in range(pivots)))
        chosen = stage(chosen.select("region", F.explode(F.array_distinct(F.array(*(f"p{i}" for i in range(pivots))))).alias("k")), "chosen_pivots")
        centres = active.select("region", "k", "hashes").join(F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen, ["region", "k"])
        centres = centres.groupBy("region").agg(F.collect_list(F.struct("k", "hashes")).alias("centres"))  # pivots sets at most
        rows = even_join(stage(spread_join(active, large, "region"), "large", "lz4"), stage(centres, "centres", "lz4"), "region", most=200)
        active = stage(_to_cells(rows), "cells", "lz4")
    return out


def _to_cells(rows: DataFrame) -> DataFrame:
    """Rows of regions, each with its region's pivots, as rows of cells: one of its own and one for each border that
    a partner can lie behind. ``up`` is the size of the region."""
    names = ["region", "comp", "k", "n", "own", "hashes", "up"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 5, 4 << 20, rows=64):
                out: list[tuple] = []
                for region, comp, k, n, own, hashes, up, centres in zip(*(part.column(c).to_pylist() for c in range(8)), strict=True):
                    x = np.frombuffer(hashes, np.uint64)
                    near = sorted((distance(x, np.frombuffer(c["hashes"], np.uint64)), c["k"]) for c in centres)
                    least, home = near[0]
                    for d, q in near:
                        if d <= min(least + 2 * WINDOW, NEAR + WINDOW) + 1e-9:
                            out.append((region_key(region, q), comp, k, n, own and q == home and d <= NEAR, hashes, up))
                    if least > NEAR - WINDOW - 1e-9:
                        out.append((region_key(region, None), comp, k, n, own and least > NEAR, hashes, up))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64()]
                columns = list(zip(*out, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    return rows.select("region", "comp", "k", "n", "own", "hashes", F.col("bytes").alias("up"), "centres").mapInArrow(lean(run), "region long, comp long, k long, n long, own boolean, hashes binary, up long")


def joined_leaves(leaves: DataFrame) -> DataFrame:
    """Links (a, b) of components from leaves."""

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("k").sort_values("k") if pdf["own"].all() else pdf.sort_values(["k", "own"], ascending=[True, False]).drop_duplicates("k")
        sets = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
        out: list[tuple[int, int]] = []
        block, comp = pdf["block"].to_numpy(), pdf["comp"].to_numpy()
        region_join(sets, comp.tolist(), block == pdf["i"].iloc[0], block == pdf["j"].iloc[0], _Union(), out, own=pdf["own"].to_numpy())
        return pd.DataFrame({"a": [comp[a] for a, _ in out], "b": [comp[b] for _, b in out]}, dtype="int64")

    return leaves.groupBy("region", "i", "j").applyInPandas(leaf, "a long, b long")


def _named(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_shingles, k), and for every class (k, component_id, first): ``first`` is the class
    of the component's smallest (doc_id, k)."""
    rows, labels = links(docs, size)
    one = rows.filter("k is not null").groupBy("k").agg(F.min("doc_id").alias("low"))
    named = stage(one.join(labels, "k", "left").select("k", "low", "label"), "named")
    roots = stage(named.filter("label is not null").groupBy("label").agg(F.min(F.when(F.col("low").isNotNull(), F.struct("low", "k"))).alias("root")), "roots")
    ids = spread_join(named, roots, "label", "left").select("k", F.coalesce("root.low", "low").alias("component_id"), F.coalesce("root.k", "k").alias("first"))
    return rows, stage(ids, "ids")


def near_duplicates(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per document."""
    rows, ids = _named(docs, size)
    return spread_join(rows, ids, "k", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keyed(docs: DataFrame, size: int, name: str) -> DataFrame:
    """``docs`` and the class of each row as ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = [set_key(s) if len(s) else None for s in sets_of(batch.column(batch.schema.get_field_index("text")), size)]
            yield _batch([*batch.schema.names, name], [*batch.columns, pa.array(k, pa.int64())])

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField(name, LongType())]))


def representatives(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """One row of each component of near duplicates: that of the smallest doc_id, then the smallest class, then
    the first by its JSON. Rows are decided by themselves, so other texts of a repeated doc_id stay. Rows with
    null doc_id and rows without words stay. All columns stay, whatever their names."""
    rows, ids = _named(docs, size)
    goes = F.coalesce((F.col("doc_id") != F.col("component_id")) | (F.col("k") != F.col("first")), F.lit(False))
    marked = spread_join(stage(rows.filter("doc_id is not null"), "with_id"), ids, "k", "left").select("doc_id", "k", goes.alias("goes"))
    # an id of one row is decided by id; the rows of others by their class too
    an_id, gone, key, one = fresh(docs, "id", "gone", "key", "row")
    decided = stage(marked.groupBy("doc_id").agg(F.max("goes").alias("goes"), F.count("*").alias("n")).filter("goes or n > 1").select(F.col("doc_id").alias(an_id), F.col("n").alias(gone)), "decided")
    few = decided.count() <= ID_ROWS
    same = F.col("doc_id") == F.col(an_id)
    once = docs.join(F.broadcast(decided) if few else decided, same, "left_anti")
    many = decided.filter(F.col(gone) > 1).select(an_id)
    if many.isEmpty():
        return once
    many = F.broadcast(many) if few else many
    out = marked.filter("goes").join(many, same, "left_semi").select(F.col("doc_id").alias(an_id), F.col("k").alias(gone)).distinct()
    held = keyed(docs.join(many, same, "left_semi"), size, key)
    kept = held.join(out, same & (F.col(key) == F.col(gone)), "left_anti")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    single = kept.filter(F.col(key).isNotNull()).groupBy("doc_id", key).agg(F.min_by(row, F.to_json(row)).alias(one)).select(f"{one}.*")
    return once.unionByName(kept.filter(F.col(key).isNull()).drop(key)).unionByName(single)
