"""Shared helpers: table reading, tables staged in the shared folder, match spans as columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text: a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
SCAN_BLOCK = 64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local
    session gets a temporary folder (tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_staged: list[str] = []


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` as Parquet under the shared folder and reads it again: lineage ends there, and a lost
    executor costs only the tasks that ran on it. ``discard_staged`` takes such tables away."""
    path = f"{shared_dir(df.sparkSession)}/threadloom-{uuid.uuid4().hex}/{name}"
    _staged.append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard_staged(spark: SparkSession) -> None:
    """Deletes every table that this process staged. To be called when the results that read them are written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while _staged:
        path = hadoop.Path(_staged.pop().rsplit("/", 1)[0])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A table of numbers is broadcast up to so many rows; beyond it joins are shuffled.
BROADCAST_ROWS = 200_000


def even_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", most: int = 100_000) -> DataFrame:
    """``big`` joined with ``small``, whose ``key`` is unique, without all rows of a frequent key in one task: keys
    that hold more than a share 1 / ``most`` of the rows are at most ``most``, so their part of ``small`` is
    broadcast; the others are shuffled. ``big`` is read more than once and should be a written table; ``how`` is
    inner or left."""
    total = big.count()
    least = max(500, total // most)
    if total <= least:
        return big.join(small, key, how)
    hot = stage(big.groupBy(key).count().filter(F.col("count") > least).select(key), "frequent")
    if hot.isEmpty():
        return big.join(small, key, how)
    few = small.join(F.broadcast(hot), key, "left_semi")
    often = big.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, how)
    return often.unionByName(big.join(F.broadcast(hot), key, "left_anti").join(small, key, how))


def spread_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``big`` joined with a table of a few numbers by a unique key: broadcast if its size allows, else ``even_join``.
    Both should be written tables."""
    return big.join(F.broadcast(small), key, how) if small.count() <= BROADCAST_ROWS else even_join(big, small, key, how)


def slices(batch: pa.RecordBatch, column: int, most: int, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, in order, of at most ``rows`` rows and about ``most`` bytes in a column of texts; a
    longer text is a part alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        end = min(max(at + 1, int(np.searchsorted(ends, before + most, "right"))), at + rows)
        yield batch.slice(at, end - at)
        at = end


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with the pool's unused memory given back after each batch and at the end of a task. Python
    workers live on for later tasks and stages, and what their pools keep counts as the executor's memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pa.default_memory_pool().release_unused()
                yield batch

        try:
            yield from run(each())
        finally:
            pa.default_memory_pool().release_unused()

    return wrapped


def release(staged: DataFrame) -> None:
    """Frees the space of a staged table that nothing reads any more, by writing an empty one in its place."""
    path = staged.inputFiles()[0].rsplit("/", 1)[0] if staged.inputFiles() else None
    if path:
        spark = staged.sparkSession
        spark.createDataFrame([], staged.schema).write.mode("overwrite").parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, in any case, made from ``names`` by leading underscores."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` puts it inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running ``op`` (associative) over an array. Values are folded in blocks of ``SCAN_BLOCK`` and the
    blocks' totals after them, so time grows with the length and not with its square."""

    def fold(xs: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(xs, F.array(zero), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), value(x)))))

    def whole(xs: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor(F.size(xs) / F.lit(SCAN_BLOCK)).cast("int"))
        blocks = F.transform(at, lambda b: fold(F.slice(xs, b * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK)), lambda x: x))
        add = lambda b, base: F.transform(F.slice(b, F.lit(2), F.size(b) - 1), lambda x: op(base, x))
        return bound(blocks, lambda bs: F.flatten(F.zip_with(bs, F.slice(fold(bs, lambda b: F.element_at(b, -1)), F.lit(1), F.size(bs)), add)))

    return bound(values, whole)


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of ``pattern``, as array<struct<start,end,hit>> in code points.

    The pieces between matches come from ``split``; running sums of piece and match lengths give the offsets.
    The pattern must not match empty text.
    """
    size = lambda g, h: F.char_length(g).cast("long") + F.char_length(h)
    span = lambda h, e: F.struct((e - F.char_length(h)).alias("start"), e.alias("end"), h.alias("hit"))
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bound(hits, lambda hs: F.zip_with(hs, running(F.zip_with(F.slice(gaps, F.lit(1), F.size(hs)), hs, size), F.lit(0).cast("long"), lambda a, b: a + b), span))


#: Code points of a piece of text that cuts are counted in.
PIECE = 1024


def pieces_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Text of [start, end) from ``pieces_of`` it, each of ``PIECE`` code points; only those that it touches are read."""
    i, j = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    first = F.substr(F.get(pieces, i), (start % PIECE + 1).cast("int"), F.least(end - start, F.lit(PIECE)).cast("int"))
    last = F.substr(F.get(pieces, j), F.lit(1), (end - j * PIECE).cast("int"))
    return F.when(end <= start, F.lit("")).when(i == j, first).otherwise(F.concat(first, F.array_join(F.slice(pieces, i + 2, j - i - 1), ""), last))


FAR = 1 << 60


def _folded(items: Column, value: Callable[[Column], dict[str, Column]], zero: int, op: Callable[..., Column]) -> Column:
    """Running ``op`` over the numbers of ``value(item)``, by name; a scan for each, as numbers are cheap to copy."""
    start = F.lit(zero).cast("long")

    def one(name: str) -> Column:
        return running(F.transform(items, lambda x: value(x)[name].cast("long")), start, op).alias(name)

    return F.arrays_zip(*map(one, value(F.element_at(items, 1))))


def with_sides(items: Column, before: Callable[[Column], dict[str, Column]], after: Callable[[Column], dict[str, Column]]) -> Column:
    """array<struct<x,pre,suf>> of items: beside each, the largest numbers of ``before`` up to it and the smallest of
    ``after`` from it on, by name."""
    return bound(items, lambda xs: F.arrays_zip(xs.alias("x"), _folded(xs, before, 0, F.greatest).alias("pre"), F.reverse(_folded(F.reverse(xs), after, FAR, F.least)).alias("suf")))


def nearest(items: Column, flags: Callable[[Column], dict[str, Column]]) -> Column:
    """``with_sides`` for classes of spans: the largest end and the smallest start of each class (conditions by name)."""
    ends = lambda x: {n: F.when(c, x["end"]).otherwise(F.lit(0)) for n, c in flags(x).items()}
    starts = lambda x: {n: F.when(c, x["start"]).otherwise(F.lit(FAR)) for n, c in flags(x).items()}
    return with_sides(items, ends, starts)


def no_spans() -> Column:
    return F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")


def labelled(found: Column, kind: str, order: int) -> Column:
    """Spans with the name and rank of their kind: array<struct<start,rank,end,kind>>."""
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
