"""Content in parts: splitting, joining, completeness, totals and numbers of manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split(content: DataFrame, column: str, size: int) -> DataFrame:
    """A row per part: part (from 1), parts, begin, finish (exclusive) and chunk. Empty content is one empty part."""
    n = F.length(column)
    parts = F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("int")
    rows = content.withColumns({"parts": parts}).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    begin = (F.col("part") - 1) * size
    return rows.withColumns({"begin": begin, "finish": F.least(begin + size, n), "chunk": F.substring(F.col(column), begin + 1, F.lit(size))})


def join(parts: DataFrame, keys: Sequence[str], part: str = "part", chunk: str = "chunk", total: str = "parts") -> DataFrame:
    """Content by ``keys``, in part order, with whether every part is there. A part that comes twice counts once."""
    once = parts.dropDuplicates([*keys, part])
    rows = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(part, chunk))).alias("found"), F.max(total).alias("total"))
    return rows.select(*keys, F.array_join(F.transform("found", lambda x: x[chunk]), "").alias("content"), (F.size("found") == F.col("total")).alias("complete"))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """index from 1 and count beside each row."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({"index": F.row_number().over(w.orderBy(*order)), "count": F.count("*").over(w)})


def change_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    new = ~F.col(column).eqNullSafe(F.lag(column).over(w)) | (F.row_number().over(w) == 1)
    return rows.withColumn("run", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
