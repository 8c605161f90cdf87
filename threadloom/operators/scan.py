"""The article index: ranges, date bounds, positions, and lines decoded into scored articles."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.dates import within
from threadloom.operators import rules
from threadloom.operators.catalog import latest
from threadloom.sources.readers import article_lines

#: Orders of an index scan.
ORDERS = {"number": ("article_no",), "time": ("posted", "article_no"), "poster": ("poster", "posted", "article_no")}


def xover(articles: DataFrame, start: int | None = None, end: int | None = None, since: dt.datetime | None = None, until: dt.datetime | None = None, group: str | None = None, order: str | None = None) -> DataFrame:
    """Articles of a range of numbers or times, in a group or in all. Bounds that are not given are open. A range
    that ends before it starts, or leaves the numbers that the group has, gives no rows."""
    if start is not None and end is not None and start > end:
        return articles.limit(0)
    held = articles.filter(F.col("group") == group) if group is not None else articles
    cond = within(F.col("posted"), since, until) if since or until else F.lit(True)
    if start is not None or end is not None:
        marks = held.agg(F.min("article_no").alias("head"), F.max("article_no").alias("tail"))
        good = (F.lit(start) >= F.col("head") if start is not None else F.lit(True)) & (F.lit(end) <= F.col("tail") if end is not None else F.lit(True))
        ok = marks.filter(good).select(F.lit(True).alias("in_range"))
        cond = cond & F.col("article_no").between(start if start is not None else -(1 << 62), end if end is not None else 1 << 62)
        held = held.filter(cond).join(F.broadcast(ok)).drop("in_range")  # one row or none
    else:
        held = held.filter(cond)
    return held.orderBy(*ORDERS[order]) if order else held


def seek(articles: DataFrame, at: dt.datetime) -> DataFrame:
    """(first_no, before): the first number with a time from ``at`` on, else the first of all, and how many come
    before. Two aggregates, each with its filter at the scan."""
    time = F.col("posted")
    later = articles.filter(time >= F.lit(at)).agg(F.min("article_no").alias("first_no"))
    earlier = articles.filter(time < F.lit(at)).agg(F.count("*").alias("before"), F.min("article_no").alias("head"))
    return later.join(earlier).select(F.coalesce("first_no", "head").alias("first_no"), "before")  # one row each


def page(articles: DataFrame, cursor: int, count: int) -> DataFrame:
    """``count`` articles from the cursor on, or those before it where ``count`` is negative, in order."""
    if count >= 0:
        return articles.filter(F.col("article_no") >= cursor).orderBy("article_no").limit(count)
    return articles.filter(F.col("article_no") < cursor).orderBy(F.desc("article_no")).limit(-count).orderBy("article_no")


def decoded(lines: DataFrame, group: str, scores: Sequence[rules.Rule] = (), white: Sequence[rules.Rule] = (), black: Sequence[rules.Rule] = (), by: str = "number") -> DataFrame:
    """Index lines as articles of a group: parsed, scored, listed by rules, with a sort key of fixed width; of lines
    with one key the last by id stays."""
    pad = lambda c: F.lpad(c.cast("string"), 10, "0")
    keys = {"number": (pad(F.col("article_no")),), "time": (F.date_format("posted", "yyyyMMddHHmmss"), pad(F.col("article_no"))), "poster": (F.col("poster"), F.date_format("posted", "yyyyMMddHHmmss"), pad(F.col("article_no")))}
    rows = article_lines(lines).withColumn("group", F.lit(group))
    kept = rules.apply(rows, scores, white, black).withColumn("sort_key", F.concat_ws(":", *keys[by])).withColumn("xgroups", F.to_json("xgroups"))
    return latest(kept, ["sort_key"], "id").withColumn("xgroups", F.from_json("xgroups", "map<string,bigint>"))
