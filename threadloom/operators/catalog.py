"""Groups, aliases, servers and tracks as tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve(asked: DataFrame, groups: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names to groups: by exact name, else by alias, else by lower-cased name. ``asked``: (name)."""
    g = groups.select(F.col("name").alias("exact"), F.col("group_id").alias("by_name"))
    a = aliases.select(F.col("name").alias("alias"), F.col("group_id").alias("by_alias"))
    low = groups.select(F.lower("name").alias("low"), F.col("group_id").alias("by_low"))
    out = asked.join(g, F.col("name") == F.col("exact"), "left").join(a, F.col("name") == F.col("alias"), "left").join(low, F.lower("name") == F.col("low"), "left")
    return out.select("name", F.coalesce("by_name", "by_alias", "by_low").alias("group_id")).filter("group_id is not null").distinct()


def named_like(filters: Sequence[str | tuple[str, str]], column: str = "group") -> Column:
    """Group names that one of ``filters`` fits: a plain text occurs in any case, ``("regex", p)`` is found by p. No
    filters let all pass."""
    tests = [F.lower(column).contains(f.lower()) if isinstance(f, str) else F.col(column).rlike(f[1]) for f in filters]
    return reduce(or_, tests) if tests else F.lit(True)


def latest(rows: DataFrame, keys: Sequence[str], newest: str) -> DataFrame:
    """The newest row of each key; of equal ones the largest by all columns, so reruns agree."""
    whole = F.struct(F.col(f"`{newest}`").alias("newest"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"))
    out = rows.groupBy(*(F.col(f"`{k}`").alias(f"key{i}") for i, k in enumerate(keys))).agg(F.max(whole).alias("best"))
    return out.select("best.row.*")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], newest: str) -> DataFrame:
    """Rows by key, the newest version of each: one shuffle on the key with partial results before it. Columns must
    be of kinds that have an order; maps have none, so tables with maps go through ``upsert_any``."""
    return latest(old.unionByName(new), keys, newest)


def upsert_any(old: DataFrame, new: DataFrame, keys: Sequence[str], newest: str) -> DataFrame:
    """As ``upsert``, for columns of any kind; of equally new rows the one with the largest hash stays."""
    both = old.unionByName(new)
    name = "rank"
    while name.lower() in {c.lower() for c in both.columns}:
        name = f"_{name}"
    order = Window.partitionBy(*keys).orderBy(F.col(newest).desc(), F.hash(*(F.to_json(F.struct(F.col(f"`{c}`"))) for c in both.columns)).desc())
    return both.withColumn(name, F.row_number().over(order)).filter(F.col(name) == 1).drop(name)


def changed(old: DataFrame, listing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A catalogue after a server's listing: listed keys take its columns, new ones are added, others stay; columns
    that the listing does not have (watch marks, ids) are kept."""
    told = listing.select(*(F.col(f"`{c}`").alias(f"new_{c}") for c in listing.columns))
    both = old.join(told, [F.col(k) == F.col(f"new_{k}") for k in keys], "full_outer")
    fresh = [c for c in listing.columns if c in old.columns]
    return both.select(*(F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in fresh else F.col(c) for c in old.columns))


def settled(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """Settings (group, key, value) after changes of the same columns; a null value takes the setting away."""
    kept = pairs.join(changes.select("group", "key"), ["group", "key"], "left_anti")
    return kept.unionByName(changes.filter(F.col("value").isNotNull()))


def setting(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(group, key, value) of asked (group, key, default): the default where nothing is set."""
    return asked.join(pairs, ["group", "key"], "left").select("group", "key", F.coalesce("value", "default").alias("value"))


def children_replaced(children: DataFrame, new: DataFrame, parent: str, saved: DataFrame) -> DataFrame:
    """Children after their parents in ``saved`` (parent) were saved anew with the children in ``new``."""
    return children.join(saved.select(parent).distinct(), parent, "left_anti").unionByName(new.join(saved.select(parent).distinct(), parent, "left_semi"))


def first_by_priority(answers: DataFrame, keys: Sequence[str], priority: str, value: str) -> DataFrame:
    """The answer of the first server by priority that has one; of servers with one priority the smallest answer."""
    return answers.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(F.struct(F.col(priority), F.col(value).alias("answer"))).alias("best")).select(*keys, F.col("best.answer").alias(value))


def stated(asked: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """(key, state) of asked ids from answers (id, priority, found): ``here`` if any server has it, ``missing`` if
    all that answered have not, ``unknown`` if none answered (found null or no row)."""
    seen = answers.groupBy(key).agg(F.bool_or("found").alias("some"))
    return asked.join(seen, key, "left").select(key, F.when(F.col("some"), "here").when(~F.col("some"), "missing").otherwise("unknown").alias("state"))


def fetched(wanted: DataFrame, stored: DataFrame, max_bytes: int = 0) -> DataFrame:
    """(file, number, id, server, content) of a manifest's segments: each from the first server by priority that has
    it, cut to ``max_bytes`` if positive; null content where no server has it. ``stored``: (id, server, priority,
    content). Contents do not pass the choice of the server."""
    best = stored.filter(F.col("content").isNotNull()).groupBy("id").agg(F.min(F.struct("priority", "server")).alias("best")).select("id", F.col("best.server").alias("server"))
    content = F.substring("content", 1, max_bytes) if max_bytes > 0 else F.col("content")
    return wanted.join(best, "id", "left").join(stored.select("id", "server", content.alias("content")), ["id", "server"], "left").select("file", "number", "id", "server", "content")


def watermarks(articles: DataFrame, group: str | Sequence[str] = "group", number: str = "article_no") -> DataFrame:
    by = [group] if isinstance(group, str) else list(group)
    return articles.groupBy(*by).agg(F.min(number).alias("low"), F.max(number).alias("high"), F.count("*").alias("count"))


def missing(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.join(present.select(*keys), list(keys), "left_anti")


def outside(paths: DataFrame, folders: Sequence[str], column: str = "path") -> DataFrame:
    """Paths that lie under none of the folders."""
    cond = F.lit(True)
    for f in folders:
        cond = cond & ~(F.col(column).startswith(f.rstrip("/") + "/") | (F.col(column) == f.rstrip("/")))
    return paths.filter(cond)
