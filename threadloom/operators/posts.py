"""Posts and manifests: orders, validity, modes, states, assembly from articles, running figures."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.dates import DIRECTIVES
from threadloom.functions.text import filled, size_text, subject_parts, type_of_name

#: The order in which header keys are printed.
PRINTED = ("Subject", "From", "Date", "Message-ID", "Lines", "Size", "Newsgroups", "Content-Type", "Mime-Version", "Content-Transfer-Encoding", "X-Newsposter")
#: Response codes by class; a code can be in two.
CODES = {
    "success": (111, 200, 201, 203, 205, 211, 223, 235, 238, 239, 240, 250, 281, 290),
    "multiline": (100, 101, 211, 215, 218, 220, 221, 222, 224, 225, 230, 231, 282, 288),
    "pending": (335, 340, 350, 381),
    "denied": (400, 435, 437, 438, 440, 450, 480),
    "failed": (431, 436, 439, 441, 452, 482),
    "no_article": (420, 421, 422, 423, 430, 435, 498, 499),
    "no_group": (411, 412, 418, 481),
    "error": (500, 501, 502, 503, 504, 505, 506, 508),
}
IGNORE_ATTACHED, IGNORE_PARS = 1, 2


def response_classes(code: Column) -> Column:
    """Names of the classes of a response code, in order."""
    return F.filter(F.array(*(F.when(code.isin(*codes), F.lit(name)) for name, codes in CODES.items())), lambda x: x.isNotNull())


def succeeded(code: Column, multiline: bool | None = None) -> Column:
    """Any code from 200 to 399, or one of the class asked for."""
    return F.floor(code / 200) == 1 if multiline is None else code.isin(*CODES["multiline" if multiline else "success"])


def titled(template: str, index: Column, files: Column, at: Column, given: dict[str, Column] | None = None) -> Column:
    """A subject of a post's file by a template. ``files``: array<struct<name,size>> of the post, ``index`` the file's
    place from 1. Keys: the caller's, then count, index, totalsize, filename and filesize (of this file), filename001
    and filesize001 and so on (of the file there). Unknown keys go; then directives of a date stand for ``at``."""
    here = F.get(files, index - 1)
    total = F.aggregate(files, F.lit(0).cast("long"), lambda acc, f: acc + f["size"])
    values = dict(given or {}) | {k: v for k, v in (("count", F.size(files)), ("index", index), ("totalsize", size_text(total)), ("filename", here["name"]), ("filesize", size_text(here["size"]))) if k not in (given or {})}
    for key in set(re.findall(r"\{\{file(?:name|size)[0-9]{3}\}\}", template)):
        one = F.get(files, int(key[-5:-2]) - 1)
        values[key[2:-2]] = F.coalesce(one["name"] if "name" in key else size_text(one["size"]), F.lit(""))
    out = filled(F.lit(template), values)
    for directive in set(re.findall("%[A-Za-z]", template)) & set(DIRECTIVES):
        out = F.replace(out, F.lit(directive), F.date_format(at, DIRECTIVES[directive]))
    return out


def nuked(headers: Column) -> Column:
    """That a header says an article was taken away."""
    return F.exists(F.map_keys(headers), lambda k: k.rlike(r"(?i)^x-(?:dmca|removed|cancel(?:l?ed)?|blocked)"))


def wanted_by_mode(name: Column, attached: Column, mode: int) -> Column:
    """That a manifest's file is kept: by ``IGNORE_PARS`` recovery files go, by ``IGNORE_ATTACHED`` those already
    attached; files without a known type stay."""
    kind = type_of_name(name)
    unknown = kind.isNull() | (kind == "application/octet-stream")
    keep = F.lit(True)
    if mode & IGNORE_PARS:
        keep = keep & ~kind.endswith("par2")
    if mode & IGNORE_ATTACHED:
        keep = keep & ~attached
    return unknown | keep


def all_valid(parts: Column, valid: str = "valid") -> Column:
    """That there are parts and every one is valid."""
    return (F.size(parts) > 0) & F.forall(parts, lambda p: p[valid])


def is_ascii(text: Column) -> Column:
    """That a text holds only printing ASCII signs and blanks."""
    return ~text.rlike(r"[^\x09\x0A\x0D\x20-\x7E]")


def ascii_body(lines: Column) -> Column:
    """Lines as a body: blanks at the ends of lines go, each line ends with CR LF."""
    return F.concat(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+$", "")), "\r\n"), F.when(F.size(lines) > 0, F.lit("\r\n")).otherwise(F.lit("")))


def content_key(sort_no: Column, name: Column, part: Column) -> Column:
    """Key by which contents are ordered: number and part have five places, so text order is theirs."""
    return F.concat_ws("/", F.lpad(sort_no.cast("string"), 5, "0"), name, F.when(part.isNotNull(), F.lpad(part.cast("string"), 5, "0")).otherwise(F.lit("/")))


def post_order() -> list[Column]:
    """Posts without a number come first, then by number; then by name."""
    return [F.col("sort_no").asc_nulls_first(), F.col("filename").asc_nulls_first()]


def printed(headers: Column) -> Column:
    """Header lines in the order of print, other keys after them by name."""
    at = lambda k: F.coalesce(F.nullif(F.array_position(F.lit(list(PRINTED)), k), F.lit(0)), F.lit(len(PRINTED) + 1))
    rows = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(at(e["key"]).alias("at"), e["key"].alias("key"), e["value"].alias("value"))))
    return F.array_join(F.transform(rows, lambda r: F.concat(r["key"], F.lit(": "), r["value"])), "\r\n")


def placed(items: Column, at: Column) -> Column:
    """The item at a place from 0, from the end if negative; places beyond an end mean the item there."""
    n = F.size(items)
    return F.get(items, F.when(at >= 0, F.least(at, n - 1)).otherwise(F.greatest(n + at, F.lit(0))))


def bisect_left(keys: Column, x: Column) -> Column:
    """How many of sorted keys come before x."""
    return F.size(F.filter(keys, lambda k: k < x))


def last_by_type(names: DataFrame, post: str = "post", no: str = "no", name: str = "name") -> DataFrame:
    """(post, type, no, name): of each type the last name of a post."""
    rows = names.withColumn("type", type_of_name(F.col(name))).filter("type is not null")
    return rows.groupBy(post, "type").agg(F.max(F.struct(no, name)).alias("last")).select(post, "type", "last.*")


def manifests(articles: DataFrame) -> DataFrame:
    """Files assembled from articles (id, poster, posted, subject, size, group) whose subjects name their part: poster,
    fname, parts, segments in order, and whether all are there. A part that came twice counts by its smallest id."""
    rows = articles.withColumn("told", subject_parts(F.col("subject"))).filter("told is not null and told.part is not null").select("id", "poster", "posted", "size", "group", "told.fname", "told.part", "told.parts")
    once = rows.groupBy("poster", "fname", "part").agg(F.min(F.struct("id", "size")).alias("one"), F.max("parts").alias("parts"), F.min("posted").alias("posted"), F.collect_set("group").alias("groups"))
    whole = once.groupBy("poster", "fname").agg(
        F.max("parts").alias("parts"), F.min("posted").alias("posted"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("groups")))).alias("groups"),
        F.array_sort(F.collect_list(F.struct(F.col("part").alias("number"), F.col("one.size").alias("bytes"), F.col("one.id").alias("id")))).alias("segments"),
    )
    return whole.withColumn("complete", F.size("segments") == F.col("parts"))


def moved_on(states: DataFrame, events: DataFrame, key: str = "id") -> DataFrame:
    """States (id, staged, posted, verified: times or null) after events (id, kind, at). A state is reached once, at its
    first event, and only after the one before it; what came before is never taken back, so replays change nothing."""
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("at")))
    told = events.groupBy(key).agg(*(first(k).alias(f"new_{k}") for k in ("staged", "posted", "verified")))
    both = states.join(told, key, "full_outer")
    staged = F.coalesce("staged", "new_staged")
    posted = F.coalesce(F.col("posted"), F.when(staged.isNotNull(), F.col("new_posted")))
    verified = F.coalesce(F.col("verified"), F.when(posted.isNotNull(), F.col("new_verified")))
    return both.select(key, staged.alias("staged"), posted.alias("posted"), verified.alias("verified"))


def pending(states: DataFrame) -> DataFrame:
    """States with what is to be done next: post, verify, or nothing (null)."""
    return states.withColumn("todo", F.when(F.col("posted").isNull(), "post").when(F.col("verified").isNull(), "verify"))


def intact(content: Column, sha1: Column) -> Column:
    """That a stored sum is the content's."""
    return F.coalesce(F.sha1(content) == F.lower(sha1), F.lit(False))


def running_total(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, part: Column, into: str = "total") -> DataFrame:
    """``rows`` with the running sum of ``value`` by key. ``part`` rises with the order (a day of the time, thousands of
    a number) and cuts a key's rows, so that a key of many rows is spread over tasks; a sum per part goes before."""
    cut = rows.withColumn("part_of_order", part).withColumn("running_value", value)
    within = Window.partitionBy(*keys, "part_of_order").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*(f"of_{k}" for k in keys)).orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*(F.col(k).alias(f"of_{k}") for k in keys), F.col("part_of_order").alias("of_part")).agg(F.sum("running_value").alias("base"))
    bases = totals.withColumn("base", F.coalesce(F.sum("base").over(before), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    joined = cut.withColumn("inside", F.sum("running_value").over(within)).join(bases, [*same, F.col("part_of_order").eqNullSafe(F.col("of_part"))])
    return joined.withColumn(into, F.col("inside") + F.col("base")).select(*rows.columns, into)
