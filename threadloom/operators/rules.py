"""Rules on articles: score, black and white lists, compiled to columns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def starts_matching(column: Column, pattern: str, any_case: bool = True) -> Column:
    """The pattern holds from the start of the text."""
    return column.rlike(f"(?{'i' if any_case else ''}d)^(?:{pattern})")


#: What each directive tests, by name: (column, value) -> condition.
TESTS = {
    "subject_regex": lambda v: starts_matching(F.col("subject"), v), "subject_starts": lambda v: F.col("subject").startswith(v), "subject_ends": lambda v: F.col("subject").endswith(v),
    "poster_regex": lambda v: starts_matching(F.col("poster"), v), "poster_starts": lambda v: F.col("poster").startswith(v), "poster_ends": lambda v: F.col("poster").endswith(v),
    "score_is": lambda v: F.col("score") == v, "score_above": lambda v: F.col("score") > v, "score_below": lambda v: F.col("score") < v, "lines_above": lambda v: F.col("lines") > v, "lines_below": lambda v: F.col("lines") < v,
    "size_above": lambda v: F.col("size") > v, "size_below": lambda v: F.col("size") < v, "after": lambda v: F.col("posted") > F.lit(v), "before": lambda v: F.col("posted") < F.lit(v),
    "crossposts_above": lambda v: F.cardinality("xgroups") > v, "crossposts_below": lambda v: F.cardinality("xgroups") < v,
}


@dataclass(frozen=True)
class Rule:
    group: str
    tests: dict[str, object] = field(default_factory=dict)
    score: int = 0

    def __post_init__(self):
        if not self.group or not self.tests or set(self.tests) - set(TESTS):
            raise ValueError(f"a rule needs a group pattern and known tests: {self}")
        for k in ("group", *(k for k in self.tests if k.endswith("regex"))):
            re.compile(self.group if k == "group" else str(self.tests[k]))

    def holds(self) -> Column:
        return reduce(and_, (TESTS[k](v) for k, v in self.tests.items()), starts_matching(F.col("group"), self.group, any_case=False))


def score_of(rules: Sequence[Rule]) -> Column:
    parts = [F.when(r.holds(), F.lit(r.score)).otherwise(F.lit(0)) for r in rules if r.score]
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def any_of(rules: Sequence[Rule]) -> Column:
    return reduce(or_, (r.holds() for r in rules), F.lit(False))


def apply(articles: DataFrame, scores: Sequence[Rule] = (), white: Sequence[Rule] = (), black: Sequence[Rule] = ()) -> DataFrame:
    """Adds score, then drops what is black and not white. The lists see the score."""
    scored = articles.withColumn("score", score_of(scores))
    return scored.filter(F.coalesce(any_of(white) | ~any_of(black), F.lit(True)))


#: Endings of names that are dangerous, and endings that score in groups of binaries.
DANGEROUS = "exe|scf|scr|vb|vbe|vbs|pif|application|gadget|msc|msh|msi|msp|hta|jar|bat|cmd|com|cpl|js|jse|ws|wsf|wsc|wsh|lnk|inf|reg|ps[12](?:xml)?|psc[12](?:xml)?|msh[12](?:xml)?|ms"
SCORED = (
    (r"(?:avi|mp4|mpeg|mpg|mkv|mov|asf|ogg|iso|rm)(?:\.[0-9]{3})?", 25),
    (r"jpe?g|png|bmp|gif", 15),
    (r"(?:rar|r[0-9]{2}|7z|zip|z[0-9]{2}|tgz|tar\.gz)(?:\.[0-9]{3})?", 25),
    (r"par2?", 10),
)
#: Presets: an ending counts before a blank or a quote.
PRESET_BLACK = (Rule(".*", {"subject_regex": rf""".*\.(?:{DANGEROUS})[\s"'].*"""}),)
PRESET_SCORES = tuple(Rule(r"alt\.bin.*", {"subject_regex": rf""".*\.(?:{names})[\s"'].*"""}, n) for names, n in SCORED)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Rule file lines ``CODE[op][score] group [value]`` (column value) as rows; others are dropped."""
    pattern = r"^\s*([BWS])([SP])?([=<>])?([+-]?[0-9]+)?\s+(\S+)(?:\s+(.*?))?\s*$"
    part = lambda i: F.nullif(F.regexp_extract("value", pattern, i), F.lit(""))
    rows = lines.filter(~F.col("value").rlike(r"^\s*(#|$)") & F.col("value").rlike(pattern))
    return rows.select(part(1).alias("list"), part(2).alias("field"), part(3).alias("op"), part(4).try_cast("int").alias("score"), part(5).alias("group_regex"), part(6).alias("regex"))


def compiled(rows: Sequence[Row]) -> tuple[list[Rule], list[Rule], list[Rule]]:
    """Rows of a rule file (a few, on the driver) as (score, white, black) rules. The value is a pattern of the
    subject (S, or no field) or the poster (P). In white and black lists the operator compares the score; a score
    rule needs a score and no ``<`` or ``>``. Rows that say nothing or not enough are refused."""
    lists: dict[str, list[Rule]] = {"S": [], "W": [], "B": []}
    bounds = {"<": "score_below", ">": "score_above", "=": "score_is", None: "score_is"}
    for r in rows:
        tests: dict[str, object] = {} if r["regex"] is None else {"poster_regex" if r["field"] == "P" else "subject_regex": r["regex"]}
        if r["list"] == "S" and (r["score"] is None or r["op"] in ("<", ">")):
            raise ValueError(f"a score rule needs a score and takes no comparison: {r}")
        if r["list"] != "S" and r["score"] is not None:
            tests[bounds[r["op"]]] = r["score"]
        lists[r["list"]].append(Rule(r["group_regex"], tests, r["score"] or 0))
    return lists["S"], lists["W"], lists["B"]


#: Groups with their rules are broadcast up to so many pairs of a group and a rule; beyond it a group's articles are dealt
#: to so many tasks.
FIT_ROWS, DEALT = 100_000, 64


def by_table(articles: DataFrame, rules: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """Score by a rule table (group_regex, regex, score), for hundreds of rules: rules go by the groups they
    fit first, a join of two small tables, then to articles by equality on the group. Up to ``most`` pairs of
    a group and a rule articles are not moved; beyond it they are dealt by group and subject, so those of a frequent
    group don't meet in one task unless they have one subject."""
    groups = articles.select("group").distinct()
    fits = groups.join(rules, F.expr("group rlike concat('^(?:', group_regex, ')')"))
    by_group = fits.groupBy("group").agg(F.collect_list(F.struct("regex", "score")).alias("rules"))
    total = F.aggregate(F.coalesce("rules", F.array().cast("array<struct<regex:string,score:int>>")), F.lit(0), lambda acc, r: acc + F.when(F.rlike("subject", F.concat(F.lit("(?id)^(?:"), r["regex"], F.lit(")"))), r["score"]).otherwise(0))
    if fits.limit(most + 1).count() <= most:
        found = articles.join(F.broadcast(by_group), "group", "left")
    else:
        copies = by_group.withColumn("dealt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))))
        found = articles.withColumn("dealt", F.pmod(F.xxhash64("subject"), F.lit(DEALT))).join(copies.hint("merge"), ["group", "dealt"], "left").drop("dealt")
    return found.withColumn("score", total).drop("rules")
