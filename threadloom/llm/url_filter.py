"""URL filter: rules by host and path, and host reputation by empirical Bayes.

Everything is DataFrame functions. Outcomes of labelled pages are counted per host, then rolled up to
registered domain and suffix. Each level's beta prior has the mean of its parent's posterior and a
strength fitted by moments over the parent's children. A host is blocked where the lower bound of its
bad rate, ``mean - z * sd``, reaches the threshold.

For reputation a host is taken without user, port and a last dot. Its suffix is its last label, or the last two where
a country's two letters follow one of ``SECOND`` (``co.uk``); the registered domain has one label more. An address in
numbers is its own domain, with suffix ``ip``. Rules look at the host as it stands.

Defined results: null or malformed urls give an empty host and path. A host without outcomes takes the posterior of its
domain, else of its suffix, else of all hosts; with no outcomes at all the mean is 0.5 with strength 2,
which allows. Repeated rows each count and each get a verdict. Of rules of equal length that fit the first by text is
taken. Empty pages give an empty result, empty outcomes leave all to rules. Very long urls are worked in place. Extra
columns pass through, whatever their names; only columns named host, path, rule or verdict are replaced by the
results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import fresh, spread_join, stage

#: (verdict, host, path): the rules of the query.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
THRESHOLD, Z = 0.5, 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + F.lit(3))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def matching_rule(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does. One CASE, longest first."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in reversed(ordered):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


#: Labels that make a suffix with a country's.
SECOND = "ac|co|com|edu|go|gob|gov|gv|mil|ne|net|nom|or|org"
IP = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$"
SUFFIX = rf"((?:(?:^|\.)(?:{SECOND})\.[a-z][a-z]|(?:^|\.)[^.]*))$"
DOMAIN = rf"([^.]*\.(?:{SECOND})\.[a-z][a-z]|(?:[^.]*\.)?[^.]*)$"


def site_of(host: Column) -> Column:
    """A host without user, port and last dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":[0-9]*$", ""), r"\.$", "")


def domain_of(site: Column) -> Column:
    return F.when(site.rlike(IP), site).otherwise(F.regexp_extract(site, DOMAIN, 1))


def suffix_of(site: Column) -> Column:
    return F.when(site.rlike(IP), F.lit("ip")).otherwise(F.ltrim(F.regexp_extract(site, SUFFIX, 1), F.lit(".")))


def _prior(children: DataFrame, parent: str) -> DataFrame:
    """Counts of each parent and the strength of its children's prior, from the moments of their rates."""
    sums = children.groupBy(parent).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("kids"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("kk"),
    )
    m = F.col("bad") / F.col("n")
    within = m * (1 - m)
    between = F.col("kk") - F.col("bad") * m - (F.col("kids") - 1) * within
    room = (F.col("n") - F.col("nn") / F.col("n") - (F.col("kids") - 1)) * within
    rho = F.when(room > 0, between / room).otherwise(F.lit(0.0))
    strength = F.when(rho <= 0.005, F.lit(200.0)).when(rho >= 0.5, F.lit(1.0)).otherwise((1 - rho) / rho)
    return sums.select(parent, "n", "bad", strength.alias("strength"))


def reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posterior (a, b) by host, domain, suffix and for all, from rows (host, bad 0 or 1).

    One shuffle of partial counts; all else works on written tables of a row per host, domain or suffix.
    """
    site = site_of(F.col("host"))
    counted = outcomes.select(site.alias("host"), "bad").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = stage(counted.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host")), "root": F.lit(0)}), "hosts")
    domains = stage(_prior(hosts, "domain").withColumns({"suffix": suffix_of(F.col("domain")), "root": F.lit(0)}), "domains")
    suffixes = stage(_prior(domains.drop("strength"), "suffix").withColumn("root", F.lit(0)), "suffixes")
    by_root = _prior(suffixes.drop("strength"), "root")

    root = by_root.select("root", (F.col("bad") + 1.0).alias("a"), (F.col("n") - F.col("bad") + 1.0).alias("b"), "strength")

    def below(children: DataFrame, parents: DataFrame, key: str, own: str) -> DataFrame:
        up = parents.select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias("m"), F.col("strength").alias("s"))
        strength = ["strength"] if "strength" in children.columns else []
        return children.join(up, key).select(own, (F.col("bad") + F.col("s") * F.col("m")).alias("a"), (F.col("n") - F.col("bad") + F.col("s") * (1 - F.col("m"))).alias("b"), *strength)

    suffix = below(suffixes, root, "root", "suffix")
    domain = below(domains, suffix, "suffix", "domain")
    host = below(hosts, domain, "domain", "host")
    return host, domain, suffix, root


def lower_bound(a: Column, b: Column, z: float) -> Column:
    mean = a / (a + b)
    return mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """``pages`` (with host and path) plus rule and verdict. ``outcomes``: (host, bad)."""
    host, domain, suffix, root = reputation(outcomes)
    rule, verdict = matching_rule(rules)
    named_site, by_site = fresh(pages, "site", "by_site")
    rows = stage(pages.withColumn(named_site, site_of(F.col("host"))), "pages")
    seen = rows.select(F.col(named_site).alias("host")).distinct().select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), F.lit(0).alias("root"))

    def named(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.struct("a", "b").alias(f"of_{key}"))

    for df, key in ((host, "host"), (domain, "domain"), (suffix, "suffix"), (root, "root")):
        seen = seen.join(named(df, key), key, "left")
    post = F.coalesce("of_host", "of_domain", "of_suffix", "of_root", F.struct(F.lit(1.0).alias("a"), F.lit(1.0).alias("b")))
    judged = stage(seen.select(F.col("host").alias(named_site), F.when(lower_bound(post["a"], post["b"], z) >= threshold, "block").otherwise("allow").alias(by_site)), "judged")
    return spread_join(rows, judged, named_site, "left").withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.col(by_site))}).drop(named_site, by_site)
