"""Secret scan with multipart credential linking, all in DataFrame functions and without a shuffle.

Strong kinds (assign, access, hex) are found by pattern alone. Weak parts are identifiers, secret-like values and
endpoints. Scopes are intervals of the text: its blocks, parted by blank lines or by the border of two objects in
braces. A weak part is reported only where a complementary part (a secret for identifiers and endpoints; an
access key, identifier or endpoint for secrets) lies in the same scope with at most ``REACH`` code points between
the two. The interval join runs over the parts of a text in order: the nearest complement and the nearest border
on either side are running maxima and minima, so a link depends on distances alone and the time grows with the
number of parts.

Defined results: null text counts as empty; a text without parts has no spans; repeated rows give repeated
results and equal texts equal ones; doc_id may be null; an empty table gives an empty one; spans that start
together are ordered by kind; very long texts and texts of many matches take time in proportion. Work columns get
names that the input does not have, so extra columns of any name pass through; only ``into`` itself is replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import bound, cut, fresh, joined, labelled, nearest, no_spans, pieces_of, running, spans

#: Fixed patterns of the strong kinds. For the last two the least length is asked in the pattern: their matches are
#: whole runs, so those that are long enough stay the same. A short assigned value still uses up its text.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts.
IDENT = r"""(?i)(?:user(?:_?name)?|login|client_?id|account|access_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.=-]{3,}"""
ENDPOINT = r"""(?i)(?:(?:jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\s"'<>{}]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,})"""
WEAK = r"""(?i)(?:pwd|passphrase|credential|bearer|private_?key|signature|auth)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""
#: A value of 40 signs with letters of both cases and a digit.
MIXED = r"(?<![A-Za-z0-9+/=])(?=[A-Z0-9+/]{0,39}[a-z])(?=[a-z0-9+/]{0,39}[A-Z])(?=[A-Za-z+/]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
BORDER = r"\n[\x20\t\r]*\n|\}[\s,]*\{"
REACH = 160
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint", "mixed")
STRONG, SECRET, BREAK = 3, (0, 2, 4, 6), len(KINDS)
#: Literal parts, one of which every match of a pattern holds in lower case.
HINTS = {
    ASSIGN: ("passw", "secret", "token", "apikey", "api_key"), IDENT: ("user", "login", "clientid", "client_id", "account", "accessid", "access_id", "keyid", "key_id"),
    ENDPOINT: ("://", "host", "endpoint", "server"), WEAK: ("pwd", "passphrase", "credential", "bearer", "privatekey", "private_key", "signature", "auth"),
}


def _linked(items: Column) -> Column:
    """Of items (parts and borders) sorted by start: the strong ones, and the weak ones that overlap none of them
    and have a complement in reach."""
    strong = lambda x: x["rank"] < STRONG
    free = F.filter(nearest(items, lambda x: {"s": strong(x)}), lambda r: (r["x"]["rank"] < STRONG) | ((r["pre"]["s"] <= r["x"]["start"]) & (r["suf"]["s"] >= r["x"]["end"])))
    sides = nearest(F.transform(free, lambda r: r["x"]), lambda x: {"secret": x["rank"].isin(*SECRET), "other": ~x["rank"].isin(*SECRET) & (x["rank"] < BREAK), "cut": x["rank"] == BREAK})

    def near(r: Column, kind: str) -> Column:
        left = (r["pre"][kind] > r["pre"]["cut"]) & (r["pre"][kind] >= r["x"]["start"] - REACH)
        return left | ((r["suf"][kind] < r["suf"]["cut"]) & (r["suf"][kind] <= r["x"]["end"] + REACH))

    keep = lambda r: strong(r["x"]) | ((r["x"]["rank"] < BREAK) & F.when(r["x"]["rank"].isin(*SECRET), near(r, "other")).otherwise(near(r, "secret")))
    return F.transform(F.filter(sides, keep), lambda r: r["x"])


def scan(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` plus ``into``: array<struct<start,rank,end,kind>> by start, then kind."""
    low, strong, others, weak = fresh(docs, "low", "strong", "others", "weak")
    t = F.coalesce(F.col(text), F.lit(""))

    def of(pattern: str) -> Column:
        hint = reduce(or_, (F.col(low).contains(h) for h in HINTS[pattern]))
        return F.when(hint, spans(t, pattern)).otherwise(no_spans())

    def named(found: Column, kind: str) -> Column:
        return labelled(found, kind, KINDS.index(kind))

    access = F.when(t.contains("AKIA"), spans(t, ACCESS)).otherwise(no_spans())
    hexes = F.when(t.rlike(HEX), spans(t, HEX)).otherwise(no_spans())
    assign = F.filter(of(ASSIGN), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 6)
    found = docs.withColumn(low, F.lower(t)).withColumns({strong: F.concat(named(assign, "assign"), named(access, "access"), named(hexes, "hex")), others: F.concat(named(of(IDENT), "ident"), named(of(ENDPOINT), "endpoint"))})
    # a value is a weak secret only beside other parts, so it is looked for only there
    asked = (F.size(others) > 0) | F.exists(strong, lambda x: x["kind"] == "access")
    found = found.withColumn(weak, F.when(asked, F.concat(named(of(WEAK), "weak"), named(spans(t, MIXED), "mixed"))).otherwise(named(no_spans(), "weak")))
    parts = F.concat(strong, others, weak)
    borders = labelled(spans(t, BORDER), "border", BREAK)
    every = F.when(F.size(others) + F.size(weak) > 0, _linked(F.array_sort(F.concat(parts, borders)))).otherwise(F.array_sort(F.col(strong)))
    return found.withColumn(into, every).drop(low, strong, others, weak)


def digest(scanned: DataFrame) -> DataFrame:
    base = F.filter("secrets", lambda x: x["rank"] < STRONG)
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    return scanned.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:STRONG]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def without(text: Column, found: Column, mark: str) -> Column:
    """``text`` with the spans of ``found`` (by start) replaced by ``mark``; spans that overlap share one."""
    end = F.char_length(text).cast("long")
    edge = F.array(F.struct(end.alias("start"), end.alias("end")))
    slim = F.concat(F.transform(found, lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"))), edge)

    def whole(pieces: Column, rows: Column) -> Column:
        ends = running(F.transform(rows, lambda x: x["end"]), F.lit(0).cast("long"), F.greatest)
        before = F.concat(F.array(F.lit(0).cast("long")), F.slice(ends, F.lit(1), F.size(rows) - 1))
        part = lambda x, b, i: F.when(i == F.size(rows), cut(pieces, b, x["start"])).when(x["start"] >= b, F.concat(cut(pieces, b, x["start"]), F.lit(mark))).otherwise(F.lit(""))
        zipped = F.arrays_zip(rows.alias("x"), before.alias("b"), F.sequence(F.lit(1), F.size(rows)).alias("i"))
        return F.array_join(F.transform(zipped, lambda r: part(r["x"], r["b"], r["i"])), "")

    return bound(pieces_of(text), lambda pieces: bound(slim, lambda rows: whole(pieces, rows)))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and n_chars, where there is one, set anew; other rows and
    columns stay as they are."""
    (secrets,) = fresh(docs, "secrets")
    has, (clean,) = F.size(secrets) > 0, fresh(docs, "clean")
    out = scan(docs, into=secrets).withColumn(clean, F.when(has, without(F.col("text"), F.col(secrets), mark)).otherwise(F.col("text")))
    anew = {"text": F.col(clean)} | ({"n_chars": F.when(has, F.char_length(clean).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return out.select(*(anew.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
