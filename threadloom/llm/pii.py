"""Personal data: high-recall candidate spans, boosted trees on format and context bits, chosen threshold.

All in DataFrame functions. Base kinds (email, ip, card, phone) are found by pattern and check digit.
Wider generators propose overlapping candidates; each gets ``BITS`` yes/no features packed in an integer.
The features hide what the base checks look for: a number is seen without its plus and country code and
without its check digit, an address with @ and (at), . and (dot) alike. So a national number has the
features of the international one, and a spelt-out address those of the plain one. Labels:

* positive: the candidate is a verified base span;
* negative: a base check applies and fails (check digit, octets, length after a plus), it hangs on a letter
  or digit, or it is a bare run of digits with no cue before it;
* undecided: the rest, which no base check can judge. Only they can be added, and they train nothing.

Counts per (half of the documents, feature integer, label) over all documents are one partial aggregation with at most
2 * 2**len(BITS) groups. The trees are boosted over the cells of one half with their weights, so no row is sampled; the
thresholds, one for numbers and one for addresses, are the lowest scores whose cells of the other half reach
``PRECISION``. An undecided candidate is added where its cell scores so
high, holds positives and reaches ``PRECISION`` itself; the cue may be there besides. What looks like no
verified span of the same table is thus never added: without verified phones no number is.

Defined results: null text counts as empty and gives no spans. An empty table gives an empty result; with no
positives nothing is added to the base spans. Candidates that touch a base span add nothing. Repeated rows get equal
results and count as often as they come. Ties (spans that start together) are ordered by kind and end. Work columns get
names that the input does not have, so extra columns of any name do no harm. Texts of any length and of any number of
matches take time in proportion.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import FAR, bound, cut, fresh, joined, labelled, no_spans, pieces_of, spans, stage, with_sides

#: Fixed patterns of the base kinds, written so that long runs cost no more than their length: a match starts where a
#: run does or the last match ended, and what is taken is not given back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+(?<=[0-9][\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Wider generators.
NUMBER = r"[+(]?[0-9][0-9\x20().-]{6,}[0-9]"
ADDRESS = r"(?i)(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[a-z0-9-]+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[a-z0-9-]+)+"
KINDS = ("email", "ip", "card", "phone")
ROUNDS, RATE, PRECISION = 24, 0.4, 0.98
#: Names of the feature bits, lowest first. All but the first two and the last two are of numbers only.
BITS = ("cue", "glued", "paren", "dash", "dot", "space", "few", "long", "two", "many", "date", "tail", "at", "top", "short")
CUE = 1 << BITS.index("cue")
#: What a number is seen without: plus and country code, or a 1 before an area code.
COUNTRY = r"^(?:\+[0-9]{1,3}(?=[\x20.(-])|\+|1(?=[\x20(-]))[\x20.-]*"
DATE = r"(?:^|[^0-9])(?:(?:19|20)[0-9]{2}[\x20.-][0-9]{1,2}[\x20.-][0-9]{1,2}|[0-9]{1,2}[\x20.-][0-9]{1,2}[\x20.-](?:19|20)[0-9]{2})(?:[^0-9]|$)"


def luhn(digits: Column) -> Column:
    r = F.reverse(digits)
    doubled = lambda i: F.substr(r, i + 1, F.lit(1)).cast("int") * 2
    value = lambda i: F.when(i % 2 == 0, F.substr(r, i + 1, F.lit(1)).cast("int")).when(doubled(i) > 9, doubled(i) - 9).otherwise(doubled(i))
    return F.aggregate(F.sequence(F.lit(0), F.length(r) - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _cue(pieces: Column, x: Column) -> Column:
    before = cut(pieces, F.greatest(x["start"] - 24, F.lit(0)), x["start"])
    return before.rlike(r"(?i)tel|phone|call|fax|mail|contact|card|\bip\b|ssn")


def _glued(pieces: Column, x: Column) -> Column:
    beside = lambda at: F.coalesce(cut(pieces, at, at + 1).rlike("[A-Za-z0-9]"), F.lit(False))
    return ((x["start"] > 0) & beside(F.greatest(x["start"] - 1, F.lit(0)))) | beside(x["end"])


def _packed(tests: dict[str, Column]) -> Column:
    total = F.lit(0)
    for name, test in tests.items():
        total = total + F.when(test, F.lit(1 << BITS.index(name))).otherwise(F.lit(0))
    return total


def _number_bits(pieces: Column, x: Column) -> Column:
    seen = F.regexp_replace(x["hit"], COUNTRY, "")
    n, groups = F.length(digits_of(seen)), F.size(F.split(F.regexp_replace(seen, "^[^0-9]+", ""), "[^0-9]+"))
    return _packed({
        "cue": _cue(pieces, x), "glued": _glued(pieces, x), "paren": seen.contains("("), "dash": seen.contains("-"), "dot": seen.contains("."), "space": seen.contains(" "),
        "few": n <= 8, "long": n >= 12, "two": groups == 2, "many": groups >= 4, "date": seen.rlike(DATE), "tail": seen.rlike("[^0-9][0-9]{4}$"),
    })


def _address_bits(pieces: Column, x: Column) -> Column:
    last = F.regexp_extract(x["hit"], "([A-Za-z0-9-]+)$", 1)
    return _packed({"cue": _cue(pieces, x), "glued": _glued(pieces, x), "at": F.lit(True), "top": last.rlike("^(?:[a-z]{2,}|[A-Z]{2,})$"), "short": F.length(last) <= 4})


def _fails(pieces: Column, x: Column) -> Column:
    """That a number which is no base span is known to be none."""
    hit, n = x["hit"], F.length(digits_of(x["hit"]))
    bare = ~hit.rlike("[^0-9]") & ~_cue(pieces, x)
    return bare | hit.startswith("+") | hit.rlike(r"^[0-9]+(?:\.[0-9]+){3,}$") | (n > 19) | ((n >= 13) & ~luhn(digits_of(hit))) | _glued(pieces, x)


def candidates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` plus base spans by kind and ``proposed``: array<struct<start,end,bits,label>>, label null for the
    undecided. Candidates that touch a base span without being one are left out."""
    t = F.coalesce(F.col(text), F.lit(""))

    def of(pattern: str, guard: Column) -> Column:
        return F.when(guard, spans(t, pattern)).otherwise(no_spans())

    names = dict(zip((*KINDS, "number", "address", "beside"), fresh(docs, *KINDS, "number", "address", "beside"), strict=True))
    small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.ltrim(p, F.lit("0")), F.lit("999")), F.lit(0)) <= 255)
    base = {
        "email": of(EMAIL, t.contains("@")),
        "ip": F.filter(of(IP, t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")), lambda x: F.forall(F.split(x["hit"], r"\."), small)),
        "card": F.filter(of(CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")), lambda x: F.length(digits_of(x["hit"])).between(13, 19) & luhn(digits_of(x["hit"]))),
        "phone": F.filter(of(PHONE, t.rlike(r"\+[0-9]")), lambda x: F.length(digits_of(x["hit"])).between(9, 15)),
        "number": of(NUMBER, t.rlike(r"[0-9][0-9\x20().-]{6,}[0-9]")),
        "address": of(ADDRESS, t.rlike(r"(?i)@|[(\[]at[)\]]")),
    }
    found = docs.withColumns({names[k]: c for k, c in base.items()})
    # spans by start, base spans first: how a candidate lies to them follows from running ends, keys and starts
    slim = lambda c, rank: F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["hit"].alias("hit")))
    every = F.array_sort(F.concat(*(slim(names[k], 0) for k in KINDS), slim(names["number"], 1), slim(names["address"], 2)))
    key = lambda x: x["start"] * F.lit(1 << 31) + x["end"]
    base_only = lambda x, value, none: F.when(x["rank"] == 0, value).otherwise(F.lit(none))
    sides = with_sides(every, lambda x: {"end": base_only(x, x["end"], 0), "key": base_only(x, key(x), 0)}, lambda x: {"start": base_only(x, x["start"], FAR)})
    apart = lambda r: (r["pre"]["end"] <= r["x"]["start"]) & (r["suf"]["start"] >= r["x"]["end"])
    is_base = lambda r: r["pre"]["key"] == key(r["x"])
    some = F.size(names["number"]) + F.size(names["address"]) > 0
    found = found.withColumn(names["beside"], F.when(some, F.filter(sides, lambda r: (r["x"]["rank"] > 0) & (is_base(r) | apart(r)))))

    def rated(pieces: Column, r: Column) -> Column:
        x, number = r["x"], r["x"]["rank"] == 1
        bits = F.when(number, _number_bits(pieces, x)).otherwise(_address_bits(pieces, x))
        label = F.when(is_base(r), F.lit(True)).when(F.when(number, _fails(pieces, x)).otherwise(_glued(pieces, x)), F.lit(False))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), bits.alias("bits"), label.alias("label"))

    proposed = bound(pieces_of(t), lambda pieces: F.transform(names["beside"], lambda r: rated(pieces, r)))
    none = F.array().cast("array<struct<start:bigint,end:bigint,bits:int,label:boolean>>")
    spans_only = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return found.select(*keep, *(spans_only(F.col(names[k])).alias(k) for k in KINDS), F.coalesce(F.when(F.size(names["beside"]) > 0, proposed), none).alias("proposed"))


def boost(cells: list[tuple[int, int, int]], rounds: int = ROUNDS, rate: float = RATE) -> list[tuple[int, int, tuple[float, float, float, float]]]:
    """Logistic boosting of two-level trees over cells (bits, positives, negatives): (bit, bit, leaf values)."""
    if not cells:
        return []
    bits, pos, neg = (np.array(x, float) for x in zip(*sorted(cells), strict=True))
    on = (bits.astype(int)[:, None] >> np.arange(len(BITS))) & 1
    n, score, trees = pos + neg, np.zeros(len(pos)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = pos - n * p, n * p * (1 - p) + 1e-9
        best = None
        for i in range(len(BITS)):
            for j in range(i, len(BITS)):
                leaf = on[:, i] * 2 + on[:, j]
                g, h = np.bincount(leaf, grad, 4), np.bincount(leaf, hess, 4) + 1.0
                gain = float((g * g / h).sum())
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, i, j, rate * g / h, leaf)
        _, i, j, values, leaf = best
        score += values[leaf]
        trees.append((i, j, tuple(float(v) for v in values)))
    return trees


def score_of(trees: list, bits: int) -> float:
    return sum(v[((bits >> i) & 1) * 2 + ((bits >> j) & 1)] for i, j, v in trees)


def threshold_of(cells: list[tuple[int, int, int]], trees: list, precision: float = PRECISION) -> float | None:
    """The lowest score from which on all cells together reach ``precision``; None if there is none."""
    scored = sorted(((score_of(trees, b), p, n) for b, p, n in cells), reverse=True)
    good = bad = 0
    found = None
    for k, (s, p, n) in enumerate(scored):
        good, bad = good + p, bad + n
        if good and good >= precision * (good + bad) and (k + 1 == len(scored) or scored[k + 1][0] < s):
            found = s
    return found


AT = 1 << BITS.index("at")


def accepted(learned: list[tuple[int, int, int]], held: list[tuple[int, int, int]], precision: float = PRECISION) -> list[int]:
    """Feature integers of the cells whose undecided candidates are added: trees are boosted on the cells of one half
    of the documents, and thresholds, one for numbers and one for addresses, are set on those of the other."""
    trees = boost(learned) if any(p for _, p, _ in learned) else []
    out: set[int] = set()
    for address in (False, True):
        cells = [c for c in held if bool(c[0] & AT) == address]
        cut = threshold_of(cells, trees, precision) if trees else None
        if cut is not None:
            known = {b: [p, n] for b, p, n in cells}
            for b, p, n in learned:
                if bool(b & AT) == address:
                    both = known.setdefault(b, [0, 0])
                    both[0] += p
                    both[1] += n
            good = {b for b, (p, n) in known.items() if p and p >= precision * (p + n) and score_of(trees, b) >= cut}
            bad = {b for b, (_, n) in known.items() if n} - good
            out |= good | ({b | CUE for b in good} - bad)
    return sorted(out)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and ``pii``: array<struct<start,rank,end,kind>>, base kinds first, then kind extra."""
    found = stage(candidates(docs), "pii_candidates")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    known = found.select(half.alias("half"), F.explode("proposed").alias("x")).filter("x.label is not null")
    counted = known.groupBy("half", "x.bits").agg(F.sum(F.col("x.label").cast("long")).alias("pos"), F.count("*").alias("n"))
    cells = counted.collect()  # at most 2 * 2 ** len(BITS) rows
    of = lambda h: [(r["bits"], r["pos"], r["n"] - r["pos"]) for r in cells if r["half"] == h]
    take = accepted(of(0), of(1))
    every = [labelled(F.col(k), k, i) for i, k in enumerate(KINDS)]
    if take:
        extra = F.filter("proposed", lambda x: x["label"].isNull() & x["bits"].isin(take))
        every.append(labelled(extra, "extra", len(KINDS)))
    return found.select("doc_id", F.concat(*every).alias("pii"))


def digest(detected: DataFrame) -> DataFrame:
    base = F.filter("pii", lambda x: x["rank"] < len(KINDS))
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long")
    return detected.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
