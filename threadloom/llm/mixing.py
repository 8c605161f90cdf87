"""Mixing sources to target weights by entropy balancing.

Documents get rates exp(sum of their margins' multipliers); the convex dual
``sum(cell tokens * exp(x . lam)) - lam . targets`` is solved by Newton steps, each a Spark job over pre-aggregated
cells. With one margin (the sources of the query) the unknowns do not meet, and gradient, curvature and step are columns
of the table of sources, however many there are (``newton_rates``). With several margins that cross
(``newton_dual``) the cells' tilted masses go to the gradient and the Hessian by ``groupBy`` and the driver solves a
system with one unknown per margin value, which must be few. Rates become whole copies by carrying the rounding error
from long to short documents within shards of a source (at most ``SHARD`` documents or so), so each shard misses its
target by about the size of its smallest documents.

Defined results: sizes count words; null or empty text has size 0 and is taken once at most with 0 words. Null sources
are a source of their own, last in order. Ties and repeated rows are ordered by size, then doc_id; equal rows
are interchangeable. An empty table gives an empty result. Very long texts are counted in place. ``entropy_mix`` reads
doc_id, text and source only; ``materialise`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import WORD, fresh, spread_join, stage

WEIGHTS, MOST, SHARD = (5, 2, 1), 3.0, 2048
MAX_STEPS, TOLERANCE = 60, 1e-10


def sized(docs: DataFrame, keep: Sequence[str] = ("doc_id", "source")) -> DataFrame:
    return docs.select(*keep, F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target): sources in order weigh ``weights`` in turn and share the sum of all
    sizes; a target stops at ``most`` times its source's size and the rest is shared anew by weight.

    That is filling to a level: sources in order of cap / weight stop one after another, and the first whose
    cap is not reached by the rest of the total sets the level. Works on one row per source.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = table.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    table = table.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    done, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(done), F.lit(0.0))) / F.sum("w").over(rest)
    table = table.withColumn("level", level)
    table = table.withColumn("turn", F.row_number().over(order))
    reached = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("turn", "level"))).over(every)["level"]
    return table.select("source", "source_size", "n", F.least(F.col("cap"), F.coalesce(reached, F.col("ratio")) * F.col("w")).cast("double").alias("target"))


def newton_rates(goals: DataFrame, mass: str = "source_size", target: str = "target") -> DataFrame:
    """``goals`` with ``rate``: the dual of one margin, where each value has an unknown of its own. Its Hessian is
    diagonal, so a Newton step is a column of the table: gradient ``mass * exp(lam) - target`` over curvature
    ``mass * exp(lam)``, downward at most by one. A step is a Spark job over all rows; only the largest error comes
    back. Values without mass or target get rate 0."""
    (lam,) = fresh(goals, "lam")
    active = (F.col(mass) > 0) & (F.col(target) > 0)
    table = stage(goals.withColumn(lam, F.when(active, F.lit(0.0))), "newton")
    tilted = F.col(mass) * F.exp(lam)
    for _ in range(MAX_STEPS):
        worst = table.agg(F.max(F.abs(tilted - F.col(target)) / F.col(target)).alias("x")).first()["x"]
        if worst is None or worst < TOLERANCE:
            break
        step = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), (F.col(target) - tilted) / tilted))
        table = stage(table.withColumn(lam, F.col(lam) + step), "newton")
    return table.withColumn("rate", F.coalesce(F.exp(lam), F.lit(0.0))).drop(lam)


def newton_dual(cells: DataFrame, targets: dict[tuple[str, object], float], margins: Sequence[str], mass: str = "mass") -> dict[tuple[str, object], float]:
    """Multipliers by (margin, value). ``cells``: one row per combination of margin values, with its mass.

    Values with target 0 or without mass get minus infinity (rate 0). What comes to the driver per step is
    one number per value and per pair of values that share a cell. Steps are halved until the dual falls.
    """
    keys = sorted((k for k, v in targets.items() if v > 0), key=str)
    at = {k: i for i, k in enumerate(keys)}
    goal = np.array([targets[k] for k in keys])
    lam = np.zeros(len(keys))
    names = list(margins)

    def terms(values: np.ndarray):
        held = values.copy()

        def run(frames):
            for pdf in frames:
                rows = []
                for *vals, m in zip(*(pdf[c] for c in names), pdf[mass], strict=True):
                    ks = [at.get((c, None if pd.isna(v) else v)) for c, v in zip(names, vals, strict=True)]
                    if None in ks:
                        continue
                    tilted = float(m) * math.exp(min(50.0, sum(held[k] for k in ks)))
                    rows += [(i, j, tilted) for i in ks for j in ks]
                    rows.append((-1, -1, tilted))
                yield pd.DataFrame(rows, columns=["i", "j", "x"])

        got = cells.select(*names, mass).mapInPandas(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
        hess, total = np.zeros((len(keys), len(keys))), 0.0
        for r in got:
            if r["i"] < 0:
                total = r["x"]
            else:
                hess[r["i"], r["j"]] = r["x"]
        return total - float(values @ goal), np.diag(hess) - goal, hess

    if not keys:
        return {}
    value, grad, hess = terms(lam)
    for _ in range(MAX_STEPS):
        if np.max(np.abs(grad) / goal) < TOLERANCE:
            break
        step = -np.linalg.lstsq(hess + 1e-12 * np.diag(np.diag(hess)), grad, rcond=None)[0]
        for _ in range(30):
            trial = terms(lam + step)
            if trial[0] <= value + 1e-9 * abs(value):
                break
            step = step / 2
        lam, (value, grad, hess) = lam + step, trial
    return {k: float(lam[i]) for k, i in at.items()}


def carried(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of a shard's documents: long ones first, each rounded to where the running sum comes nearest."""
    pdf = pdf.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
    rate, off, copies = pdf["rate"].to_numpy(), 0.0, []
    for size, r in zip(pdf["size"].to_numpy(), rate, strict=True):
        low = math.floor(r + 1e-9)
        extra = r - low
        up = int(extra > 1e-9 and off + extra * size >= size / 2)
        off += extra * size - up * size
        copies.append(low + up)
    return pdf.assign(copies=copies)


def keyed(name: str) -> Column:
    """A key that is null for nothing: a mark before the value."""
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("null"))


def entropy_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, one row per document."""
    sizes = stage(sized(docs).withColumn("of", keyed("source")), "sizes")
    goals = newton_rates(stage(source_targets(sizes, weights, most), "targets"))
    table = stage(goals.select(keyed("source").alias("of"), "source_size", "n", "target", F.least(F.col("rate"), F.lit(float(most))).alias("rate")), "rates")
    all_docs = spread_join(sizes, table, "of")
    shard = F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("n") / SHARD).cast("long")).alias("shard")
    placed = all_docs.select("doc_id", "source", "size", "source_size", "target", "rate", shard)
    schema = "doc_id long, source string, size long, source_size long, target double, rate double, shard long, copies int"
    return placed.groupBy("source", "shard").applyInPandas(carried, schema).drop("shard")


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def materialise(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` repeated by their copies, all columns as they were. Rows that share a doc_id share one
    decision, the largest number of copies of any."""
    an_id, copies, one = fresh(docs, "id", "copies", "copy")
    decided = entropy_mix(docs).groupBy(F.col("doc_id").alias(an_id)).agg(F.max("copies").alias(copies))
    rows = docs.join(decided, F.col("doc_id").eqNullSafe(F.col(an_id)))
    return rows.filter(F.col(copies) > 0).withColumn(one, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(an_id, copies, one)
