"""Keyword search over articles: ``word`` must occur, ``-word`` must not, ``%word`` looks at the poster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(words: Sequence[str]) -> list[tuple[str, str, str]]:
    """(+ or -, subject or poster, word); a backslash takes the next sign as it is."""
    out = []
    for w in words:
        sign, where = "+", "subject"
        while w[:1] in ("+", "-", "%") and len(w) > 1:
            if w[0] == "%":
                where = "poster"
            else:
                sign = w[0]
            w = w[1:]
        out.append((sign, where, w[1:] if w[:1] == "\\" else w))
    return out


def condition(words: Sequence[str], any_case: bool = False) -> Column:
    out = F.lit(True)
    for sign, where, w in parse(words):
        c = F.lower(where).contains(w.lower()) if any_case else F.col(where).contains(w)
        out = out & (c if sign == "+" else ~c)
    return out


def search(articles: DataFrame, words: Sequence[str], any_case: bool = False, least: int = 0, most: int = 9999) -> DataFrame:
    by_score = F.col("score") == least if least == most else F.col("score").between(least, most)
    return articles.filter(condition(words, any_case) & by_score)
