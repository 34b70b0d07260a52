"""Similarities of names. Null in, null out."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro_of(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, kept = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                kept.append(x)
                break
    m = len(kept)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(kept, (y for y, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler_of(a: str, b: str, weight: float = 0.1, above: float = 0.7, jaro: float | None = None) -> float:
    """Jaro raised by a common beginning of up to four characters, if it is over ``above``."""
    score = jaro_of(a, b) if jaro is None else jaro
    if score <= above:
        return score
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return score + same * weight * (1 - score)


def partial_ratio_of(a: str, b: str) -> float:
    """The best ratio of the shorter name with a window of its length in the longer one, in whole hundredths."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 1.0 if not long else 0.0
    best = 0.0
    for i, j, _ in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks():
        at = max(j - i, 0)
        best = max(best, SequenceMatcher(None, short, long[at : at + len(short)], autojunk=False).ratio())
    return round(100 * best) / 100


def similarities(a: Column, b: Column) -> Column:
    """struct<jaro, jaro_winkler, partial_ratio>, worked out once for each different pair of names of a batch."""

    @F.pandas_udf("jaro double, jaro_winkler double, partial_ratio double")
    def scored(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        known: dict[tuple, tuple] = {}
        for pair in zip(a, b, strict=True):
            if pair not in known:
                if pair[0] is None or pair[1] is None:
                    known[pair] = (None, None, None)
                else:
                    jaro = jaro_of(*pair)
                    known[pair] = (jaro, jaro_winkler_of(*pair, jaro=jaro), partial_ratio_of(*pair))
        return pd.DataFrame([known[pair] for pair in zip(a, b, strict=True)], columns=["jaro", "jaro_winkler", "partial_ratio"], dtype="float64")

    return scored(a, b)


def jaro(a: Column, b: Column) -> Column:
    return similarities(a, b)["jaro"]


def jaro_winkler(a: Column, b: Column) -> Column:
    return similarities(a, b)["jaro_winkler"]


def partial_ratio(a: Column, b: Column) -> Column:
    return similarities(a, b)["partial_ratio"]


def distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def _chars(c: Column) -> Column:
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, i, F.lit(1))))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: one row of the table is folded into the next."""
    n = F.length(b)

    def row(above: Column, x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            F.array(F.lit(0)),
            lambda new, j: F.concat(new, F.array(F.when(F.substring(b, j, F.lit(1)) == x, F.get(above, j - 1) + 1).otherwise(F.greatest(F.get(above, j), F.get(new, j - 1))))),
        )

    table = F.aggregate(_chars(a), F.array_repeat(F.lit(0), n + 1), row, lambda last: F.get(last, n))
    return F.when(n == 0, F.lit(0)).otherwise(table)


def ratio(a: Column, b: Column) -> Column:
    """2 * common subsequence / (length + length); 1 for two empty names."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).when(total > 0, common_subsequence(a, b) * 2.0 / F.greatest(total, F.lit(1)))
