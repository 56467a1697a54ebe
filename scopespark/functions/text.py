"""Text predicates and similarity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def contains_any(col: Column, terms: Sequence[str]) -> Column:
    """Case-insensitive literal match of any term; null matches nothing."""
    lowered = F.lower(col)
    found = reduce(lambda a, b: a | b, [lowered.contains(F.lit(t.lower())) for t in terms], F.lit(False))
    return F.coalesce(found, F.lit(False))


def jaro(a: str, b: str) -> float:
    """Share of matching characters, in order."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [b[j] for j, u in enumerate(used) if u]
    m, moved = len(left), sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler_one(a: str, b: str, weight: float = 0.1, boost: float = 0.7) -> float:
    """Jaro similarity, raised for a common prefix of up to four characters where it exceeds ``boost``."""
    s = jaro(a, b)
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return s + prefix * weight * (1 - s) if s > boost else s


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity; null where either side is null."""
    return pd.Series([None if x is None or y is None else jaro_winkler_one(x, y) for x, y in zip(a, b)], dtype="float64")


def with_similarity(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``df`` with the similarity of two columns, computed once for each distinct pair."""
    pairs = df.select(a, b).distinct().withColumn(out, jaro_winkler(F.col(a), F.col(b)))
    return df.join(pairs.withColumnsRenamed({a: "__a", b: "__b"}), (F.col(a).eqNullSafe(F.col("__a"))) & (F.col(b).eqNullSafe(F.col("__b"))), "left").drop("__a", "__b")
