"""Lookups and classification against a background."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopespark.operators.clean import dedupe_first

#: Groups that a column of labels may have where each row is set against every one of them.
MOST_LABELS = 1000


def _labels(df: DataFrame, column: str) -> Column:
    """The distinct values of a label column as one array; more than MOST_LABELS are an error."""
    found = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_LABELS + 1).collect())
    if len(found) > MOST_LABELS:
        raise ValueError(f"{column} has more than {MOST_LABELS} values")
    return F.array(*[F.lit(x) for x in found]).cast(f"array<{df.schema[column].dataType.simpleString()}>")


def lookup(left: DataFrame, right: DataFrame, on: str, value: str, order_by: Sequence[str], default: object = 0, position: int | None = None) -> DataFrame:
    """``left`` with the first matching ``value`` of ``right`` (by ``order_by``) or ``default``.

    The join strategy is left to the optimiser, which broadcasts the right side where it is small.
    """
    first = dedupe_first(right.select(on, value, *[c for c in order_by if c not in (on, value)]), [on], order_by).select(on, F.col(value).alias("__value"))
    out = left.join(first, on, "left").withColumn(value, F.coalesce("__value", F.lit(default))).drop("__value")
    columns = [*left.columns]
    columns.insert(len(columns) if position is None else position, value)
    return out.select(*columns)


def classify_scope(background: DataFrame, scopes: DataFrame, cuts: Sequence[float], key: str = "key", chemistry: str = "chemistry", value: str = "yield") -> DataFrame:
    """Each background key for each chemistry and cut: ``highlight``, ``hollow`` or ``grey``.

    One row per background row, chemistry and cut is the result itself; chemistries are at most
    MOST_LABELS, cuts a short list.
    """
    best = scopes.groupBy(chemistry, key).agg(F.max(value).alias(value))
    grid = background.withColumn(chemistry, F.explode(_labels(scopes, chemistry))).join(best, [chemistry, key], "left")
    cut = F.explode(F.array(*[F.lit(float(c)) for c in cuts])).alias("cut")
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    kind = F.when(~known, "grey").when(F.col(value) >= F.col("cut"), "highlight").otherwise("hollow")
    return grid.select("*", cut).withColumn("class", kind)


def background_of(df: DataFrame, group: str) -> DataFrame:
    """(for_group, all columns): for each group, the rows of all others, as the plotting step needs them.

    Every row is copied once for each of the other groups (at most MOST_LABELS); where only figures are
    needed, ``background_stats`` gives them without a copy.
    """
    others = F.filter(_labels(df, group), lambda g: g != F.col(group))
    return df.select(F.explode(others).alias("for_group"), "*")


def background_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean) over the rows of all other groups, from totals: no row is copied."""
    own = df.groupBy(group).agg(F.count(value).alias("c"), F.sum(value).alias("s"))
    total = F.broadcast(own.agg(F.sum("c").alias("tc"), F.sum("s").alias("ts")))  # one row
    n = F.col("tc") - F.col("c")
    return own.crossJoin(total).select(group, n.alias("n"), F.try_divide(F.col("ts") - F.col("s"), n).alias("mean"))
