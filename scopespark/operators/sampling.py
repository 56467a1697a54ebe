"""Stratified sampling without replacement, and distribution shift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopespark.operators.grouped import quotas
from scopespark.session import spool


def bin_index(value: Column, edges: Sequence[float], strict: bool = False) -> Column:
    """Index of the bin [lo, hi), the last one closed; null outside.  ``strict``: open on both sides."""
    out = F.lit(None).cast("int")
    last = len(edges) - 2
    for i in range(last, -1, -1):
        lo, hi = edges[i], edges[i + 1]
        inside = (value > lo) & (value < hi) if strict else (value >= lo) & ((value <= hi) if i == last else (value < hi))
        out = F.when(inside, F.lit(i)).otherwise(out)
    return F.when(F.isnan(value), None).otherwise(out)


def stratified_sample(df: DataFrame, key: str, stratum: str, value: str, edges: Sequence[float], n: int, exclude: DataFrame | None = None, seed: int = 42, strict: bool = False) -> DataFrame:
    """(key, stratum, bin, round): up to each stratum's quota, one draw per non-empty bin in turn.

    The order within a bin is a seeded digest of the key, so any engine draws the same rows.  Rounds
    are numbered per (stratum, bin), and only rows within the quota take part in the final ranking.
    """
    share = quotas(df, stratum, n)
    pool = df.select(key, stratum, bin_index(F.col(value).cast("double"), edges, strict).alias("bin")).where("bin is not null").dropDuplicates([key])
    if exclude is not None:
        pool = pool.join(exclude.select(key).distinct(), key, "left_anti")
    draw = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    turn = F.row_number().over(Window.partitionBy(stratum, "bin").orderBy(draw, key))
    rounds = pool.withColumn("round", turn).join(share.select(stratum, "quota"), stratum).where("round <= quota")
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("round", "bin"))
    return rounds.withColumn("__place", place).where("__place <= quota").select(key, stratum, "bin", "round")


def quartiles(long: DataFrame, points: Sequence[float] = (0.25, 0.75), accuracy: int = 10_000) -> DataFrame:
    """(feature, lo, hi, n, q): extremes, count and exact linear quantiles of x for each feature of (feature, x).

    An approximate percentile, wrong by at most n / accuracy ranks, brackets each point; only the values within
    the brackets are counted one by one, so no task holds a feature's distinct values.
    """
    slack = 2 / accuracy
    near = [min(max(p + s, 0.0), 1.0) for p in points for s in (-slack, slack)]
    sides = F.percentile_approx("x", near, F.lit(accuracy)).alias("near")
    stats = long.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"), sides)
    brackets = F.array(*[F.struct(F.lit(i).alias("i"), F.col("near")[2 * i].alias("a"), F.col("near")[2 * i + 1].alias("b")) for i in range(len(points))])
    tagged = long.join(F.broadcast(stats.select("feature", "near")), "feature")  # one row per feature
    below = tagged.groupBy("feature").agg(F.array(*[F.count_if(F.col("x") < F.col("near")[2 * i]) for i in range(len(points))]).alias("below"))
    within = tagged.select("feature", "x", F.explode(F.filter(brackets, lambda s: (F.col("x") >= s["a"]) & (F.col("x") <= s["b"]))).alias("s"))
    counts = within.groupBy("feature", F.col("s.i").alias("i"), "x").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("feature", "i").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).join(F.broadcast(below), "feature").join(F.broadcast(stats.select("feature", "n")), "feature")
    place = F.element_at(F.array(*[F.lit(float(p)) for p in points]), F.col("i") + 1) * (F.col("n") - 1)
    last = F.col("upto") + F.element_at("below", F.col("i") + 1)
    value = lambda at: F.min(F.when(last > at, F.col("x")))
    each = ranked.groupBy("feature", "i").agg(value(F.floor(place)).alias("x0"), value(F.ceil(place)).alias("x1"), F.first(place - F.floor(place)).alias("t"))
    q = each.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("i", (F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("t")).alias("v")))).alias("m"))
    return stats.drop("near").join(q, "feature").select("feature", "lo", "hi", "n", F.array(*[F.element_at("m", F.lit(i)) for i in range(len(points))]).alias("q"))


def kl_shift(whole: DataFrame, subset: DataFrame, columns: Sequence[str], bins: str | int = "auto") -> tuple[DataFrame, DataFrame]:
    """((feature, kl, n_bins), (feature, bin, p, q)): shift of a subset against the whole, per feature.

    Bins cover the whole's range; ``auto`` is NumPy's rule: the smaller of Sturges' width and the larger of
    the Freedman-Diaconis width and half the square-root width.  Zeros are replaced by 1e-5 of the smallest
    non-zero bin of the same histogram, then both are normalised.
    """
    def long(df: DataFrame) -> DataFrame:
        wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        out = wide.unpivot([], list(columns), "feature", "x") if len(columns) > 1 else wide.select(F.lit(columns[0]).alias("feature"), F.col(columns[0]).alias("x"))
        return out.where("x is not null and not isnan(x)")

    all_rows = long(whole)
    span = F.col("hi") - F.col("lo")
    if bins == "auto":
        stats = quartiles(all_rows)
        n = F.col("n").cast("double")
        fd = 2 * (F.col("q")[1] - F.col("q")[0]) * F.pow(n, F.lit(-1 / 3))
        width = F.least(F.greatest(fd, span / F.sqrt(n) / 2), span / (F.log2(n) + 1))
        count = F.when(span > 0, F.greatest(F.ceil(F.try_divide(span, width)), F.lit(1))).otherwise(F.lit(1)).cast("long")
    else:
        stats = all_rows.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        count = F.lit(int(bins)).cast("long")
    # one row per feature, read twice below
    stats = F.broadcast(spool(stats.select("feature", "lo", "hi", count.alias("n_bins")), "stats"))

    def histogram(df: DataFrame, name: str) -> DataFrame:
        at = F.when(span > 0, F.least(F.floor((F.col("x") - F.col("lo")) * F.col("n_bins") / span), F.col("n_bins") - 1)).otherwise(F.lit(0))
        inside = df.join(stats, "feature").where("x >= lo and x <= hi")
        return inside.groupBy("feature", at.cast("long").alias("bin")).agg(F.count("*").alias(name))

    grid = stats.select("feature", "n_bins", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)).alias("bin"))
    both = grid.join(histogram(all_rows, "a"), ["feature", "bin"], "left").join(histogram(long(subset), "b"), ["feature", "bin"], "left")
    each = Window.partitionBy("feature")
    for c in ("a", "b"):
        filled = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        least = F.min(F.when(filled > 0, filled)).over(each)
        both = both.withColumn(c, F.when(filled > 0, filled).otherwise(least * 1e-5))
    table = both.select("feature", "bin", "n_bins", (F.col("a") / F.sum("a").over(each)).alias("p"), (F.col("b") / F.sum("b").over(each)).alias("q"))
    kl = table.groupBy("feature").agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"), F.first("n_bins").alias("n_bins"))
    return kl, table.select("feature", "bin", "p", "q")
