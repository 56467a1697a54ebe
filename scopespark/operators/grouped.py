"""Grouped reductions: representatives, routes, masks, votes, elbows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopespark.functions.text import contains_any, with_similarity


def representative(df: DataFrame, key: str, value: str, label: str, order_by: Sequence[str], carry: Sequence[str] = (), cap: float = 100.0, sim: float = 0.75) -> DataFrame:
    """One row per key: the best value's label, and the mean over it and all similarly labelled rows.

    Values that don't parse are dropped; a key whose best value exceeds ``cap`` is dropped whole; of
    equal best values the first by ``order_by`` decides; a null label is ``"None"``.
    """
    number = F.col(value).try_cast("double")
    rows = df.select(key, number.alias("__v"), F.coalesce(F.col(label), F.lit("None")).alias("__l"), *order_by, *[c for c in carry if c not in order_by])
    rows = rows.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    # the best row as a running minimum: partial aggregates keep hot keys small
    first = F.min(F.struct((-F.col("__v")).alias("v"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)], F.col("__l").alias("l"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])).alias("b")
    best = rows.groupBy(key).agg(first).select(key, (-F.col("b.v")).alias("__best"), F.col("b.l").alias("__bl"), *[F.col(f"b.c{i}").alias(c) for i, c in enumerate(carry)]).where(F.col("__best") <= cap)
    weights = rows.groupBy(key, "__l").agg(F.sum("__v").alias("__s"), F.count("*").alias("__n"))
    near = with_similarity(weights.join(best.select(key, "__bl"), key), "__l", "__bl", "__sim").where(F.col("__sim") >= sim)
    mean = near.groupBy(key).agg((F.sum("__s") / F.sum("__n")).alias("mean_value"), F.sum("__n").alias("n_rows"))
    return best.join(mean, key).select(key, F.col("__bl").alias("label"), *carry, "mean_value", "n_rows")


def split_routes(df: DataFrame, chemistry: str, chemistry_terms: Sequence[str], routes: Mapping[str, Sequence[str]], order_by: Sequence[str], id: str = "id", reaction: str = "reaction", value: str = "yield", reagent: str = "reagent", catalyst: str = "catalyst", carry: Sequence[str] = ()) -> DataFrame:
    """(route, id, smiles, mean_value, catalyst, reagents, *carry): mean value per id for every route a row belongs to.

    A row belongs to a named route if its reagent or catalyst has a route term, and to the route
    without catalyst (named ``chemistry``) if it has neither catalyst nor any listed term.  All but the mean
    come from the last row; ``reagents`` are its ``;``-separated reagents without any that has a term, sorted.
    """
    base = df.where(F.col(reaction).isNotNull() & F.col(value).isNotNull() & contains_any(F.col(reagent), chemistry_terms))
    base = base.withColumn("smiles", F.split_part(F.col(reaction), F.lit(">"), F.lit(1))).where(~F.col("smiles").contains("."))
    every = [t for terms in routes.values() for t in terms]
    named = [F.when(contains_any(F.col(reagent), terms) | contains_any(F.col(catalyst), terms), F.struct(F.lit(f"{chemistry} + {name}").alias("route"), F.coalesce(F.col(catalyst), F.lit(name)).alias("cat"))) for name, terms in routes.items()]
    bare = F.when(F.col(catalyst).isNull() & ~contains_any(F.col(reagent), every), F.struct(F.lit(chemistry).alias("route"), F.lit(None).cast("string").alias("cat")))
    member = base.withColumn("r", F.explode(F.filter(F.array(*named, bare), lambda x: x.isNotNull())))
    plain = lambda x: ~contains_any(x, [*chemistry_terms, *every]) & (x != "")
    left = F.array_join(F.array_sort(F.filter(F.transform(F.split(reagent, ";"), lambda x: F.trim(x)), plain)), "; ").alias("reagents")
    last = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)], "smiles", "r.cat", left, *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])).alias("m")
    out = member.groupBy(F.col("r.route").alias("route"), F.col(id).alias("id")).agg(F.avg(value).alias("mean_value"), last)
    return out.select("route", "id", F.col("m.smiles").alias("smiles"), "mean_value", F.col("m.cat").alias("catalyst"), "m.reagents", *[F.col(f"m.c{i}").alias(c) for i, c in enumerate(carry)])


def quotas(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """(stratum, population, quota): share of ``n`` by count, rounded down; the total is one row."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("population"))
    total = F.broadcast(counts.agg(F.sum("population").alias("__total")))  # one row
    return counts.crossJoin(total).select(stratum, "population", F.expr(f"population * {int(n)} div __total").alias("quota"))


def membership_mask(df: DataFrame, key: str, group: str) -> DataFrame:
    """(key, mask): bit i is set if the key occurs in the i-th group by sorted label; at most 63 groups."""
    labels = sorted(r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().limit(64).collect())
    if len(labels) > 63:
        raise ValueError("more than 63 groups don't fit a mask")
    if not labels:
        return df.select(key, F.lit(0).cast("long").alias("mask")).limit(0)
    bit = F.coalesce(*[F.when(F.col(group) == v, F.lit(1 << i).cast("long")) for i, v in enumerate(labels)])
    return df.where(F.col(key).isNotNull() & F.col(group).isNotNull()).groupBy(key).agg(F.bit_or(bit).alias("mask"))


def last_by(df: DataFrame, key: str, value: str, order_by: Sequence[str]) -> DataFrame:
    """(key, value): the value of the last row in the given order."""
    last = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)], F.col(value).alias("v"))).alias("m")
    return df.groupBy(key).agg(last).select(key, F.col("m.v").alias(value))


def vote(params: DataFrame, param: str = "param", value: str = "value", seen: str = "seen", numeric: str = "numeric") -> DataFrame:
    """(param, value): most frequent value; of tied numbers the last first seen, of tied strings the first.

    ``numeric`` says whether a value is a number; a parameter with both kinds is an error downstream.
    """
    counts = params.groupBy(param, value).agg(F.count("*").alias("k"), F.min(seen).alias("f"), F.max(F.col(numeric).cast("int")).alias("num"))
    kinds = counts.groupBy(param).agg(F.min("num").alias("a"), F.max("num").alias("b"))
    mixed = F.raise_error(F.concat(F.lit("mixed types for "), F.col(param)))
    order = F.struct("k", F.when(F.col("num") == 1, F.col("f")).otherwise(-F.col("f")), F.col(value).alias("v"))
    best = counts.join(kinds, param).groupBy(param).agg(F.max(order).alias("m"), F.first(F.col("a") != F.col("b")).alias("bad"))
    return best.select(param, F.when(F.col("bad"), mixed).otherwise(F.col("m.v")).alias(value))


def elbow(curve: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the point of the curve farthest below or above the chord of its ends; a curve without points is an error.

    The ends are grouped extremes and the distance is a projection, so no single-partition window is needed.
    """
    ends = curve.agg(F.min(F.struct(x, y)).alias("a"), F.max(F.struct(x, y)).alias("b"))
    wide = F.col("b")[x] - F.col("a")[x]
    line = F.when(wide == 0, F.col(y)).otherwise(F.col("a")[y] + (F.col("b")[y] - F.col("a")[y]) * (F.col(x) - F.col("a")[x]) / wide)
    far = curve.crossJoin(F.broadcast(ends)).select(x, y, F.abs(F.col(y) - line).alias("distance"))  # ends: one row
    best = far.agg(F.max(F.struct("distance", (-F.col(x)).alias("nx"), x, y)).alias("m"))
    missing = F.raise_error(F.lit("the curve has no points")).cast(curve.schema[x].dataType)
    return best.select(F.coalesce(f"m.{x}", missing).alias(x), f"m.{y}", "m.distance")
