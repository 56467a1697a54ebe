"""Row filters and value cleaning for messy literature tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scopespark.session import spool


def align_yield(num: Column, text: Column) -> Column:
    """One number from a numeric cell (largest of a ``;`` list), else the first number before ``percent``."""
    listed = F.array_max(F.transform(F.split(num, ";"), lambda x: F.expr("1").cast("double") * F.trim(x).try_cast("double")))
    spoken = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*percent", 1).try_cast("double")
    return F.coalesce(listed, spoken)


def box(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows inside an inclusive box; NaN is outside."""
    tests = [F.col(c).between(lo, hi) & ~F.isnan(F.col(c).cast("double")) for c, (lo, hi) in bounds.items()]
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def exclude_groups_where(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """Drop every row of a key that has any row with ``condition``; the bad keys are pre-aggregated."""
    bad = df.where(F.coalesce(condition, F.lit(False))).select(key).distinct()
    return df.join(bad, key, "left_anti")


def dedupe_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """First row of each key in an explicit order; a partial aggregate, so hot keys don't pile up."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)], F.struct(*rest).alias("row"))).alias("m")
    return df.groupBy(*keys).agg(first).select(*keys, "m.row.*").select(*df.columns)


def missing(col: str, kind: T.DataType) -> Column:
    c = F.col(f"`{col}`")
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c.isNull()


def null_report(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, key): where a value is null or NaN."""
    chosen = [f for f in df.schema.fields if f.name != key and (columns is None or f.name in columns)]
    names = F.array(*[F.when(missing(f.name, f.dataType), F.lit(f.name)) for f in chosen])
    return df.select(F.explode(F.filter(names, lambda x: x.isNotNull())).alias("column"), key)


# Element symbols that count as metals in the screen.
METALS = (
    "Li Be Na Mg Al K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Cs Ba La Ce "
    "Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi"
).split()


def screen_records(text: Column, metals: Sequence[str] = tuple(METALS), least: int = 4, bond: str = "C=C") -> tuple[Column, Column, Column]:
    """(status, reason, fragment) by text rules in order of precedence.

    Metal in brackets: reject.  Isotope mark: keep without the mark's digits.  Several fragments: keep the last that is longer
    than ``least`` and has ``bond``, the whole if no fragment is.  Charge: reject.  Otherwise keep.
    """
    t = F.coalesce(text, F.lit(""))
    metal = t.rlike(r"\[\d*(" + "|".join(sorted(metals, key=lambda m: (-len(m), m))) + r")[^a-z]")
    isotope = t.rlike(r"\[\d+[A-Za-z]")
    parts = F.filter(F.split(t, r"\."), lambda p: (F.length(p) > least) & p.contains(bond))
    many = t.contains(".")
    charge = t.contains("+") | t.contains("-")
    reason = F.when(metal, "metal").when(isotope, "isotope").when(many, "fragments").when(charge, "charge").otherwise("clean")
    status = F.when(reason.isin("metal", "charge"), "reject").otherwise("keep")
    fragment = F.when(status == "reject", None).when(reason == "fragments", F.coalesce(F.try_element_at(parts, F.lit(-1)), t)).when(reason == "isotope", F.regexp_replace(t, r"\[\d+([A-Za-z])", "[$1")).otherwise(t)
    return status.alias("status"), reason.alias("reason"), fragment.alias("fragment")


def assign_ids(df: DataFrame, prefix: str, order_by: Sequence[str], width: int = 6, out: str = "assigned_id") -> DataFrame:
    """Zero-padded consecutive ids in a global order, without a single-partition window.

    A range shuffle puts the rows in order; each partition numbers its own and adds the rows before it.
    """
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    local = spool(ranged.withColumn("__id", F.monotonically_increasing_id()), "ids")
    place = F.shiftright("__id", 33)
    counts = local.groupBy(place.alias("__p")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("__p", before.alias("__before")))  # one row per partition
    number = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    named = local.withColumn("__p", place).join(offsets, "__p").withColumn(out, F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0")))
    return named.drop("__id", "__p", "__before")


def shape_report(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(name, n_rows, n_columns) of each frame."""
    each = [f.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.lit(len(f.columns)).alias("n_columns")) for name, f in frames.items()]
    return reduce(DataFrame.unionByName, each)
