"""Column-set operators: choosing, ordering and renaming columns by what their names say."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Roles:
    """Which source column plays each role of a reaction table; roles are named, never positional."""

    id: str
    reaction: str
    yield_num: str
    reagent: str
    catalyst: str
    reference: str
    link: str
    yield_text: str

    def check(self, columns: Sequence[str]) -> None:
        missing = [getattr(self, f.name) for f in fields(self) if getattr(self, f.name) not in columns]
        if missing:
            raise ValueError(f"columns not found: {missing}")


def apply_roles(df: DataFrame, roles: Roles) -> DataFrame:
    """Select the role columns under their role names."""
    roles.check(df.columns)
    return df.select(*[F.col(getattr(roles, f.name)).alias(f.name) for f in fields(roles)])


def drop_columns_like(df: DataFrame, phrases: Sequence[str], unless: Sequence[str] = ()) -> DataFrame:
    """Drop columns whose name contains any phrase, unless it also contains one of ``unless``."""
    gone = [c for c in df.columns if any(p in c for p in phrases) and not any(u in c for u in unless)]
    return df.drop(*gone)


def common_columns(frames: Sequence[DataFrame]) -> list[str]:
    """Columns present in every frame, in the first frame's order."""
    if not frames:
        return []
    shared = set.intersection(*[set(f.columns) for f in frames])
    return [c for c in frames[0].columns if c in shared]


def canonical_column_order(df: DataFrame, key: str) -> DataFrame:
    """Key first, then the others by name."""
    return df.select(key, *sorted(c for c in df.columns if c != key))


def sanitise_name(name: str, ascii_only: bool = False) -> str:
    """Keep word and Greek characters (or ASCII letters and digits only, the rest becoming ``_``)."""
    return re.sub(r"[^A-Za-z0-9]", "_", name) if ascii_only else re.sub(r"[^\wͰ-Ͽ]", "", name)


def sanitise_columns(df: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Rename all columns; two names that become one are an error."""
    new = [sanitise_name(c, ascii_only) for c in df.columns]
    if len(set(new)) < len(new):
        raise ValueError(f"names collide after cleaning: {sorted({c for c in new if new.count(c) > 1})}")
    return df.toDF(*new)


def numeric_only(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns, booleans as integers; ``keep`` stays as it is."""
    out = []
    for f in df.schema.fields:
        if f.name in keep or isinstance(f.dataType, T.NumericType):
            out.append(F.col(f"`{f.name}`"))
        elif isinstance(f.dataType, T.BooleanType):
            out.append(F.col(f"`{f.name}`").cast("int").alias(f.name))
    return df.select(*out)


def filter_columns(df: DataFrame, key: str, remove: Sequence[str] | None = None, limit: Sequence[str] | None = None) -> DataFrame:
    """Either leave out ``remove`` or keep only ``limit``; giving both or neither is an error."""
    if (remove is None) == (limit is None):
        raise ValueError("give exactly one of remove and limit")
    if remove is not None:
        return df.drop(*[c for c in remove if c != key])
    return df.select(key, *[c for c in limit if c != key])


def family_columns(columns: Sequence[str], families: Mapping[str, Sequence[str]], clean: bool = True) -> dict[str, list[str]]:
    """Columns of each family: names that contain a motif; a name goes to its first family only.

    Motifs are cleaned as column names are, so a motif with ``%`` still matches cleaned names.
    """
    out: dict[str, list[str]] = {f: [] for f in families}
    for c in columns:
        for family, motifs in families.items():
            if any((sanitise_name(m) if clean else m) in (sanitise_name(c) if clean else c) for m in motifs):
                out[family].append(c)
                break
    return out


def pair_long(df: DataFrame, key: str, fam_x: Sequence[str], fam_y: Sequence[str]) -> DataFrame:
    """(key, x_name, y_name, x, y): every x column against every y column."""
    pairs = F.array(*[F.struct(F.lit(x).alias("x_name"), F.lit(y).alias("y_name"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x in fam_x for y in fam_y])
    return df.select(key, F.explode(pairs).alias("p")).select(key, "p.*")


def melt(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long; all values as double."""
    columns = list(columns or [c for c in df.columns if c not in key])
    return df.select(*key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(key), columns, name, value)


def join_feature_blocks(blocks: Sequence[DataFrame], key: str, how: str = "inner") -> DataFrame:
    """Feature blocks side by side by key; a feature name that two blocks share is an error."""
    out, seen = blocks[0], set(blocks[0].columns)
    for b in blocks[1:]:
        clash = (seen & set(b.columns)) - {key}
        if clash:
            raise ValueError(f"blocks share features {sorted(clash)}")
        seen |= set(b.columns)
        out = out.join(b, key, how)
    return out


def union_common(frames: Mapping[str, DataFrame], key: str, target: str | None = None, drop_like: Sequence[str] = (), strict: bool = False) -> tuple[DataFrame, list[str]]:
    """Rows of all frames over their common columns, and the names of skipped frames.

    A frame that shares no feature with those before it is skipped (``strict``: takes part and may
    empty the set).  Key and target stay in the result.
    """
    fixed = [c for c in (key, target) if c]
    kept: list[DataFrame] = []
    skipped: list[str] = []
    shared: list[str] | None = None
    for name, frame in frames.items():
        own = [c for c in frame.columns if c not in fixed]
        both = own if shared is None else [c for c in shared if c in own]
        if not all(c in frame.columns for c in fixed) or (shared is not None and not both and not strict):
            skipped.append(name)
            continue
        shared = both
        kept.append(frame)
    if not kept:
        raise ValueError("no frame has the key and target columns")
    shared = [c for c in shared or [] if not any(p in c for p in drop_like)]
    out = kept[0].select(*fixed, *shared)
    for frame in kept[1:]:
        out = out.unionByName(frame.select(*fixed, *shared))
    return out, skipped


def categorise(value: Column, edges: Sequence[float] = (15.0, 40.0)) -> Column:
    """0 below the first edge, 1 up to the last edge, 2 above; NaN and null have no category."""
    low, high = edges
    return F.when(value.isNull() | F.isnan(value), None).when(value < low, 0).when(value <= high, 1).otherwise(2)
