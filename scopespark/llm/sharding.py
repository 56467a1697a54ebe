"""Shards along a Hilbert curve over several metadata columns.

Each column is quantised into bins of near equal row counts, whose bounds are exact quantiles of the
column's distinct values; the bins of a row are a point on a grid, and rows are put in the order in
which a Hilbert curve visits the grid.  Runs of that order with near equal bytes are the shards, so a
file holds a compact region and its column ranges prune well for predicates on any of the columns.

A null falls into the first bin.  Rows equal in all sort keys are interchangeable; repeated rows each get a
slot; texts of any length count whole.  Other columns are carried along whatever their names, except that
``curve``, ``shard`` and ``slot`` are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scopespark.session import spool

#: Bits of each dimension: at most 2**BITS bounds of a column reach the driver.
BITS = 5


def running_totals(df: DataFrame, order: Sequence[str], weight: str) -> DataFrame:
    """``df`` with ``before_rows`` and ``before_weight``: totals over all rows that sort earlier.

    One range shuffle; each partition adds up by itself and then takes the offset of its place from
    a table with one row per partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def add_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = total = 0
        for part in parts:
            w = part[weight].to_numpy(dtype=np.int64)
            sums = np.cumsum(w)
            yield part.assign(before_rows=np.arange(rows, rows + len(w)), before_weight=total + sums - w)
            rows += len(w)
            total += int(sums[-1]) if len(w) else 0

    schema = T.StructType([*ranged.schema.fields, T.StructField("before_rows", T.LongType()), T.StructField("before_weight", T.LongType())])
    local = spool(ranged.mapInPandas(add_up, schema), "running")
    places = local.groupBy("part").agg((F.max("before_rows") + 1).alias("n"), F.max(F.col("before_weight") + F.col(weight)).alias("w"))
    earlier = [F.coalesce(F.expr(f"sum({c}) over (order by part rows between unbounded preceding and 1 preceding)"), F.lit(0)).alias(f"{c}0") for c in ("n", "w")]
    offsets = F.broadcast(places.select("part", *earlier))  # one row per partition
    return local.join(offsets, "part").select(*df.columns, (F.col("before_rows") + F.col("n0")).alias("before_rows"), (F.col("before_weight") + F.col("w0")).alias("before_weight"))


def bin_bounds(df: DataFrame, column: str, bits: int = BITS) -> list:
    """Lower bounds of at most 2**bits bins with near equal row counts, from all distinct values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    ran = running_totals(counts, [column], "n")
    total = F.broadcast(ran.agg(F.sum("n").alias("total")))
    binned = ran.crossJoin(total).select(column, F.expr(f"before_weight * {1 << bits} div total").alias("bin"))
    return sorted(r[0] for r in binned.groupBy("bin").agg(F.min(column).alias("low")).select("low").collect())


def bin_of(column: Column, bounds: list) -> Column:
    """Number of the bin that holds a value; null is in the first."""
    if not bounds:
        return F.lit(0)
    low = F.array(*[F.lit(b) for b in bounds])
    return F.greatest(F.coalesce(F.size(F.filter(low, lambda b: b <= column)), F.lit(0)) - 1, F.lit(0))


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each point (one row of ``bits``-bit coordinates).

    Skilling's transform: undo the excess work of each level from the top bit down, Gray-encode, then
    interleave the bits of the axes.
    """
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0]) ^ swap
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where(x[-1] & (1 << level), flip ^ ((1 << level) - 1), flip)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            out = out << 1 | ((axis ^ flip) >> level & 1)
    return out


def hilbert_column(bins: Sequence[Column], bits: int = BITS) -> Column:
    """Curve position of the point given by the bin columns."""

    @F.pandas_udf("long")
    def position(*axes: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([a.to_numpy() for a in axes], axis=1), bits))

    return position(*bins)


def hilbert_shards(rows: DataFrame, dimensions: Sequence[str], size: str, ties: Sequence[str], shards: int, bits: int = BITS) -> DataFrame:
    """``rows`` with ``curve``, ``shard`` and ``slot``: runs of the curve with near equal ``size`` sums.

    A row belongs to the shard in which the middle of its stretch of bytes falls, so a boundary is off
    by half a row at most.  ``ties`` order the rows of one grid cell.
    """
    names = rows.columns
    own = {c: f"__c{i}" for i, c in enumerate(names)}  # no name of the caller's meets one of ours
    rows, dimensions, size, ties = rows.toDF(*own.values()), [own[c] for c in dimensions], own[size], [own[c] for c in ties]
    bins = [bin_of(F.col(c), bin_bounds(rows, c, bits)) for c in dimensions]
    placed = running_totals(rows.withColumn("curve", hilbert_column(bins, bits)), ["curve", *ties], size)
    total = F.broadcast(placed.agg(F.sum(size).alias("total")))  # one row
    shard = F.least(F.expr(f"(2 * before_weight + {size}) * {shards} div (2 * total)"), F.lit(shards - 1)).cast("int")
    cut = placed.crossJoin(total).withColumn("shard", shard).drop("total", "before_weight")
    first = F.broadcast(cut.groupBy("shard").agg(F.min("before_rows").alias("first")))  # one row per shard
    slots = cut.join(first, "shard").withColumn("slot", F.col("before_rows") - F.col("first"))
    new = ("curve", "shard", "slot")
    return slots.select(*[F.col(own[c]).alias(c) for c in names if c not in new], *new)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; its files hold runs of slots in order, and a large shard is written by many tasks."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def sql(shards: int = 24, bits: int = BITS) -> str:
    """DuckDB SQL of the registered query: the same transform, one subquery a step."""
    dims = ("lang", "source", "n_chars")
    ctes = ["crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(0, 8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"]
    for c in dims:
        ctes.append(f"""low_{c} AS (SELECT list(low) AS lows FROM (SELECT min(v) AS low FROM (SELECT v, (sum(n) OVER (ORDER BY v) - n) * {1 << bits} // sum(n) OVER () AS bin
            FROM (SELECT {c} AS v, count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY 1)) GROUP BY bin))""")
    bin_ = lambda c: f"greatest(coalesce(len(list_filter((SELECT lows FROM low_{c}), lambda b: b <= {c})), 0) - 1, 0)"
    ctes.append(f"""s0 AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
        xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
        {", ".join(f"CAST({bin_(c)} AS BIGINT) AS x{i}" for i, c in enumerate(dims))} FROM documents, crc)""")
    step, keep, n = 0, "doc_id, size, text_crc32", len(dims)

    def add(exprs: dict[int, str]) -> None:
        nonlocal step
        cols = ", ".join(f"{exprs.get(i, f'x{i}')} AS x{i}" for i in range(n))
        ctes.append(f"s{step + 1} AS (SELECT {keep}, {cols} FROM s{step})")
        step += 1

    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            swap = f"(xor(x0, x{i}) & {low})"
            moved = {0: f"CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {low}) ELSE xor(x0, {swap}) END"}
            if i:
                moved[i] = f"CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, {swap}) END"
            add(moved)
    for i in range(1, n):
        add({i: f"xor(x{i}, x{i - 1})"})
    flip = "0"
    for level in range(bits - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN x{n - 1} & {1 << level} <> 0 THEN {(1 << level) - 1} ELSE 0 END)"
    add({i: f"xor(x{i}, {flip})" for i in range(n)})
    places = [f"((x{i} >> {level}) & 1) << {level * n + n - 1 - i}" for level in range(bits) for i in range(n)]
    ctes.append(f"""placed AS (SELECT *, sum(size) OVER w - size AS before, row_number() OVER w - 1 AS r, sum(size) OVER () AS total FROM (SELECT {keep}, {" + ".join(f"({p})" for p in places)} AS curve FROM s{step})
        WINDOW w AS (ORDER BY curve, doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING))""")
    ctes.append(f"cutted AS (SELECT *, CAST(least((2 * before + size) * {shards} // (2 * total), {shards - 1}) AS INTEGER) AS shard FROM placed)")
    return f"""WITH {", ".join(ctes)}
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
      CAST(r - min(r) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(curve AS BIGINT) AS curve FROM cutted"""
