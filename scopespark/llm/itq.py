"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Unit vectors are rotated and cut at zero into binary codes; each rotation is learned on a bounded
sample so that the codes stay close to the rotated vectors and their bits are balanced.  Codes are
split into blocks with one table each.  Two vectors meet if some block differs in one bit at
most: every vector is listed under its own block value, and asks under its own value and under the
values with one more bit set, so a pair meets from one side exactly.  Each pair is taken in its first
such table only, filtered by the distance of whole codes, and reranked with the original vectors.

Vectors of each length are a group of their own.  The width of a block follows the logarithm of the
number of vectors, so that lists don't grow with it; pairs at the least cosine are made from the sample,
and the number of blocks is the smallest (up to BLOCKS) with which RECALL of them meet.  Where vectors share
a direction, codes of close vectors differ in more bits: then more and narrower blocks are taken, until
the made pairs meet.  The cut on whole codes lies six deviations beyond the made pairs.  Groups of under
TELLS vectors are compared as they are.

Equal vectors are one class from the start.  Vectors that are null, zero, or hold null or non-finite
components link with nothing.  Rows with a null id are vectors like others, but are never named: a
component without any id has none.  Rows that share an id each count.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopespark.llm.components import components
from scopespark.session import spool

#: Vectors that the rotations are learned from, at most; rounds of the alternation.
SAMPLE, ROUNDS = 20_000, 30
#: Least and largest width of a block; least and largest number of blocks.
WIDTHS, BLOCKS = (4, 28), (8, 64)
#: Share of made pairs that the tables have to find, and vectors that can tell.
RECALL, TELLS = 0.995, 100


def learn_rotations(sample: np.ndarray, bits: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(mean, d x bits projection): one ITQ rotation for each d bits, from different starts."""
    mean = sample.mean(axis=0)
    x = sample - mean
    d = x.shape[1]
    _, _, axes = np.linalg.svd(x, full_matrices=False) if len(x) >= d else (None, None, np.eye(d))
    v = x @ axes.T
    rng = np.random.default_rng(seed)
    parts = []
    for _ in range(-(-bits // d)):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(ROUNDS):
            code = np.where(v @ r >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(code.T @ v)
            r = (left @ right).T
        parts.append(axes.T @ r)
    return mean, np.concatenate(parts, axis=1)[:, :bits]


def block_codes(unit: np.ndarray, mean: np.ndarray, projection: np.ndarray, width: int) -> np.ndarray:
    """One number for each block of ``width`` bits."""
    on = (unit - mean) @ projection >= 0
    return on.reshape(len(on), -1, width).astype(np.int32) @ (1 << np.arange(width, dtype=np.int32))


def usable(vector: Column) -> Column:
    """Finite, without nulls, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """In double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def made_pairs(unit: np.ndarray, least: float, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at cosine ``least``: partners in any direction, and in the directions between vectors of the sample."""
    rng = np.random.default_rng(seed)
    x = unit[:4000]
    out = []
    for off in (rng.normal(size=x.shape), x[rng.permutation(len(x))] - x):
        off = off - (off * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(off, axis=1)
        ok = size > 1e-9
        out.append((x[ok], least * x[ok] + np.sqrt(1 - least**2) * off[ok] / size[ok, None]))
    return [p for p in out if len(p[0])]


def tables_for(sample: np.ndarray, count: int, least: float) -> tuple[np.ndarray, np.ndarray, int, int, float]:
    """(mean, projection, width, far, recall): tables for ``count`` vectors like those of the sample."""
    made = made_pairs(sample, least)
    wide = int(np.clip(2 * np.ceil(np.log2(max(count, 2)) / 2), *WIDTHS))
    for most in (BLOCKS[1] // 4, BLOCKS[1]):  # few rotations first
        mean, projection = learn_rotations(sample, most * wide)
        differ = [((x - mean) @ projection >= 0) != ((y - mean) @ projection >= 0) for x, y in made]
        for width in range(wide, (wide if most < BLOCKS[1] else WIDTHS[0]) - 1, -2):
            met = [(d[:, : most * width].reshape(len(d), -1, width).sum(axis=2) <= 1).cumsum(axis=1) > 0 for d in differ]
            share = np.min([m.mean(axis=0) for m in met], axis=0) if met else np.ones(most)
            blocks = next((k for k in range(BLOCKS[0], most + 1) if share[k - 1] >= RECALL), 0)
            if blocks:
                break
        if blocks:
            break
    blocks = blocks or most
    bits = [d[:, : blocks * width].sum(axis=1) for d in differ]
    far = int(max((b.mean() + 6 * b.std() for b in bits), default=blocks * width)) + 1
    return mean, projection[:, : blocks * width], width, far, float(share[blocks - 1])


def _confirmed(found: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    va, vb = classes.select(F.col("rep").alias("a"), F.col("vector").alias("va")), classes.select(F.col("rep").alias("b"), F.col("vector").alias("vb"))
    return found.join(va, "a").join(vb, "b").where(cosine(F.col("va"), F.col("vb")) >= least).select("a", "b")


def pairs_of(classes: DataFrame, count: int, least: float) -> DataFrame:
    """(a, b): linked pairs of ``count`` classes (rep, vector) of one vector length."""
    rows = classes.orderBy(F.xxhash64("vector")).limit(SAMPLE).select("vector").toPandas()
    sample = np.array(rows["vector"].tolist(), dtype=np.float64)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    mean, projection, width, far, _ = tables_for(sample, count, least)
    shared = classes.sparkSession.sparkContext.broadcast((mean, projection, width))

    @F.pandas_udf("array<int>")
    def code(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            x = np.array(part.tolist(), dtype=np.float64).reshape(len(part), -1)
            x /= np.linalg.norm(x, axis=1, keepdims=True) if len(x) else 1
            yield pd.Series(list(block_codes(x, *shared.value)) if len(x) else [], dtype=object)

    coded = spool(classes.withColumn("code", code("vector")), "codes")
    return near_pairs(coded, projection.shape[1] // width, width, far, least)


def near_pairs(coded: DataFrame, blocks: int, width: int, far: int, least: float) -> DataFrame:
    """(a, b): pairs of classes (rep, vector, code) that meet in a table and have at least that cosine."""
    listed = coded.select("rep", "code", F.posexplode("code").alias("t", "own"))
    index = listed.select("t", F.col("own").alias("key"), F.col("rep").alias("a"), F.col("code").alias("code_a"))
    more = F.filter(F.array(*[F.col("own").bitwiseOR(F.lit(1 << i)) for i in range(width)]), lambda k: k != F.col("own"))
    asked = listed.select("t", F.explode(F.concat(F.array("own"), more)).alias("key"), "own", F.col("rep").alias("b"), F.col("code").alias("code_b"))
    met = index.join(asked, ["t", "key"]).where((F.col("a") != F.col("b")) & ((F.col("key") != F.col("own")) | (F.col("a") < F.col("b"))))
    differ = F.zip_with("code_a", "code_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    met = met.withColumn("differ", differ)
    first = F.array_position(F.transform("differ", lambda d: d <= 1), True) - 1
    apart = F.aggregate("differ", F.lit(0), lambda s, d: s + d)
    found = met.where((apart <= far) & (F.col("t") == first)).select("a", "b")
    return _confirmed(found, coded, least)


def near_duplicates(vectors: DataFrame, least: float = 0.95, vec: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    rows = vectors.select(F.col(vec).alias("vec_id"), F.col(embedding).alias("vector"), usable(F.col(embedding)).alias("ok"))
    rows = rows.select("vec_id", F.when(F.col("ok"), F.col("vector")).alias("vector"))
    grouped = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("name"), F.count("*").alias("copies"))
    classes = spool(grouped.withColumn("rep", F.monotonically_increasing_id()), "classes")
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    length = F.size("vector")
    sizes = classes.groupBy(length.alias("d")).count()
    large = {r["d"]: r["count"] for r in sizes.where(F.col("count") >= TELLS).collect()}
    small = classes.select("rep", "vector", length.alias("d")).join(sizes.where((F.col("count") > 1) & (F.col("count") < TELLS)).select("d"), "d")
    few = small.select("d", F.col("rep").alias("a"), F.col("vector").alias("va")).join(small.select("d", F.col("rep").alias("b"), F.col("vector").alias("vb")), "d")
    direct = few.where(F.col("a") < F.col("b")).where(cosine(F.col("va"), F.col("vb")) >= least).select("a", "b")
    pairs = spool(reduce(DataFrame.union, [pairs_of(classes.where(length == d), n, least) for d, n in sorted(large.items())], direct), "pairs")
    count = classes.select(F.col("rep").alias("b"), "copies")
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(count, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
    found = components(pairs, "a", "b").withColumnRenamed("node", "rep")
    told = classes.join(linked, "rep", "left").join(found, "rep", "left").select("vector", "name", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    names = told.groupBy("c").agg(F.min("name").alias("component_id"))
    told = told.join(names, "c").select("vector", "n_links", "component_id")
    rest = rows.where("vector is not null").join(told, "vector").select("vec_id", "n_links", "component_id")
    return rest.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def sql(least: float = 0.95) -> str:
    """DuckDB SQL: all pairs, and components by reaching outward."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {least}),
    r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
    SELECT e.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = e.vec_id) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
    FROM embeddings e JOIN c ON c.a = e.vec_id"""
