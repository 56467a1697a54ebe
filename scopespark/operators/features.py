"""Feature filters, projections and clustering; rows stay distributed, d x d results are driver-side."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopespark.functions.columns import family_columns
from scopespark.operators import lloyd
from scopespark.operators.grouped import elbow
from scopespark.session import spool


def _spread(f: Callable[[Column], Column], x: Column) -> Column:
    """Variance or deviation of ``x``, which partial sums can leave slightly above 0 for a constant."""
    return F.when(F.min(x) < F.max(x), f(x)).otherwise(F.when(F.count(x) > 0, 0.0))


def variances(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Population variances in one pass; exactly 0 where all values are equal, whatever the rounding."""
    row = df.agg(*[_spread(F.var_pop, F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] if row[i] is not None else 0.0 for i, c in enumerate(columns)}


def remove_by_variance(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> list[str]:
    """Columns whose variance exceeds the threshold."""
    v = variances(df, columns)
    return [c for c in columns if v[c] > threshold]


def _vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(wide).select("features")


def corr_values(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> np.ndarray:
    return Correlation.corr(_vectors(df, columns), "features", method).first()[0].toArray()


def corr_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """(i, j, r) for every pair of columns; d x d rows."""
    r = corr_values(df, columns, method)
    rows = [(a, b, float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "i string, j string, r double")


def greedy_prune(r: np.ndarray, names: Sequence[str], threshold: float) -> tuple[list[str], list[tuple[str, str, float]]]:
    """Left to right, a kept feature absorbs every later one with |r| above the threshold.

    Returns the kept names and (dropped, kept_by, r); NaN never drops.
    """
    dropped: dict[int, tuple[str, str, float]] = {}
    for i in range(len(names)):
        if i not in dropped:
            for j in range(i + 1, len(names)):
                if j not in dropped and abs(r[i, j]) > threshold:
                    dropped[j] = (names[j], names[i], float(r[i, j]))
    return [n for k, n in enumerate(names) if k not in dropped], list(dropped.values())


def select_features(df: DataFrame, key: str, columns: Sequence[str] | None = None, threshold: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Zero variance, then Pearson, then Spearman; (frame with key and kept features, audit)."""
    columns = list(columns or [c for c in df.columns if c != key])
    df = spool(df.select(key, *columns), "features")  # read by each of the three stages
    kept = remove_by_variance(df, columns)
    audit: list[tuple[str, str, str | None, float | None]] = [("variance", c, None, 0.0) for c in columns if c not in kept]
    for method in ("pearson", "spearman"):
        if len(kept) > 1:
            kept, gone = greedy_prune(corr_values(df, kept, method), kept, threshold)
            audit += [(method, name, by, r) for name, by, r in gone]
    report = df.sparkSession.createDataFrame(audit, "stage string, feature string, kept_by string, score double")
    return df.select(key, *kept), report


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean 0 and population deviation 1; a constant column becomes 0.  The moments are one row."""
    moments = df.agg(*[f(F.col(c).cast("double")).alias(f"__{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", partial(_spread, F.stddev_pop)))])
    joined = df.crossJoin(F.broadcast(moments))  # one row
    scaled = {c: F.when(F.col(f"__s{i}") > 0, (F.col(c) - F.col(f"__m{i}")) / F.col(f"__s{i}")).otherwise(F.when(F.col(c).isNotNull(), 0.0)) for i, c in enumerate(columns)}
    return joined.withColumns(scaled).select(*df.columns)


class Pca:
    """Means, deviations, components (k x d, rows with fixed sign) and variances (sample) of a fit."""

    def __init__(self, names: list[str], mean: np.ndarray, dev: np.ndarray, components: np.ndarray, variance: np.ndarray, total: float):
        self.names, self.mean, self.dev, self.components, self.variance, self.total = names, mean, dev, components, variance, total


def pca(df: DataFrame, columns: Sequence[str], k: int | None = None) -> Pca:
    """Standardised PCA from one pass over the rows: the correlation matrix is the scaled covariance.

    Only rows without a null or NaN in any of the columns take part.  The sign of a component is fixed by its
    largest absolute entry (first by name on ties).
    """
    columns = list(columns)
    numbers = [F.col(c).cast("double") for c in columns]
    df = df.where(reduce(lambda a, b: a & b, [x.isNotNull() & ~F.isnan(x) for x in numbers]))
    if df.isEmpty():
        raise ValueError("no row is complete in all columns")
    # one vector aggregate in place of some hundred column aggregates, too many to be compiled together
    metrics = Summarizer.metrics("mean", "variance", "min", "max", "count").summary(F.col("features"))
    s = _vectors(df, columns).agg(metrics.alias("s")).first()["s"]
    mean, n = s["mean"].toArray(), s["count"]
    varied = s["max"].toArray() > s["min"].toArray()
    dev = np.where(varied, np.sqrt(s["variance"].toArray() * (n - 1) / n), 0.0)
    r = np.zeros((len(columns), len(columns)))
    if varied.any():
        own = [c for c, v in zip(columns, varied) if v]
        r[np.ix_(varied, varied)] = corr_values(df, own) if len(own) > 1 else np.ones((1, 1))
    value, vector = np.linalg.eigh(r * n / max(n - 1, 1))
    order = np.argsort(-value)[: k or len(columns)]
    parts = vector[:, order].T
    names = np.argsort(columns)
    for p in parts:
        top = max(names, key=lambda i: round(abs(p[i]), 9))
        p *= 1 if p[top] >= 0 else -1
    return Pca(columns, mean, dev, parts, np.maximum(value[order], 0), float(np.trace(r)) * n / max(n - 1, 1))


def explained(spark, model: Pca) -> DataFrame:
    rows = [(i + 1, float(v), float(v / model.total) if model.total else 0.0) for i, v in enumerate(model.variance)]
    return spark.createDataFrame(rows, "pc int, variance double, ratio double")


def loadings(spark, model: Pca) -> DataFrame:
    """(feature, pc, loading, rank): components times the root of their variance, ranked by size."""
    rows = []
    for i, (p, v) in enumerate(zip(model.components, model.variance)):
        load = p * np.sqrt(v)
        ranked = sorted(range(len(load)), key=lambda j: (-abs(load[j]), model.names[j]))
        rows += [(model.names[j], i + 1, float(load[j]), rank + 1) for rank, j in enumerate(ranked)]
    return spark.createDataFrame(rows, "feature string, pc int, loading double, rank int")


def scores(df: DataFrame, model: Pca, n: int = 2, offset: float = 0.0, prefix: str = "PCA") -> DataFrame:
    """``df`` with the first ``n`` scores, as plain arithmetic inside code generation."""
    z = [F.when(F.lit(bool(s > 0)), (F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s) or 1.0)).otherwise(F.lit(0.0)) for c, m, s in zip(model.names, model.mean, model.dev)]
    cols = {}
    for i in range(min(n, len(model.components))):
        total = F.lit(float(offset))
        for x, w in zip(z, model.components[i]):
            total = total + x * F.lit(float(w))
        cols[f"{prefix}{i + 1}"] = total
    return df.withColumns(cols)


def family_pca(df: DataFrame, families: Mapping[str, Sequence[str]], n: int = 1, offset: float = 0.0) -> DataFrame:
    """``df`` with the scores of a PCA per family as ``<family>_PCA1``..."""
    for family, columns in family_columns(df.columns, families).items():
        if columns:
            df = scores(df, pca(df, columns, n), n, offset, f"{family}_PCA")
    return df


def _points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumn("__features", array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))


def kmeans(df: DataFrame, columns: Sequence[str], k: int, seed: int = 42, out: str = "cluster") -> DataFrame:
    points = _points(df, columns)
    return KMeans(k=k, seed=seed, featuresCol="__features", predictionCol=out).fit(points).transform(points).drop("__features")


def kmeans_elbow(df: DataFrame, columns: Sequence[str], scale: float = 0.25, trials: int = 8, seed: int = 42, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(labels, curve): mean cost of ``trials`` runs for each k between scale * sqrt(n) and sqrt(n), step 2.

    More than ``most`` values of k are an error: the rule grows with the rows, so a large table needs a
    larger ``scale`` or a larger bound, and the caller has to say which.
    """
    points = spool(_points(df, columns), "points").persist()
    n = points.count()
    root = int(np.sqrt(n))
    ks = list(range(max(int(root * scale), 2), root + 1, 2)) or [2]
    if len(ks) > most:
        raise ValueError(f"{len(ks)} values of k to try, more than {most}")

    def cost(job: tuple[int, int]) -> tuple[int, float]:
        k, s = job
        return k, KMeans(k=k, seed=s, featuresCol="__features").fit(points).summary.trainingCost

    fits = [(k, s) for k in ks for s in range(trials)]
    values, places = lloyd.gathered(points, "__features", len(columns)) if n * len(columns) <= lloyd.MOST_VALUES else (np.empty(0), None)
    if len(values) and np.isfinite(values).all():
        # a fit of MLlib is some thirty jobs, whatever the rows; a fit inside one task is one task
        runs = [(k, c) for (k, _), c in zip(fits, lloyd.training_costs(points, values, places, fits))]
    else:  # more points than a task may hold, or such as MLlib refuses; as many fits at once as there are cores
        with ThreadPoolExecutor(max(4, df.sparkSession.sparkContext.defaultParallelism)) as pool:
            runs = list(pool.map(cost, fits))
    points.unpersist()
    rows = [(k, float(np.mean([c for q, c in runs if q == k]))) for k in ks]
    curve = df.sparkSession.createDataFrame(rows, "k int, cost double")
    best = elbow(curve, "k", "cost").first()
    return kmeans(df, columns, best["k"] if best else ks[0], seed), curve


def to_columns(df: DataFrame, key: str, vector: str, prefix: str, n: int) -> DataFrame:
    """An array or vector column as ``n`` double columns."""
    array = F.col(vector) if df.schema[vector].dataType.typeName() == "array" else vector_to_array(F.col(vector))
    return df.select(key, *[F.get(array, F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(n)])
