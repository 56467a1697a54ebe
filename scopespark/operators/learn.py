"""Boosted-tree tuning and evaluation on hash folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopespark.operators.grouped import vote
from scopespark.session import spool


def _assembled(df: DataFrame, features: Sequence[str], label: str, key: str) -> DataFrame:
    wide = df.select(key, F.col(label).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in features if c != key])
    rows = wide.where(F.col("label").isNotNull() & ~F.isnan("label"))
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(rows).select(key, "label", "features")


def fold_of(key: str, folds: int, seed: int):
    """Deterministic fold from a seeded hash: the same rows on any partitioning."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int")


def _fit(rows: DataFrame, params: Mapping[str, object], seed: int):
    return GBTRegressor(featuresCol="features", labelCol="label", seed=seed, **params).fit(rows)


def tune_gbt(df: DataFrame, features: Sequence[str], label: str, key: str, grid: Mapping[str, Sequence], folds: int = 5, repeats: int = 7, parallel: int = 4) -> tuple[DataFrame, DataFrame]:
    """(trials, best): mean squared error of every grid point and repeat, and the voted parameters."""
    rows = spool(_assembled(df, features, label, key), "assembled").persist()
    names = list(grid)
    points = [dict(zip(names, p)) for p in product(*grid.values())]
    # a chain of trees holds all shorter chains, so points that differ in the number of trees alone share a fit
    chains: dict[str, list[int]] = {}
    for i, p in enumerate(points):
        chains.setdefault(str({n: v for n, v in p.items() if n != "maxIter"}), []).append(i)
    trees = lambda i: points[i].get("maxIter", 0)

    def mse(job: tuple[int, list[int], int]) -> list[tuple[int, int, float]]:
        repeat, own, fold = job
        split = rows.withColumn("fold", fold_of(key, folds, repeat))
        model = _fit(split.where(F.col("fold") != fold), points[max(own, key=trees)], repeat)
        found = model.evaluateEachIteration(split.where(F.col("fold") == fold), "squared")  # the mean squared error after each tree
        return [(repeat, i, found[(trees(i) or len(found)) - 1]) for i in own]

    with ThreadPoolExecutor(parallel) as pool:
        found = [x for some in pool.map(mse, [(r, own, f) for r in range(repeats) for own in chains.values() for f in range(folds)]) for x in some]
    rows.unpersist()
    spark = df.sparkSession
    trials, won = [], []
    for r in range(repeats):
        mean = {i: sum(m for q, j, m in found if (q, j) == (r, i)) / folds for i in range(len(points))}
        trials += [(r, str(points[i]), float(m)) for i, m in mean.items()]
        best = min(mean, key=lambda i: (mean[i], i))
        won += [(n, str(points[best][n]), r, isinstance(points[best][n], (int, float))) for n in names]
    votes = vote(spark.createDataFrame(won, "param string, value string, seen int, numeric boolean"))
    return spark.createDataFrame(trials, "repeat int, params string, mse double"), votes


def evaluate_gbt(df: DataFrame, features: Sequence[str], label: str, key: str, params: Mapping[str, object], folds: int = 5, repeats: int = 10, seed: int = 42, parallel: int = 4) -> tuple[DataFrame, DataFrame]:
    """((metric, repeat, fold, value), (feature, importance, rank)): fold and test r2 of an 80/20 hash split.

    Repeats differ in the seed of the folds and trees; importances are the mean over repeats.
    """
    rows = spool(_assembled(df, features, label, key).withColumn("part", fold_of(key, 5, seed)), "assembled").persist()
    train, test = rows.where("part <> 0"), rows.where("part = 0")
    evaluator = RegressionEvaluator(metricName="r2", labelCol="label")

    def run(job: tuple[int, int]) -> tuple[tuple, list[float]]:
        repeat, f = job
        if f < 0:
            model, held = _fit(train, params, seed + repeat), test
        else:
            inner = train.withColumn("fold", fold_of(key, folds, seed + 1 + repeat))
            model, held = _fit(inner.where(F.col("fold") != f), params, seed + repeat), inner.where(F.col("fold") == f)
        metric = ("test_r2" if f < 0 else "cv_r2", repeat, f, float(evaluator.evaluate(model.transform(held))))
        return metric, model.featureImportances.toArray().tolist() if f < 0 else []

    with ThreadPoolExecutor(parallel) as pool:
        found = list(pool.map(run, [(r, f) for r in range(repeats) for f in range(-1, folds)]))
    rows.unpersist()
    importances = [i for _, i in found if i]
    mean = [sum(x) / len(importances) for x in zip(*importances)]
    ranked = sorted(zip(features, mean), key=lambda x: (-x[1], x[0]))
    spark = df.sparkSession
    return (
        spark.createDataFrame([m for m, _ in found], "metric string, repeat int, fold int, value double"),
        spark.createDataFrame([(n, v, i + 1) for i, (n, v) in enumerate(ranked)], "feature string, importance double, rank int"),
    )
