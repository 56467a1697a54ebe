"""Boosted regression trees with squared, absolute and Huber loss, as a chain of MLlib's single trees.

MLlib's own boosting knows two losses and counts its first tree in full.  Here the chain starts from the constant that
is best for the loss; every tree is fitted to the loss's negative gradient, its leaves are estimated anew for
the loss, and it counts by the learning rate.  Predictions after any number of trees come from one chain.

Medians and quantiles are exact and spread over the cluster (``sampling.quartiles``), and only one number for each leaf reaches
the driver.  Predictions are kept in memory and on disk and checkpointed every CHECKPOINT trees, so a lost executor costs
a bounded chain.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopespark.operators.grouped import vote
from scopespark.operators.learn import fold_of
from scopespark.operators.sampling import quartiles
from scopespark.session import cut, spool

# The grid that is searched where none is given.
GRID = {
    "n_estimators": (50, 100, 150, 200, 250),
    "max_depth": (2, 3, 4, 5, 6),
    "criterion": ("friedman_mse", "squared_error"),
    "loss": ("squared_error", "absolute_error", "huber"),
}
CHECKPOINT = 10


@dataclass
class Boosted:
    """A chain: its constant, learning rate, and for each tree the model and the value of each leaf."""

    start: float
    rate: float
    trees: list[tuple[DecisionTreeRegressionModel, list[float]]] = field(default_factory=list)

    def importances(self, features: Sequence[str]) -> list[tuple[str, float]]:
        """(feature, share), largest first: mean of the trees' importances."""
        total = np.sum([m.featureImportances.toArray() for m, _ in self.trees], axis=0)
        share = total / total.sum() if total.sum() else total
        return sorted(zip(features, map(float, share)), key=lambda x: (-x[1], x[0]))


def assembled(df: DataFrame, features: Sequence[str], label: str, key: str) -> DataFrame:
    """(key, label, features): rows with a label and without a missing feature."""
    wide = df.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    rows = wide.where(F.col("label").isNotNull() & ~F.isnan("label"))
    return VectorAssembler(inputCols=[f"x{i}" for i in range(len(features))], outputCol="features", handleInvalid="skip").transform(rows).select("key", "label", "features")


def _quantile(rows: DataFrame, value: Column, point: float) -> float:
    long = rows.select(F.lit("all").alias("feature"), value.alias("x"))
    return quartiles(long, (point,)).first()["q"][0]


def _leaf_values(rows: DataFrame, loss: str, delta: float | None) -> dict[int, float]:
    """Value of each leaf of (leaf, r), r being what is left to explain."""
    if loss == "squared_error":
        found = rows.groupBy("leaf").agg(F.avg("r").alias("v"))
        return {r["leaf"]: r["v"] for r in found.collect()}  # a row for each leaf
    medians = quartiles(rows.select(F.col("leaf").alias("feature"), F.col("r").alias("x")), (0.5,)).select(F.col("feature").alias("leaf"), F.col("q")[0].alias("m"))
    if loss == "absolute_error":
        return {r["leaf"]: r["m"] for r in medians.collect()}
    off = F.col("r") - F.col("m")
    found = rows.join(F.broadcast(medians), "leaf").groupBy("leaf").agg((F.first("m") + F.avg(F.signum(off) * F.least(F.abs(off), F.lit(delta)))).alias("v"))  # a row for each leaf
    return {r["leaf"]: r["v"] for r in found.collect()}


def _moved(rows: DataFrame, model: DecisionTreeRegressionModel, values: Sequence[float], rate: float) -> DataFrame:
    """Rows (key, label, features, f) with ``f`` moved on by a tree."""
    step = F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("leaf").cast("int") + 1)
    return model.transform(rows).select("key", "label", "features", (F.col("f") + rate * step).alias("f"))


def fit(rows: DataFrame, loss: str = "squared_error", trees: int = 100, depth: int = 3, rate: float = 0.1, alpha: float = 0.9, bins: int = 64, seed: int = 42) -> Boosted:
    """Chain of ``trees`` trees on rows (key, label, features).

    ``alpha`` is the share of the rows that the Huber loss treats as squared; ``bins`` bounds the splits that are
    tried for a feature (all of them where it has fewer values).
    """
    if loss not in GRID["loss"]:
        raise ValueError(f"loss {loss} is none of {GRID['loss']}")
    start = rows.agg(F.avg("label")).first()[0] if loss == "squared_error" else _quantile(rows, F.col("label"), 0.5)
    chain = Boosted(start, rate)
    now = rows.select("key", "label", "features", F.lit(float(start)).alias("f")).persist()
    for t in range(trees):
        r, delta = F.col("label") - F.col("f"), None
        slope = r
        if loss == "absolute_error":
            slope = F.signum(r)
        elif loss == "huber":
            delta = _quantile(now, F.abs(r), alpha)
            slope = F.signum(r) * F.least(F.abs(r), F.lit(delta))
        tree = DecisionTreeRegressor(featuresCol="features", labelCol="slope", leafCol="leaf", maxDepth=depth, maxBins=bins, seed=seed + t)
        model = tree.fit(now.select("features", slope.alias("slope")))
        model.setLeafCol("leaf")
        left = model.transform(now).select(F.col("leaf").cast("int").alias("leaf"), r.alias("r"))
        found = _leaf_values(left, loss, delta)
        values = [found.get(i, 0.0) for i in range(2**depth)]
        chain.trees.append((model, values))
        last, now = now, _moved(now, model, values, rate)
        now = (cut(now) if (t + 1) % CHECKPOINT == 0 else now).persist()
        now.count()
        last.unpersist()
    now.unpersist()
    return chain


def staged(chain: Boosted, rows: DataFrame, counts: Sequence[int]) -> DataFrame:
    """(key, label, at_<count>...): predictions after each number of trees."""
    now = rows.select("key", "label", "features", F.lit(float(chain.start)).alias("f"))
    kept: list[str] = []
    for t, (model, values) in enumerate(chain.trees):
        step = F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("leaf").cast("int") + 1)
        now = model.transform(now).select("key", "label", "features", *kept, (F.col("f") + chain.rate * step).alias("f"))
        if t + 1 in counts:
            kept.append(f"at_{t + 1}")
            now = now.withColumn(kept[-1], F.col("f"))
        if (t + 1) % CHECKPOINT == 0:
            now = cut(now)
    return now.select("key", "label", *kept)


def tune(df: DataFrame, features: Sequence[str], label: str, key: str, grid: Mapping[str, Sequence] = GRID, folds: int = 5, repeats: int = 7, parallel: int = 4, **fixed) -> tuple[DataFrame, DataFrame]:
    """(trials, votes): mean squared error over the folds of every grid point and repeat, and the voted parameters.

    One chain of the largest number of trees answers for all smaller ones.  Both criteria rate a split by the same
    figure, the weighted squared difference of the two means, so they share their chains.
    """
    rows = spool(assembled(df, features, label, key), "assembled").persist()
    counts = sorted(grid["n_estimators"])
    shared = [(d, loss) for d in grid["max_depth"] for loss in grid["loss"]]

    def run(job: tuple[int, int, int, str]) -> dict[tuple, float]:
        repeat, fold, depth, loss = job
        split = rows.withColumn("fold", fold_of("key", folds, repeat))
        chain = fit(split.where(F.col("fold") != fold).drop("fold"), loss, counts[-1], depth, seed=repeat, **fixed)
        held = staged(chain, split.where(F.col("fold") == fold).drop("fold"), counts)
        row = held.agg(*[F.avg(F.pow(F.col("label") - F.col(f"at_{n}"), F.lit(2.0))) for n in counts]).first()
        return {(repeat, n, depth, loss, fold): row[i] for i, n in enumerate(counts)}

    with ThreadPoolExecutor(parallel) as pool:
        found = {k: v for part in pool.map(run, [(r, f, d, loss) for r in range(repeats) for f in range(folds) for d, loss in shared]) for k, v in part.items()}
    rows.unpersist()
    trials, won = [], []
    names = list(grid)
    for r in range(repeats):
        means = []
        for values in product(*grid.values()):
            p = dict(zip(names, values))
            error = [found[(r, p["n_estimators"], p["max_depth"], p["loss"], f)] for f in range(folds)]
            means.append((float(np.mean([e for e in error if e is not None])), p))
        trials += [(r, *map(str, p.values()), m) for m, p in means]
        best = min(means, key=lambda x: x[0])[1]  # of equal ones the first in the grid's order
        won += [(n, str(v), r, isinstance(v, (int, float))) for n, v in best.items()]
    spark = df.sparkSession
    votes = vote(spark.createDataFrame(won, "param string, value string, seen int, numeric boolean"))
    return spark.createDataFrame(trials, f"repeat int, {', '.join(f'{n} string' for n in names)}, mse double"), votes


def r2(held: DataFrame, column: str) -> float | None:
    """Share of the label's variance that ``column`` explains; null for a constant label."""
    mean = held.agg(F.avg("label")).first()[0]
    left, total = held.agg(F.sum(F.pow(F.col("label") - F.col(column), F.lit(2.0))), F.sum(F.pow(F.col("label") - F.lit(mean), F.lit(2.0)))).first()
    return 1 - left / total if total else None


def evaluate(df: DataFrame, features: Sequence[str], label: str, key: str, params: Mapping[str, object], folds: int = 5, repeats: int = 10, seed: int = 42, parallel: int = 4, **fixed) -> tuple[DataFrame, DataFrame]:
    """((metric, repeat, fold, value), (repeat, feature, importance, rank)) of a hash split of 80 to 20.

    ``cv_r2`` of each fold of the larger part, ``test_r2`` of the smaller one for a chain on the larger; repeats differ in
    the seeds of folds and trees.
    """
    rows = spool(assembled(df, features, label, key).withColumn("part", fold_of("key", 5, seed)), "assembled").persist()
    train, test = rows.where("part <> 0").drop("part"), rows.where("part = 0").drop("part")
    n = int(params["n_estimators"])

    def run(job: tuple[int, int]) -> tuple[tuple, list]:
        repeat, f = job
        inner = train.withColumn("fold", fold_of("key", folds, seed + 1 + repeat))
        own, held = (train, test) if f < 0 else (inner.where(F.col("fold") != f).drop("fold"), inner.where(F.col("fold") == f).drop("fold"))
        chain = fit(own, str(params["loss"]), n, int(params["max_depth"]), seed=seed + repeat, **fixed)
        value = r2(staged(chain, held, [n]), f"at_{n}")
        ranked = [(repeat, name, share, i + 1) for i, (name, share) in enumerate(chain.importances(features))]
        return ("test_r2" if f < 0 else "cv_r2", repeat, f, value), ranked if f < 0 else []

    with ThreadPoolExecutor(parallel) as pool:
        found = list(pool.map(run, [(r, f) for r in range(repeats) for f in range(-1, folds)]))
    rows.unpersist()
    spark = df.sparkSession
    return (
        spark.createDataFrame([m for m, _ in found], "metric string, repeat int, fold int, value double"),
        spark.createDataFrame([i for _, ranked in found for i in ranked], "repeat int, feature string, importance double, rank int"),
    )
