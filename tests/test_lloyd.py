"""k-means fits inside one task against MLlib's."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans

from scopespark.operators import features, lloyd


def _frame(spark, values, parts):
    names = [f"x{i}" for i in range(values.shape[1])]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], "k int, " + ", ".join(f"{n} double" for n in names))
    return df.repartition(parts, "k").sortWithinPartitions("k"), names


@pytest.mark.parametrize("kind", ["normal", "grid", "few", "sparse", "wide"])
def test_costs_are_mllibs(spark, kind):
    """Ties on a grid, points that come often, fewer points than clusters, and rows for MLlib's other solver."""
    g = np.random.default_rng(8)
    values = {
        "normal": g.normal(size=(1500, 2)) * [3, 1],
        "grid": np.repeat(g.integers(0, 12, (200, 2)), 3, axis=0),
        "few": np.repeat(g.normal(size=(5, 2)), 30, axis=0),
        "sparse": g.normal(size=(400, 2)) * (g.uniform(size=(400, 2)) < 0.3),
        "wide": g.normal(size=(300, 6)) + 20,
    }[kind]
    df, names = _frame(spark, values, 3)
    points = features._points(df, names).persist()
    fits = [(2, 0), (12, 1), (30, 2), (30, -7)]
    got = lloyd.training_costs(points, *lloyd.gathered(points, "__features", len(names)), fits)
    want = [KMeans(k=k, seed=s, featuresCol="__features").fit(points).summary.trainingCost for k, s in fits]
    points.unpersist()
    assert got == pytest.approx(want, rel=1e-9, abs=1e-20)


def test_elbow_is_one_fit_of_mllib(spark, monkeypatch):
    """The trials take one Spark job together; only the labels come from a fit of many jobs."""
    df, names = _frame(spark, np.random.default_rng(9).normal(size=(150, 2)), 2)
    fits = []

    class Counted(KMeans):
        def fit(self, *args):
            fits.append(1)
            return super().fit(*args)

    monkeypatch.setattr(features, "KMeans", Counted)
    labels, curve = features.kmeans_elbow(df, names, trials=2)
    assert len(fits) == 1 and curve.count() == 5 and labels.count() == 150
    monkeypatch.setattr(lloyd, "MOST_VALUES", 299)  # all trials by MLlib
    again, same = features.kmeans_elbow(df, names, trials=2)
    assert len(fits) == 12
    assert [r.cost for r in curve.orderBy("k").collect()] == pytest.approx([r.cost for r in same.orderBy("k").collect()])
    assert {tuple(r) for r in labels.collect()} == {tuple(r) for r in again.collect()}


def test_points_that_mllib_refuses_stay_refused(spark):
    df, names = _frame(spark, np.array([[1.0, 2.0], [np.nan, 1.0], [3.0, 1.0], [2.0, 2.0]]), 1)
    with pytest.raises(Exception, match="NaN"):
        features.kmeans_elbow(df, names, trials=1)


def test_draws_are_sparks(spark):
    for seed in (0, 42, -7, 2**31 - 1):
        theirs = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed)
        assert lloyd.draws(seed, 70).tolist() == [theirs.nextDouble() for _ in range(70)]
        assert lloyd.first_seed(seed) == spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    assert len(lloyd.draws(1, 0)) == 0


def test_closest_looks_at_all_that_may_be():
    g = np.random.default_rng(10)
    for values in (g.exponential(size=(3000, 2)), g.normal(size=(1200, 5)), np.ones((1100, 2))):
        points, centres = lloyd.Points(values, [len(values)]), values[g.integers(0, len(values), 60)] + 0.01
        squared = ((points.x[:, None] - centres) ** 2).sum(axis=2)
        at, least = points.closest(centres)
        assert len(points.ends) > 2 and sorted(points.order) == list(range(len(values))) and (points.x == values[points.order]).all()
        assert least == pytest.approx(squared.min(axis=1)) and squared[range(len(at)), at] == pytest.approx(squared.min(axis=1))
