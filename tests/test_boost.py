"""Boosted chains against NumPy, staged predictions, the search grid, plans of the graph operators, and empty inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scopespark.functions.columns import union_common
from scopespark.operators import boost, features, graph, grouped


def _split(x, g):
    """(feature, threshold) of the largest drop in squared error, or none."""
    best, gain = None, 1e-9
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for a, b in zip(values, values[1:]):
            left = x[:, j] <= (a + b) / 2
            drop = left.sum() * (~left).sum() / len(g) * (g[left].mean() - g[~left].mean()) ** 2
            if drop > gain:
                best, gain = (j, (a + b) / 2), drop
    return best


def _leaves(x, g, depth, rows):
    s = _split(x[rows], g[rows]) if depth and len(rows) > 1 else None
    if s is None:
        return [rows]
    left = x[rows, s[0]] <= s[1]
    return _leaves(x, g, depth - 1, rows[left]) + _leaves(x, g, depth - 1, rows[~left])


def numpy_chain(x, y, loss, trees, depth, rate=0.1, alpha=0.9):
    f = np.full(len(y), y.mean() if loss == "squared_error" else np.median(y))
    out = []
    for _ in range(trees):
        r = y - f
        delta = np.quantile(np.abs(r), alpha)
        g = {"squared_error": r, "absolute_error": np.sign(r), "huber": np.sign(r) * np.minimum(np.abs(r), delta)}[loss]
        f = f.copy()
        for rows in _leaves(x, g, depth, np.arange(len(y))):
            m = np.median(r[rows])
            f[rows] += rate * {"squared_error": r[rows].mean(), "absolute_error": m, "huber": m + (np.sign(r[rows] - m) * np.minimum(np.abs(r[rows] - m), delta)).mean()}[loss]
        out.append(f)
    return out


def _data(spark, n=160):
    rng = np.random.default_rng(8)
    x = np.stack([rng.integers(0, 9, n), rng.integers(0, 12, n), rng.integers(0, 5, n)], axis=1).astype(float)
    y = 3 * (x[:, 0] > 4) + 0.5 * x[:, 1] * (x[:, 2] > 2) + rng.normal(size=n)
    y[::17] += 25
    df = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "k int, a double, b double, c double, y double")
    return x, y, df


@pytest.mark.parametrize("loss", boost.GRID["loss"])
def test_chain_is_numpys(spark, loss, monkeypatch):
    monkeypatch.setattr(boost, "CHECKPOINT", 2)
    x, y, df = _data(spark)
    rows = boost.assembled(df, ["a", "b", "c"], "y", "k")
    told = boost.staged(boost.fit(rows, loss, trees=3, depth=2), rows, [1, 3]).orderBy("key").collect()
    want = numpy_chain(x, y, loss, 3, 2)
    assert [r["at_1"] for r in told] == pytest.approx(want[0].tolist())
    assert [r["at_3"] for r in told] == pytest.approx(want[2].tolist())


def test_missing_values_and_unknown_loss(spark):
    _, _, df = _data(spark, 30)
    odd = df.union(spark.createDataFrame([(900, None, 1.0, 1.0, 2.0), (901, 1.0, 1.0, 1.0, None), (902, float("nan"), 1.0, 1.0, 2.0)], df.schema))
    rows = boost.assembled(odd, ["a", "b", "c"], "y", "k")
    assert rows.count() == 30
    with pytest.raises(ValueError):
        boost.fit(rows, "quantile")
    same = boost.assembled(df.withColumn("y", F.lit(4.0)), ["a", "b", "c"], "y", "k")
    assert {r["at_2"] for r in boost.staged(boost.fit(same, "huber", trees=2, depth=2), same, [2]).collect()} == {4.0}


def test_search_and_evaluation(spark):
    x, y, df = _data(spark)
    grid = {"n_estimators": (1, 3), "max_depth": (1,), "criterion": boost.GRID["criterion"], "loss": ("squared_error", "huber")}
    trials, votes = boost.tune(df, ["a", "b", "c"], "y", "k", grid, folds=2, repeats=2)
    got = {(r["repeat"], r["n_estimators"], r["criterion"], r["loss"]): r["mse"] for r in trials.collect()}
    assert len(got) == 16
    assert all(got[(r, n, "friedman_mse", loss)] == got[(r, n, "squared_error", loss)] for r in (0, 1) for n in "13" for loss in grid["loss"])
    assert all(got[(r, "3", "squared_error", loss)] < got[(r, "1", "squared_error", loss)] for r in (0, 1) for loss in grid["loss"])
    assert dict(map(tuple, votes.collect()))["n_estimators"] == "3" and dict(map(tuple, votes.collect()))["criterion"] == "friedman_mse"
    # the error of one fold by hand
    fold = {r["k"]: r["f"] for r in df.select("k", boost.fold_of("k", 2, 0).alias("f")).collect()}
    own = []
    for f in (0, 1):
        train = np.array([i for i in range(len(y)) if fold[i] != f])
        test = np.array([i for i in range(len(y)) if fold[i] == f])
        mean = y[train].mean()
        j, t = _split(x[train], y[train] - mean)
        side = lambda i: x[i, j] <= t  # noqa: B023, E731
        value = {s: (y[train][side(train) == s] - mean).mean() for s in (True, False)}
        own.append(np.mean([(y[i] - mean - 0.1 * value[bool(side(i))]) ** 2 for i in test]))
    assert got[(0, "1", "squared_error", "squared_error")] == pytest.approx(np.mean(own))
    metrics, ranked = boost.evaluate(df, ["a", "b", "c"], "y", "k", {"n_estimators": 3, "max_depth": 2, "loss": "squared_error"}, folds=2, repeats=2)
    assert metrics.count() == 6 and metrics.where("metric = 'test_r2'").count() == 2
    assert {r["repeat"]: round(r["s"], 6) for r in ranked.groupBy("repeat").agg(F.sum("importance").alias("s")).collect()} == {0: 1.0, 1: 1.0}


@pytest.mark.parametrize("rows", [[], [(1, None, 1.0)]])
def test_projection_needs_a_complete_row(spark, rows):
    with pytest.raises(ValueError, match="complete"):
        features.pca(spark.createDataFrame(rows, "k int, a double, b double"), ["a", "b"])


def test_elbow_needs_points(spark):
    with pytest.raises(Exception, match="no points"):
        grouped.elbow(spark.createDataFrame([], "k int, cost double"), "k", "cost").collect()


def test_strict_union_shrinks_to_nothing(spark):
    one, two = spark.createDataFrame([(1, 2)], "k int, a int"), spark.createDataFrame([(3, 4)], "k int, b int")
    out, skipped = union_common({"one": one, "two": two}, "k", strict=True)
    assert out.columns == ["k"] and out.count() == 2 and skipped == []


def test_graphs_are_shuffled_once(spark):
    """From bonds dealt out by graph, motifs and shells need no exchange of their own."""
    bonds = spark.range(200).selectExpr("id div 4 as mol_id", "id % 4 as src", "id % 4 + 1 as dst", "if(id % 3 = 0, 2, 1) as bond_order")
    near = graph.colocated(bonds)
    found = graph.first_anchor(graph.anchors(near))
    for df in (graph.motifs(near, found, 2), graph.shells(graph.undirected(near), found, 2)[1], graph.neighbourhood_bits(near, near.select("mol_id", F.col("src").alias("atom_id"), F.lit("C").alias("element")))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_COL") > 0
