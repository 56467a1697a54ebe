"""Hand-worked small frames: one or more for each operator whose rule needs pinning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scopespark.functions import columns as C
from scopespark.functions.text import jaro_winkler_one
from scopespark.operators import clean, features, graph, grouped, learn, lookup, sampling
from scopespark.streaming.screening import screen_stream


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_representative(spark):
    rows = [
        ("R1", 1, "C=CC>>X", "70", "Mn salen complex"), ("R1", 2, "C=CC>>X", "90", "Mn(salen) complex"), ("R1", 3, "C=CC>>X", "10", None), ("R1", 4, "C=CC>>X", "50", "Fe porphyrin"),
        ("R3", 1, "C=C>>CC", "120", None), ("R4", 1, "C=C>>CC", "n/a", None), ("R5", 1, "C=CO>>X", "bad", "A"), ("R5", 2, "C=CO>>X", "60", "B"), ("R5", 3, "C=CO>>X", "60", "C"),
    ]
    df = spark.createDataFrame(rows, "id string, ord int, reaction string, y string, cat string")
    out = grouped.representative(df, "id", "y", "cat", ["ord"]).select("id", "label", "mean_value")
    assert values(out) == [("R1", "Mn(salen) complex", 80.0), ("R5", "B", 60.0)]


def test_jaro_winkler():
    assert round(jaro_winkler_one("Mn salen complex", "Mn(salen) complex"), 4) == 0.8986
    assert round(jaro_winkler_one("None", "Mn(salen) complex"), 4) == 0.5392
    assert jaro_winkler_one("", "x") == 0 and jaro_winkler_one("x", "x") == 1


def test_align_yield(spark):
    rows = [(None, "85 percent"), (None, "85.5 percent"), (None, "80 percent; 90 percent"), (None, "good"), ("70; 85", None), ("0; 0", None), ("42", None)]
    df = spark.createDataFrame(rows, "n string, t string").select(clean.align_yield(F.col("n"), F.col("t")).alias("v"))
    assert [r.v for r in df.collect()] == [85.0, 85.5, 80.0, None, 85.0, 0.0, 42.0]


def test_split_routes(spark):
    rows = [
        ("S1", 1, "C=CC>>X", 60.0, "NaOCl", "Jacobsen cat"), ("S1", 2, "C=CC>>X", 80.0, "Bleach; Mn salt", None), ("S1", 3, "C=CC>>X", 10.0, "NaOCl", None),
        ("S2", 1, "C=C.O>>X", 90.0, "NaOCl", "Mn salen"), ("S3", 1, "C=CO>>X", 50.0, "mCPBA", None), ("S4", 1, "C=CN>>X", 30.0, "NaOCl; water", None),
    ]
    df = spark.createDataFrame(rows, "id string, ord int, reaction string, yield double, reagent string, catalyst string")
    told = grouped.split_routes(df, "NaOCl", ["naocl", "bleach"], {"Mn": ["Mn", "Jacobsen"]}, ["ord"], carry=["ord"])
    assert values(told.select("route", "id", "reagents", "ord")) == [("NaOCl", "S1", "", 3), ("NaOCl", "S4", "water", 4 - 3), ("NaOCl + Mn", "S1", "", 2)]
    out = grouped.split_routes(df, "NaOCl", ["naocl", "bleach"], {"Mn": ["Mn", "Jacobsen"]}, ["ord"])
    assert values(out.select("route", "id", "smiles", "mean_value")) == [("NaOCl", "S1", "C=CC", 10.0), ("NaOCl", "S4", "C=CN", 30.0), ("NaOCl + Mn", "S1", "C=CC", 70.0)]


def test_union_common_and_columns(spark):
    t1, t2, t3 = (spark.createDataFrame([tuple(range(len(c)))], c) for c in (["k", "a", "b", "c"], ["k", "b", "a"], ["z"]))
    out, skipped = C.union_common({"t1": t1, "t2": t2, "t3": t3}, "k")
    assert out.columns == ["k", "a", "b"] and out.count() == 2 and skipped == ["t3"]
    assert C.drop_columns_like(t1, ["a", "b"], unless=["b"]).columns == ["k", "b", "c"]
    assert C.common_columns([t1, t2]) == ["k", "a", "b"]
    with pytest.raises(ValueError):
        C.filter_columns(t1, "k")
    with pytest.raises(ValueError):
        C.sanitise_columns(spark.createDataFrame([(1, 2)], ["a%", "a"]))
    assert C.family_columns(["Vbur_1", "x"], {"s": ["%Vbur"]}) == {"s": ["Vbur_1"]}


def test_groups_masks_lookup(spark):
    g = spark.createDataFrame([("g1", "x"), ("g1", "y.z"), ("g2", "x")], "g string, v string")
    assert values(clean.exclude_groups_where(g, "g", F.col("v").contains("."))) == [("g2", "x")]
    m = spark.createDataFrame([("x", "a"), ("y", "a"), ("x", "a"), ("y", "b"), ("z", "b"), ("x", "c"), (None, "c")], "k string, c string")
    assert values(grouped.membership_mask(m, "k", "c")) == [("x", 5), ("y", 3), ("z", 2)]
    left, right = spark.createDataFrame([("p",), ("q",), ("r",)], "k string"), spark.createDataFrame([("p", 1, 1), ("p", 9, 2), ("q", 2, 3)], "k string, v int, o int")
    assert values(lookup.lookup(left, right, "k", "v", ["o"])) == [("p", 1), ("q", 2), ("r", 0)]


def test_classify_scope(spark):
    back = spark.createDataFrame([("p",), ("q",), ("r",)], "key string")
    scope = spark.createDataFrame([("A", "p", 50.0), ("A", "q", 49.9), ("A", "s", 99.0)], "chemistry string, key string, yield double")
    assert values(lookup.classify_scope(back, scope, [50]).select("key", "class")) == [("p", "highlight"), ("q", "hollow"), ("r", "grey")]


def test_categorise_and_nulls(spark):
    df = spark.createDataFrame([(14.9,), (15.0,), (40.0,), (40.1,), (float("nan"),)], "v double").select(C.categorise(F.col("v")).alias("c"))
    assert [r.c for r in df.collect()] == [0, 1, 1, 2, None]
    n = spark.createDataFrame([(1, 1.0, 1.0), (2, float("nan"), 2.0), (3, None, float("nan")), (4, 4.0, 4.0)], "k int, u double, v double")
    assert values(clean.null_report(n, "k")) == [("u", 2), ("u", 3), ("v", 3)]


def test_screen(spark, tmp_path):
    rows = ["[Pd]C=C", "[13CH2]=C", "[13CH2]=C[O-]", "C=CCC.CCO", "C=CC.CCO", "C=C[O-]", "C=CC"]
    out = spark.createDataFrame([(r,) for r in rows], "t string").select(*clean.screen_records(F.col("t"))).collect()
    assert [r.status for r in out] == ["reject", "keep", "keep", "keep", "keep", "reject", "keep"]
    assert [r.reason for r in out] == ["metal", "isotope", "isotope", "fragments", "fragments", "charge", "clean"]
    assert out[1].fragment == "[CH2]=C" and out[3].fragment == "C=CCC" and out[4].fragment == "C=CC.CCO"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(rows[:4]))
    screen_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    (tmp_path / "in" / "b.txt").write_text("\n".join(rows[4:]))
    screen_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out" / "keep")).count() == 5 and spark.read.parquet(str(tmp_path / "out" / "reject")).count() == 2


def test_feature_selection(spark):
    d = [3, 1, 2, 6, 5, 4]
    df = spark.createDataFrame([(i, float(i), 2.0 * i + 1, float(i**3), float(d[i - 1]), 7.0) for i in range(1, 7)], "k int, a double, b double, c double, d double, e double")
    kept, audit = features.select_features(df, "k")
    assert kept.columns == ["k", "a", "d"] and audit.count() == 3


def test_elbow_and_shift(spark):
    curve = spark.createDataFrame([(2, 100.0), (4, 40.0), (6, 25.0), (8, 20.0), (10, 18.0)], "k int, cost double")
    assert grouped.elbow(curve, "k", "cost").first()["k"] == 4
    whole = spark.createDataFrame([(float(x),) for x in (0, 1, 1, 2, 5, 5, 6, 9, 10, 10)], "x double")
    part = spark.createDataFrame([(5.0,), (5.0,), (6.0,)], "x double")
    assert math.isclose(sampling.kl_shift(whole, part, ["x"], 5)[0].first()["kl"], 7.514257, abs_tol=1e-5)
    assert abs(sampling.kl_shift(whole, whole, ["x"])[0].first()["kl"]) < 1e-12


def test_automatic_bins_are_numpys(spark):
    rng = np.random.default_rng(3)
    for values_ in (rng.uniform(size=3000), rng.normal(size=2000) ** 3, np.repeat([1.0, 2.0, 5.0], [900, 60, 40]), np.full(7, 2.0), rng.integers(0, 9, 500).astype(float)):
        whole = spark.createDataFrame([(float(x),) for x in values_], "x double").repartition(3)
        q = sampling.quartiles(whole.select(F.lit("x").alias("feature"), "x")).first()
        assert q.q == pytest.approx(np.quantile(values_, [0.25, 0.75]).tolist()) and (q.lo, q.hi, q.n) == (values_.min(), values_.max(), len(values_))
        kl, table = sampling.kl_shift(whole, whole, ["x"])
        edges = np.histogram_bin_edges(values_, "auto")
        assert kl.first()["n_bins"] == len(edges) - 1
        counts = np.histogram(values_, edges)[0]
        if len(edges) > 2:
            p = [r.p for r in table.orderBy("bin").collect()]
            filled = np.where(counts > 0, counts, 1e-5 * counts[counts > 0].min())
            assert p == pytest.approx((filled / filled.sum()).tolist(), abs=2 / len(values_))


def test_pca_is_numpys(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 3
    rows = [(i, *map(float, v), 7.0) for i, v in enumerate(x)]
    odd = [(900, None, 1.0, 1.0, 1.0, 7.0), (901, float("nan"), 100.0, 1.0, 1.0, 7.0)]  # take no part in the fit
    df = spark.createDataFrame(rows + odd, "k int, a double, b double, c double, d double, e double")
    model = features.pca(df, ["a", "b", "c", "d", "e"], 3)
    z = np.concatenate([(x - x.mean(axis=0)) / x.std(axis=0), np.zeros((200, 1))], axis=1)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    assert model.variance == pytest.approx(s[:3] ** 2 / 199) and np.abs(model.components) == pytest.approx(np.abs(v[:3]), abs=1e-9)
    assert all(p[np.abs(p).argmax()] > 0 for p in model.components)
    out = features.explained(spark, model).orderBy("pc").collect()
    assert [r.ratio for r in out] == pytest.approx((s[:3] ** 2 / (s**2).sum()).tolist())
    scores = {r.k: (r.PCA1, r.PCA2) for r in features.scores(df, model, 2, 11.0).collect()}
    assert [scores[i] for i in range(200)] == [pytest.approx(tuple(p)) for p in z @ model.components[:2].T + 11]
    load = features.loadings(spark, model).where("pc = 1").orderBy("rank").collect()
    want = model.components[0] * np.sqrt(model.variance[0])
    assert [r.loading for r in load] == pytest.approx(sorted(want, key=lambda w: -abs(w)))
    both = features.family_pca(df.where("k < 900"), {"first": ["a", "b"], "rest": ["c", "d"]}, 1)
    own = features.pca(df.where("k < 900"), ["a", "b"], 1)
    assert [r.first_PCA1 for r in both.orderBy("k").collect()] == pytest.approx((z[:, :2] @ own.components[0]).tolist())


def test_kmeans_finds_clear_groups(spark):
    rng = np.random.default_rng(6)
    centres = np.array([(0, 0), (40, 0), (0, 40), (40, 40)])
    rows = [(i, int(i % 4), *map(float, centres[i % 4] + rng.normal(size=2))) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, g int, x double, y double")
    found = features.kmeans(df, ["x", "y"], 4).select("g", "cluster").distinct().collect()
    assert len(found) == 4 and len({r.cluster for r in found}) == 4
    labels, curve = features.kmeans_elbow(df, ["x", "y"], scale=0.2, trials=2)
    cost = {r.k: r.cost for r in curve.collect()}
    assert sorted(cost) == [2, 4, 6, 8, 10] and labels.select("cluster").distinct().count() == 4 and cost[4] < cost[2]
    with pytest.raises(ValueError):
        features.kmeans_elbow(df, ["x", "y"], scale=0.2, most=2)


def test_trees(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(a), float(b), float(10.0 * (a > 0.5) + b / 100)) for i, (a, b) in enumerate(rng.uniform(size=(300, 2)))]
    df = spark.createDataFrame([*rows, (999, 0.5, 0.5, None), (998, None, 0.5, 1.0)], "k int, a double, b double, y double")
    trials, votes = learn.tune_gbt(df, ["a", "b"], "y", "k", {"maxDepth": [1, 2], "maxIter": [1, 2]}, folds=2, repeats=2)
    assert trials.count() == 8 and {r[0] for r in votes.collect()} == {"maxDepth", "maxIter"}
    metrics, ranked = learn.evaluate_gbt(df, ["a", "b"], "y", "k", {"maxDepth": 1, "maxIter": 2}, folds=2, repeats=2)
    assert metrics.count() == 6 and metrics.where("value < 0.6").count() == 0
    first = ranked.orderBy("rank").first()
    assert first.feature == "a" and first.importance > 0.9


def test_stratified_sample(spark):
    rows = [(f"a{i}", "a", 10.0 * i) for i in range(6)] + [(f"b{i}", "b", 15.0 + i) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, s string, v double")
    mask = spark.createDataFrame([("a0",), ("a1",)], "k string")
    out = sampling.stratified_sample(df, "k", "s", "v", [0, 15, 30, 45, 60, 75, 90, 100], 5, mask).collect()
    assert sum(r.s == "a" for r in out) == 3 and sum(r.s == "b" for r in out) == 2 and not {r.k for r in out} & {"a0", "a1"}


def _graph(spark, bonds):
    return spark.createDataFrame([(1, a, b, o) for a, b, o in bonds], "mol_id int, src int, dst int, bond_order int")


M1 = [(0, 1, 1), (1, 2, 1), (2, 3, 2), (3, 4, 1), (4, 5, 1)]
M2 = [(0, 1, 2), (1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1), (0, 5, 1), (2, 6, 1), (6, 7, 1)]


def test_graph_m1_m2(spark):
    for bonds, boundary, network, paths, ring in ((M1, {0, 5}, {0, 1, 2, 3, 4, 5}, {2: 1, 3: 1}, False), (M2, {3, 4, 6}, {0, 1, 2, 3, 4, 5, 6}, {0: 1, 1: 2}, True)):
        b = _graph(spark, bonds)
        e, found = graph.undirected(b), graph.first_anchor(graph.anchors(b))
        assert {r.atom for r in graph.boundary(e, found, 2).collect()} == boundary
        assert {r.atom for r in graph.neighbourhood(e, found, 2).collect()} == network
        assert {r.anchor: r.n_paths for r in graph.path_counts(e, found, 2).collect()} == paths
        assert graph.in_ring(e, found).first()["in_ring"] is ring
    w = graph.walk_counts(graph.undirected(_graph(spark, M1)), graph.first_anchor(graph.anchors(_graph(spark, M1))), 2).where("anchor = 2")
    assert {r.atom: r.n for r in w.collect()} == {0: 1, 2: 2, 4: 1}


def test_large_ring_and_long_system(spark):
    ring = _graph(spark, [(i, (i + 1) % 44, 2 if i == 0 else 1) for i in range(44)])
    e = graph.undirected(ring)
    assert graph.in_ring(e, graph.first_anchor(graph.anchors(ring))).first()["in_ring"] is True
    assert {r.system for r in graph.ring_systems(e.where("a < 40 and b < 40")).collect()} == {0}
    bits = graph.neighbourhood_bits(ring, spark.createDataFrame([(1, i, "C") for i in range(44)], "mol_id int, atom_id int, element string"))
    assert bits.count() == 1 + 2 + 3  # from round to round the double bond is seen from farther off


def test_knockout_and_motif_key(spark):
    m3 = _graph(spark, [(0, 1, 2), (1, 2, 1), (2, 3, 2)])
    out = values(graph.knockout_variants(m3, graph.anchors(m3)).select("variant", "src", "bond_order"))
    assert out == [(1, 0, 2), (1, 1, 1), (1, 2, 1), (2, 0, 1), (2, 1, 1), (2, 2, 2)]
    m1 = _graph(spark, M1)
    turned = _graph(spark, [(5 - b, 5 - a, o) for a, b, o in M1])
    keys = [graph.motifs(x, graph.first_anchor(graph.anchors(x)), 2).first()["motif_key"] for x in (m1, turned)]
    assert keys[0] == keys[1]


def test_break_partial_rings(spark):
    ring = spark.createDataFrame([(1, 0, 1, 2, True), (1, 1, 2, 1, True), (1, 0, 2, 1, True), (1, 3, 4, 2, True)], "mol_id int, src int, dst int, bond_order int, aromatic boolean")
    inside = spark.createDataFrame([(1, 0), (1, 3), (1, 4)], "mol_id int, atom int")
    edge = spark.createDataFrame([(1, 0), (1, 3)], "mol_id int, atom int")
    assert values(graph.break_partial_rings(ring, inside, edge).select("src", "dst", "bond_order", "aromatic")) == [(0, 1, 1, False), (0, 2, 1, False), (1, 2, 1, False), (3, 4, 2, True)]
