"""Steps whose tasks must not grow with the table."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from scopespark.llm import bpe, ctw, suffixdedup, textkernel
from scopespark.operators import graph, learn
from scopespark.plans import lifecycles


def _chains(spark, n):
    """Graphs of four atoms in a row with the double bond in the middle."""
    pairs = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(a + 1).alias("dst"), F.lit(o).alias("bond_order")) for a, o in ((0, 1), (1, 2), (2, 1))])
    return spark.range(n).select(F.col("id").alias("mol_id"), F.explode(pairs).alias("b")).select("mol_id", "b.*")


def _exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]


def test_partitions_follow_the_rows(spark):
    dealt = graph.colocated(_chains(spark, 400), graph.parts_for(_chains(spark, 400), 100))
    assert dealt.rdd.getNumPartitions() == 12
    assert graph.colocated(_chains(spark, 4)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_graphs_are_dealt_once(spark):
    b = graph.colocated(_chains(spark, 20), 5).withColumn("aromatic", F.lit(False))
    atoms = b.select("mol_id", F.explode(F.array("src", "dst")).alias("atom_id")).distinct().withColumn("element", F.lit("C"))
    e, found = graph.undirected(b), graph.first_anchor(graph.anchors(b, atoms))
    near, edge = graph.neighbourhood(e, found, 1), graph.boundary(e, found, 1, max_walks=2)
    for df in (graph.walk_counts(e, found, 2), graph.break_partial_rings(b, near, edge), graph.motifs(b, found, 1, atoms)):
        assert df.count() > 0
        assert all("REPARTITION_BY_NUM" in x for x in _exchanges(df))


def _odd_bonds(spark):
    """Random graphs with several or no double bonds, bonds given twice, and null ids and marks."""
    g = np.random.default_rng(3)
    rows = [(int(m), int(a), int(a + d), int(o), bool(x)) for m, a, d, o, x in zip(*(g.integers(lo, hi, 600) for lo, hi in ((0, 60), (0, 9), (1, 4), (1, 3), (0, 2))))]
    rows += rows[:20] + [(None, 0, 1, 2, True), (None, 1, 2, 1, True), (2, 3, 4, 2, None), (70, 0, 1, 1, True)]
    return spark.createDataFrame(rows, "mol_id long, src int, dst int, bond_order int, aromatic boolean")


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_rings_around_anchors_equal_the_table_form(spark):
    b = graph.colocated(_odd_bonds(spark), 4)
    e, every = graph.undirected(b), graph.anchors(b)
    for found in (every, graph.first_anchor(every)):
        for r in (0, 1, 2):
            near, edge = graph.neighbourhood(e, found, r), graph.boundary(e, found, r)
            got = _rows(graph.break_rings_around(b, found, r))
            assert got == _rows(graph.break_partial_rings(b, near, edge)) and len(got) == b.count()
            around = graph.around(b, found, r, "inner").where("mol_id is not null")
            for table, own in ((near, around.selectExpr("mol_id", "inline(inside)")), (edge, around.selectExpr("mol_id", "explode(border) AS atom"))):
                assert _rows(own) == _rows(table.where("mol_id is not null").select(own.columns))


def test_anchors_are_counted_in_one_pass(spark):
    b = _odd_bonds(spark)
    found = graph.anchors(b)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    double = [r for r in b.collect() if r["bond_order"] == 2 and r["mol_id"] is not None]
    assert _rows(found.select("mol_id", "a", "b", "n")) == sorted(f"Row(mol_id={x['mol_id']}, a={x['src']}, b={x['dst']}, n={sum(y['mol_id'] == x['mol_id'] for y in double)})" for x in double)


def test_motifs_and_rings_pass_few_operators(spark):
    """Each one takes memory pages of its own in the single task that a graph passes."""
    b = graph.colocated(_chains(spark, 20), 5).withColumn("aromatic", F.lit(False))
    atoms = b.select("mol_id", F.explode(F.array("src", "dst")).alias("atom_id")).distinct().withColumn("element", F.lit("C"))
    found = graph.first_anchor(graph.anchors(b))
    for df, most in ((graph.motifs(b, found, 2, atoms), 25), (graph.break_rings_around(b, found, 2), 14)):
        tree = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert sum(" Sort [" in x or "Aggregate(" in x for x in tree.split("\n")) <= most
        assert df.count() == (20 if "motif_key" in df.columns else 60)


def test_walks_add_up_over_anchors(spark):
    e = graph.undirected(_chains(spark, 1))
    found = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "mol_id long, a int, b int")
    got = {(r["anchor"], r["atom"]): r["n"] for r in graph.walk_counts(e, found, 2).collect()}
    assert got == {(0, 0): 1, (0, 2): 1, (1, 1): 4, (1, 3): 2, (2, 0): 1, (2, 2): 2}


def test_cleaned_lines_broadcast_nothing(spark):
    """Files of lines are far smaller than the rows that they hold, and a broadcast passes the driver."""
    rows = spark.range(50).select("id", F.when(F.col("id") % 2 == 0, "C=CC=CC").otherwise("CC=C").alias("line"))
    out, _ = lifecycles.cleaned_lines(rows, "id", "line")
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 75


def test_shorter_chains_of_trees_share_a_fit(spark, monkeypatch):
    fits, fit = [], learn._fit
    monkeypatch.setattr(learn, "_fit", lambda rows, params, seed: fits.append(params) or fit(rows, params, seed))
    df = spark.range(40).selectExpr("id AS k", "cast(id % 5 AS double) AS a", "cast(id % 5 * 2 + id % 3 AS double) AS y")
    trials, _ = learn.tune_gbt(df, ["a"], "y", "k", {"maxDepth": [1], "maxIter": [1, 2]}, folds=2, repeats=1)
    assert len(fits) == 2
    got = {r["params"]: r["mse"] for r in trials.collect()}
    own, _ = learn.tune_gbt(df, ["a"], "y", "k", {"maxDepth": [1], "maxIter": [1]}, folds=2, repeats=1)
    assert abs(got[str({"maxDepth": 1, "maxIter": 1})] - own.first()["mse"]) < 1e-9


def test_a_solved_batch_of_grams_is_small():
    g = np.unique(np.random.default_rng(1).integers(0, 1 << 48, ctw.SOLVE, dtype=np.uint64))
    tracemalloc.start()
    ctw.climb(g, np.ones(len(g)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_blocks_of_texts_are_made_one_by_one():
    """No list of all rows of a batch stands beside the batch."""
    read = []
    texts = (read.append(i) or "Some  words of a text " * 500 for i in range(400))
    made = ctw.pieces(texts)
    lo, hi, rows = next(made)
    assert (lo, len(rows)) == (0, hi) and len(read) <= hi + 1 < 100
    assert hi + sum(len(x) for _, _, x in made) == 400


def test_counts_of_a_task_stay_in_their_arrays():
    keys = np.random.default_rng(2).integers(0, 1 << 63, 40_000, dtype=np.uint64) // np.uint64(1 << 48)
    sums, got, want = ctw.Sums(4000), [], {}
    for i in range(0, len(keys), 1000):
        some, n = np.unique(keys[i : i + 1000], return_counts=True)
        got += sums.put(some, n if i % 3000 else 0, n)
        for k, x in zip(some.tolist(), n.tolist()):
            old = want.get(k, (0, 0))
            want[k] = old[0] + (x if i % 3000 else 0), old[1] + x
    assert got and sums.held.shape == (3, 4000)
    got += sums.put(np.arange(9000, dtype=np.uint64) + np.uint64(1 << 62), 1, np.ones(9000, dtype=np.int64))
    want |= {(1 << 62) + i: (1, 1) for i in range(9000)}
    sums.add()
    total = {}
    for key, n, seen in (row for x in got + list(sums.out()) for row in x.T.tolist()):
        old = total.get(key, (0, 0))
        total[key] = old[0] + n, old[1] + seen
    assert total == want
    sums.add()
    assert not list(sums.out())


def test_words_of_many_texts_are_hashed_in_small_blocks():
    texts = [b"some words of a text " * 500] * 400
    textkernel._power("up", 1 << 18), textkernel._power("down", 1 << 18)
    tracemalloc.start()
    n = sum(len(h) for _, _, h, _ in textkernel.word_hashes(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400 * 2500 and peak < 20e6


def test_a_full_cache_keeps_the_pieces_met_again():
    cache = bpe.PieceCache({bytes([i]): i for i in range(256)} | {b"ab": 256}, 4)
    cache.learn({"ab", "x"})
    cache.learn({"ab", "y"})
    cache.learn({"z", "v"})
    assert set(cache) == {"ab", "z", "v"} and cache["ab"] == bpe.pack([256])
    cache.learn({"1", "2", "3", "4"})
    assert set(cache) == {"1", "2", "3", "4"}
    assert bpe.CACHE_PIECES <= 1 << 17


def test_anchors_are_found_in_small_pieces():
    """And are the same whatever the piece, where texts are shorter than it."""
    rows = [bytes(np.random.default_rng(i).integers(97, 123, 2000, dtype=np.uint8)) for i in range(300)]
    suffixdedup.anchors(rows[:200])
    tracemalloc.start()
    found = suffixdedup.anchors(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    each = [suffixdedup.anchors([x]) for x in rows]
    assert len(found[0]) == sum(len(x[0]) for x in each)
    assert all((np.concatenate(own) == whole).all() for own, whole in zip(list(zip(*each))[1:], found[1:]))
    assert peak < 10e6
