"""Hard negatives against all scores, trees against all rows of a block, odd rows."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scopespark.llm import covertree

SCHEMA = "vec_id long, embedding array<double>, label int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, step=10):
    rows = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (a, v, y) in enumerate(rows):
        if a % step:
            continue
        scores = [(-sum(p * q for p, q in zip(v, w)), i, z) for k, (i, w, z) in enumerate(rows) if k != n and len(w) == len(v)]
        for s, p, _ in sorted((s, i, z) for s, i, z in scores if z == y)[:5]:
            hard = sorted((t, i) for t, i, z in scores if z != y and 80 * -s <= 100 * -t <= 100 * -s)[:5]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, step=10, schema=SCHEMA):
    found = covertree.hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % step == 0)
    return sorted(tuple(r[c] for c in COLUMNS) for r in found.collect())


def _clusters(n, d, seed):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    return [(i, [round(x + rng.gauss(0, 0.3), 3) for x in centers[rng.randrange(6)]], rng.randrange(3)) for i in range(n)]


def test_mined_equal_all_scores(spark):
    rows = _clusters(300, 4, 1)
    assert mined(spark, rows) == brute(rows)


def test_small_blocks_copies_and_cells(spark, monkeypatch):
    """Many cells, blocks, chunks and leaves, and a group of copies that fills several blocks."""
    for name, value in (("PER_CELL", 20), ("BLOCK", 16), ("CHUNK", 8), ("LEAF", 2), ("BRANCH", 3)):
        monkeypatch.setattr(covertree, name, value)
    rows = _clusters(150, 3, 2)
    rows += [(1000 + i, [0.5, 0.25, -0.5], i % 2) for i in range(80)]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [1.0, 0.3], 2), (2, [1.0, 0.3], 2), (3, None, 1), (4, [1.0, nan], 1), (5, [inf, 0.0], 2), (6, [None, 1.0], 2), (None, [1.0, 0.5], 2), (7, [1.0, 0.5], None)]
    rows += [(10, [1.0], 1), (11, [1.0], 1), (12, [1.0], 2), (20, [], 1), (21, [], 1), (22, [], 2), (30, [0.0, 0.0], 1), (40, [-1.0, 0.0], 5), (0, [1.0, 0.5], 1)]
    assert mined(spark, [(*r, 3, 4, "e") for r in rows], schema=SCHEMA + ", own int, d int, v string") == brute(rows)
    huge = [(50, [1e300, 0.0], 1), (51, [1e9, 0.0], 1), (60, [2.0, 0.0], 1)]
    assert mined(spark, rows + huge) == brute(rows + huge[2:])  # squared lengths beyond a long take no part
    assert mined(spark, []) == []


def test_large_numbers_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(2**20)) for _ in range(3)], i % 3) for i in range(60)]
    assert mined(spark, rows) == brute(rows)


def test_descent_skips_and_stays_exact():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 6)) * 200
    x = np.floor(centers[rng.integers(0, 12, 800)] + rng.normal(size=(800, 6)) * 5).astype(np.int64)
    m = float((x.astype(float) ** 2).sum(axis=1).max())
    labels, own = rng.integers(0, 3, 800), np.arange(800)
    tree = covertree.build(x, own, labels, own, m)
    full = x[:50] @ x.T
    high = full[np.arange(50), rng.integers(0, 800, 50)]
    low = np.floor(high * 0.8).astype(np.int64)
    ids, score, _ = covertree.descend(tree, x[:50], own[:50], labels[:50], np.zeros(50, dtype=bool), low, high, 5, m)
    for p in range(50):
        want = sorted((-int(full[p, j]), j) for j in range(800) if labels[j] != labels[p] and low[p] <= full[p, j] <= high[p])[:5]
        assert [(-int(s), int(i)) for s, i in zip(score[p], ids[p]) if s > covertree._MIN] == want
    leaves = slice(-int(tree["sizes"][-1]), None)
    y = covertree._raised(tree["x"], m)
    least, most = covertree.bounds(x[:50], y[tree["centers"][leaves]], tree["radii"][leaves], m)
    starts = np.append(tree["starts"][leaves], 800)
    inside = x[:50] @ tree["x"].T
    for n in range(len(starts) - 1):
        part = inside[:, starts[n] : starts[n + 1]]
        assert (least[:, n] <= part.min(axis=1)).all() and (most[:, n] >= part.max(axis=1)).all()
    assert ((most >= low[:, None]) & (least <= high[:, None])).mean() < 0.6  # the windows leave out many leaves


def test_sql_agrees(spark, sf):
    import duckdb

    from scopespark.llm import registry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(covertree.sql()).df()
    got = registry.op11_cover_tree_negatives(spark, sf).toPandas()
    both = [f[list(COLUMNS)].sort_values(list(COLUMNS)).reset_index(drop=True).astype("int64") for f in (got, want)]
    pd.testing.assert_frame_equal(*both)
