"""Hard negatives by exact windowed search of inner products in cover trees.

Components are whole numbers, floor(256 * x).  A vector x gets one more component sqrt(M - |x|^2), M the largest
squared length of all, so that all lie on one sphere and a larger inner product with an anchor is a smaller
distance to (anchor, 0); balls around points then bound inner products from both sides.

The top of the tree is one level of at most CELLS pivots, farthest first in a sample of at most SAMPLE rows; every
row belongs to its nearest pivot, and the level's covering radii come from all rows.  The rows of a cell
are split evenly into blocks of about BLOCK rows, and each block is a tree of its own: farthest-first order
makes every prefix of the points a net, the prefixes of 1, BRANCH, BRANCH^2, ... points are its levels, and each point of a
level hangs below the nearest one of the level before, with the exact radius that covers all below it.

A probe asks for the k best rows with scores in a window, of its own label or of any other one.  It first
descends one block of the cell with the highest bound, which yields a floor, and then the blocks of all cells whose
bounds meet the window above the floor.  Inside a block it skips nodes outside its window or without a fitting
label, takes leaves in the order of their bounds, and scores the rows of a leaf exactly.  Probes travel in
chunks of about CHUNK to the blocks they need; no row meets a probe whose bounds exclude its cell.

Rows without id, label or vector, with a null or non-finite component, or of a squared length of 2^62 or more (whose
scores need not fit a long) take no part.  Vectors of each length only meet their like.  Rows that share an id are rows
of their own, as anchors, positives and negatives; of equal scores the smaller id comes first.  Empty vectors
score 0.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopespark.session import spool

#: Pivots of the top level at most, the sample they come from, and rows that a pivot stands for at least.
CELLS, SAMPLE, PER_CELL = 1024, 16_384, 1024
#: Rows of a block and probes of a chunk, about; rows of a leaf; growth of a level.
BLOCK, CHUNK, LEAF, BRANCH = 4096, 2048, 16, 8
#: Leaves that a probe takes before it looks at its floor again.
WAVES = (1, 7)

_MIN = np.iinfo(np.int64).min
_TREE = "d int, cell int, part int, sizes binary, starts binary, centers binary, radii binary, low binary, high binary, x binary, ids binary, labels binary, own binary"


def whole(vector: Column) -> Column:
    """floor(256 * x) of each component."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Not null, all components finite, and the squared length of the whole numbers below 2^62."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    size = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(F.floor(F.lit(256.0) * x.cast("double")).cast("double"), F.lit(2.0)))
    return F.coalesce(vector.isNotNull() & ~bad & (size < 2.0**62), F.lit(False))


def _raised(x: np.ndarray, m: float) -> np.ndarray:
    """Rows with their component on the sphere of squared radius m."""
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(m - (x * x).sum(axis=1), 0.0))[:, None]], axis=1)


def _apart(y: np.ndarray, z: np.ndarray, m: float) -> np.ndarray:
    """Distances between rows of y and z on the sphere."""
    return np.sqrt(np.maximum(2 * (m - y @ z.T), 0.0))


def _slack(m: float) -> float:
    """More than rounding can move a distance by."""
    return 1e-6 * math.sqrt(m) + 1e-9


def farthest_first(y: np.ndarray, m: float, most: int) -> np.ndarray:
    """Row numbers, each as far as possible from those before it; ends where all others are copies."""
    chosen, far = [0], _apart(y, y[:1], m)[:, 0]
    while len(chosen) < most:
        i = int(far.argmax())
        if far[i] <= _slack(m):
            break
        chosen.append(i)
        far = np.minimum(far, _apart(y, y[i : i + 1], m)[:, 0])
    return np.array(chosen)


def _nearest(y: np.ndarray, z: np.ndarray, m: float) -> tuple[np.ndarray, np.ndarray]:
    away = _apart(y, z, m)
    best = away.argmin(axis=1)
    return best, away[np.arange(len(y)), best]


def build(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, own: np.ndarray, m: float) -> dict:
    """The tree of one block: rows in the order of its leaves, and level by level the nodes' first rows, centers and radii."""
    y = _raised(x, m)
    order = farthest_first(y, m, max(-(-len(x) // LEAF), 1))
    prefixes = [1]
    while prefixes[-1] < len(order):
        prefixes.append(min(prefixes[-1] * BRANCH, len(order)))
    path = [_nearest(y, y[order], m)[0]]  # the node of each row, from the last level up
    for size in prefixes[-2::-1]:
        up = _nearest(y[order], y[order[:size]], m)[0]
        up[:size] = np.arange(size)
        path.insert(0, up[path[0]])
    rows = np.lexsort(path[::-1])
    sizes, starts, centers, radii, low, high = [], [], [], [], [], []
    sorted_labels = labels[rows]
    for nodes in path:
        node = nodes[rows]
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        center = order[node[first]]
        away = np.sqrt(np.maximum(2 * (m - np.einsum("ij,ij->i", y[rows], y[order[node]])), 0.0))
        sizes.append(len(first))
        starts.append(first)
        centers.append(center)
        radii.append(np.maximum.reduceat(away, first) + _slack(m))
        low.append(np.minimum.reduceat(sorted_labels, first))
        high.append(np.maximum.reduceat(sorted_labels, first))
    place = np.empty(len(rows), dtype=np.int64)
    place[rows] = np.arange(len(rows))
    return {"sizes": np.array(sizes), "starts": np.concatenate(starts), "centers": place[np.concatenate(centers)], "radii": np.concatenate(radii), "low": np.concatenate(low), "high": np.concatenate(high), "x": x[rows], "ids": ids[rows], "labels": sorted_labels, "own": own[rows]}


def bounds(q: np.ndarray, centers: np.ndarray, radii: np.ndarray, m: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) inner product of each row of q with anything within ``radii`` of ``centers`` on the sphere."""
    q = q.astype(np.float64)
    total = (q * q).sum(axis=1)[:, None] + m
    away = np.sqrt(np.maximum(total - 2 * (q @ centers[:, :-1].T), 0.0))
    more = 1e-12 * (total + m)
    return (total - (away + radii + _slack(m)) ** 2) / 2 - more, (total - np.maximum(away - radii - _slack(m), 0.0) ** 2) / 2 + more


def _fits(same: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a node with labels from ``low`` to ``high`` can hold a fitting row."""
    inside = (low <= label[:, None]) & (label[:, None] <= high)
    only = (low == label[:, None]) & (high == label[:, None])
    return np.where(same[:, None], inside, ~only)


def descend(tree: dict, q: np.ndarray, own: np.ndarray, label: np.ndarray, same: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, m: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best ids, scores, row numbers), each probes x k: the k best fitting rows of a block; missing ones have score _MIN."""
    x = tree["x"]
    exact = np.float64 if m < 2.0**53 else np.int64
    xs, qs = x.astype(exact), q.astype(exact)
    y = _raised(x, m)
    alive, above, at = np.ones((len(q), 1), dtype=bool), np.zeros(1, dtype=np.int64), 0
    for size in tree["sizes"]:
        part = slice(at, at + size)
        at += size
        first = tree["starts"][part]
        least, most = bounds(q, y[tree["centers"][part]], tree["radii"][part], m)
        alive = alive[:, np.searchsorted(above, first, side="right") - 1] & (most >= low[:, None]) & (least <= high[:, None]) & _fits(same, label, tree["low"][part], tree["high"][part])
        above = first
    ends = np.concatenate((above[1:], [len(x)]))
    most = np.where(alive, most, -np.inf)
    turn = np.argsort(-most, axis=1, kind="stable")
    score = np.full((len(q), k), _MIN, dtype=np.int64)
    ids, rows = np.zeros((len(q), k), dtype=np.int64), np.zeros((len(q), k), dtype=np.int64)
    taken = 0
    for wave in (*WAVES, len(above)):
        now = turn[:, taken : taken + wave]
        taken += now.shape[1]
        wanted = np.take_along_axis(most, now, axis=1)
        open_ = (wanted > -np.inf) & (wanted >= score[:, -1:])
        probe, leaf = np.nonzero(open_)[0], now[open_]
        by = np.argsort(leaf, kind="stable")
        probe, leaf = probe[by], leaf[by]
        for group in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1) if len(leaf) else []:
            p, a, b = probe[group], above[leaf[group[0]]], ends[leaf[group[0]]]
            s = (qs[p] @ xs[a:b].T).astype(np.int64)
            ok = (s >= np.maximum(low[p], score[p, -1])[:, None]) & (s <= high[p][:, None]) & ((tree["labels"][a:b] == label[p][:, None]) == same[p][:, None]) & (tree["own"][a:b] != own[p][:, None])
            some = np.flatnonzero(ok.any(axis=1))
            if len(some):
                p = p[some]
                wide = lambda old, new: np.concatenate([old[p], np.broadcast_to(new, (len(p), b - a))], axis=1)
                s, i, r = wide(score, np.where(ok[some], s[some], _MIN)), wide(ids, tree["ids"][a:b]), wide(rows, tree["own"][a:b])
                best = np.lexsort((i, ~s), axis=1)[:, :k]
                score[p], ids[p], rows[p] = (np.take_along_axis(v, best, axis=1) for v in (s, i, r))
    return ids, score, rows


class Index:
    """Block trees in a spooled table, and the cells above them."""

    def __init__(self, trees: DataFrame, parts: DataFrame, m: float, pivots: dict[int, tuple[np.ndarray, ...]]):
        self.trees, self.parts, self.m, self.pivots = trees, parts, m, pivots


def index(rows: DataFrame) -> Index:
    """Index of rows (own, vec_id, label, v): the pivots pass through the driver, all else stays in tables."""
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    m, count = rows.agg(F.coalesce(F.max(squared), F.lit(0.0)), F.count("*")).first()
    some = rows.orderBy(F.xxhash64("v", "own")).limit(SAMPLE).select("v").toPandas()["v"]
    pivots, before = {}, 1
    lengths = some.map(len)
    for d in sorted(lengths.unique()) if count else []:
        mine = some[lengths == d]
        y = _raised(np.array(mine.tolist(), dtype=np.int64).reshape(len(mine), d), m)
        most = min(CELLS, -(-count // PER_CELL)) * len(mine) // len(some)
        if most and before + most <= CELLS + 1:  # lengths too rare for a pivot have one cell each, number 0
            y = y[farthest_first(y, m, most)]
            pivots[int(d)] = (np.arange(before, before + len(y)), y)
            before += len(y)

    @F.pandas_udf("cell int, away double")
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = pd.DataFrame({"cell": np.zeros(len(part), dtype=np.int32), "away": np.zeros(len(part))})
            length = part.map(len).to_numpy()
            for d in np.unique(length):
                if d in pivots:
                    at = np.flatnonzero(length == d)
                    for a in range(0, len(at), 1024):
                        best, away = _nearest(_raised(np.stack(part.iloc[at[a : a + 1024]].tolist()), m), pivots[d][1], m)
                        out.iloc[at[a : a + 1024], 0] = pivots[d][0][best].astype(np.int32)
                        out.iloc[at[a : a + 1024], 1] = away
            yield out

    placed = spool(rows.withColumns({"d": F.size("v"), "p": place("v")}).select("own", "vec_id", "label", "v", "d", "p.cell", "p.away"), "placed")
    cells = spool(placed.groupBy("d", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.max("away").alias("radius"), F.min("label").alias("low"), F.max("label").alias("high")), "cells")
    tops = {r["cell"]: r for r in cells.where("cell > 0").collect()}  # CELLS at most
    tables = {}
    for d, (numbers, y) in pivots.items():
        used = [i for i, n in enumerate(numbers.tolist()) if n in tops]
        mine = [tops[int(numbers[i])] for i in used]
        tables[d] = (numbers[used], y[used], np.array([r["radius"] for r in mine]) + _slack(m), np.array([r["low"] for r in mine], dtype=np.int64), np.array([r["high"] for r in mine], dtype=np.int64))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["v"].tolist(), dtype=np.int64).reshape(len(pdf), key[0])
        tree = build(x, *(pdf[c].to_numpy(dtype=np.int64) for c in ("vec_id", "label", "own")), m)
        return pd.DataFrame([list(key) + [np.ascontiguousarray(tree[c]).tobytes() for c in _TREE.replace(" binary", "").split(", ")[3:]]])

    blocks = placed.join(cells.select("d", "cell", "parts"), ["d", "cell"]).withColumn("part", F.pmod(F.xxhash64("own"), F.col("parts")).cast("int"))
    trees = blocks.select("d", "cell", "part", "own", "vec_id", "label", "v").groupBy("d", "cell", "part").applyInPandas(grow, _TREE)
    return Index(spool(trees, "trees"), cells.select("d", "cell", "parts"), m, tables)


def _unpacked(row: pd.Series) -> dict:
    kinds = {"radii": np.float64}
    tree = {c: np.frombuffer(row[c], dtype=kinds.get(c, np.int64)) for c in _TREE.replace(" binary", "").split(", ")[3:]}
    tree["x"] = tree["x"].reshape(len(tree["ids"]), int(row["d"]))
    return tree


def search(ix: Index, probes: DataFrame, k: int) -> DataFrame:
    """(probe, score, vec_id, own, place): the ``k`` best rows of each probe, by score and id, place from 1.

    A probe is (probe, own, label, same, low, high, v): rows of its label if ``same``, of others if not, with a score from
    ``low`` to ``high``, the row ``own`` left out.  ``probes`` are read several times; hand over a spool.
    """
    m, pivots = ix.m, ix.pivots

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series, label: pd.Series, same: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        """Cells that can hold an answer, the highest bound first."""
        out = [[0]] * len(v)
        length = v.map(len).to_numpy()
        for d in np.unique(length):
            if d in pivots:
                numbers, y, radii, least_label, most_label = pivots[d]
                at = np.flatnonzero(length == d)
                for a in range(0, len(at), 1024):
                    i = at[a : a + 1024]
                    least, most = bounds(np.stack(v.iloc[i].tolist()), y, radii, m)
                    ok = (most >= low.to_numpy()[i, None]) & (least <= high.to_numpy()[i, None]) & _fits(same.to_numpy()[i], label.to_numpy()[i], least_label, most_label)
                    turn = np.argsort(-most, axis=1, kind="stable")
                    for row, t, o in zip(i, turn, np.take_along_axis(ok, turn, axis=1)):
                        out[row] = numbers[t[o]].tolist()
        return pd.Series(out)

    def found_in(key: tuple, asked: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(tree):
            return pd.DataFrame({"probe": [], "score": [], "vec_id": [], "own": []}, dtype="int64")
        q = np.array(asked["v"].tolist(), dtype=np.int64).reshape(len(asked), key[0])
        columns = [asked[c].to_numpy(dtype=np.int64) for c in ("own", "label")] + [asked["same"].to_numpy(dtype=bool)] + [asked[c].to_numpy(dtype=np.int64) for c in ("low", "high")]
        ids, score, rows = descend(_unpacked(tree.iloc[0]), q, *columns, k, m)
        has = score > _MIN
        return pd.DataFrame({"probe": np.broadcast_to(asked["probe"].to_numpy()[:, None], has.shape)[has], "score": score[has], "vec_id": ids[has], "own": rows[has]})

    def visit(asked: DataFrame, chunks: int) -> DataFrame:
        keys = ["d", "cell", "part", "chunk"]
        asked = asked.withColumn("chunk", F.pmod(F.xxhash64("probe"), F.lit(chunks)).cast("int"))
        wanted = asked.select("d", "cell", "part", F.col("chunk").alias("turn")).distinct()
        trees = ix.trees.join(wanted, keys[:3]).groupBy(*keys[:3], "turn")
        return asked.groupBy(*keys).cogroup(trees).applyInPandas(found_in, "probe long, score long, vec_id long, own long")

    def best(found: DataFrame) -> DataFrame:
        turn = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id", "own"))
        return found.withColumn("place", turn).where(F.col("place") <= k)

    chunks = max(-(-probes.count() // CHUNK), 1)
    size, near = F.size("v").alias("d"), cells("v", "label", "same", "low", "high")
    routed = probes.select("*", size, near.alias("cells")).where(F.size("cells") > 0).withColumn("cell", F.get("cells", F.lit(0))).drop("cells")
    home = spool(routed.join(ix.parts, ["d", "cell"]).withColumn("part", F.pmod(F.xxhash64("probe", F.lit("home")), F.col("parts")).cast("int")).drop("parts"), "home")
    first = spool(best(visit(home, chunks)), "first")
    floors = first.where(F.col("place") == k).select("probe", F.col("score").alias("floor"))
    raised = home.withColumnsRenamed({"cell": "home_cell", "part": "home_part"}).join(floors, "probe", "left").withColumn("low", F.greatest("low", F.coalesce("floor", "low"))).drop("floor")
    rest = raised.withColumn("cell", F.explode(near)).join(ix.parts, ["d", "cell"])
    rest = rest.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where((F.col("cell") != F.col("home_cell")) | (F.col("part") != F.col("home_part")))
    others = visit(spool(rest.drop("parts", "home_cell", "home_part"), "rest"), chunks)
    return best(first.drop("place").union(others))


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, share: int = 80, vec: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row that ``anchors`` picks, the first ``positives`` other rows of its label, and for each of these the
    first ``negatives`` rows of other labels whose score is at most the positive's and at least ``share`` percent of it.
    """
    ok = usable(F.col(embedding)) & F.col(vec).isNotNull() & F.col(label).isNotNull()
    kept = rows.where(ok).select(F.monotonically_increasing_id().alias("own"), F.col(vec).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole(F.col(embedding)).alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    kept = spool(kept, "whole")
    ix = index(kept.drop("anchor"))
    base = kept.where("anchor").drop("anchor")
    # a positive of negative score has no negatives, so the window of the positives begins at 0
    like = spool(base.select(F.col("own").alias("probe"), "own", "label", F.lit(True).alias("same"), F.lit(0).cast("long").alias("low"), F.lit(2**62).alias("high"), "v"), "like")
    near = search(ix, like, positives).select(F.col("probe").alias("own"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "place")
    pairs = spool(base.join(near, "own").withColumn("probe", F.col("own") * positives + F.col("place") - 1), "pairs")
    least = F.ceil(F.col("positive_score").cast("decimal(20,0)") * share / 100).cast("long")
    unlike = spool(pairs.select("probe", "own", "label", F.lit(False).alias("same"), least.alias("low"), F.col("positive_score").alias("high"), "v"), "unlike")
    hard = search(ix, unlike, negatives).select("probe", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("place").cast("int").alias("rank"))
    return pairs.join(hard, "probe").select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def sql() -> str:
    """DuckDB SQL of the registered query: all scores, ranked."""
    return """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
    QUALIFY rank <= 5"""
