"""k-means fits that each run inside one task, with the draws, steps and cost of MLlib's ``KMeans``.

MLlib spends some thirty Spark jobs on a fit, so hundreds of fits on a small table wait for the driver.  Here each fit
gets all points by broadcast and is one task; its cost equals that of MLlib's fit of the same seed but for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512  # neighbouring points whose candidates are looked up together
FIRST_STEPS, FIRST_ROUNDS, ROUNDS, TOLERANCE = 2, 30, 20, 1e-4  # MLlib's defaults
TASKS = 2000  # at most
MOST_VALUES = 1 << 21  # 16 MB of points; more are left to MLlib
_32, _64 = (1 << 32) - 1, (1 << 64) - 1


def _mixed(words: Sequence[int], h: int) -> int:
    """MurmurHash3 (32 bits) of whole words."""
    for w in words:
        w = w * 0xCC9E2D51 & _32
        w = (w << 15 | w >> 17) * 0x1B873593 & _32
        h ^= w
        h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & _32
    h ^= 4 * len(words)
    h = (h ^ h >> 16) * 0x85EBCA6B & _32
    h = (h ^ h >> 13) * 0xC2B2AE35 & _32
    return h ^ h >> 16


def _state(seed: int) -> int:
    """The state that Spark's XORShiftRandom starts from."""
    raw = (seed & _64).to_bytes(8, "big")
    words = [int.from_bytes(raw[i : i + 4], "little") for i in (0, 4)]
    low = _mixed(words, 0x3C074A61)
    return _mixed(words, low) << 32 | low


def _shifted(s: np.ndarray) -> np.ndarray:
    s = s ^ s << np.uint64(21)
    s = s ^ s >> np.uint64(35)
    return s ^ s << np.uint64(4)


@cache
def _tables(i: int) -> np.ndarray:
    """For each of a state's 8 bytes and its 256 values, what becomes of it after 2 ** i steps; a step is linear over bits."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    columns = _ahead(_ahead(bits, i - 1), i - 1) if i else _shifted(bits)
    out = np.zeros((8, 256), np.uint64)
    for value in range(256):
        for bit in range(8):
            if value >> bit & 1:
                out[:, value] ^= columns[bit::8]
    return out


def _ahead(s: np.ndarray, i: int) -> np.ndarray:
    """States ``s`` after 2 ** i steps."""
    total = np.zeros_like(s)
    for byte, table in enumerate(_tables(i)):
        total ^= table[(s >> np.uint64(8 * byte) & np.uint64(255)).astype(np.intp)]
    return total


def _states(seed: int, n: int) -> np.ndarray:
    """The next ``n`` states, in lanes of 2 ** i steps that start where the one before ends and go on together."""
    i = (n.bit_length() + 1) // 2
    lanes, doubled = np.array([_state(seed)], np.uint64), i
    while len(lanes) << i < n:
        lanes, doubled = np.concatenate([lanes, _ahead(lanes, doubled)]), doubled + 1
    out = np.empty((len(lanes), 1 << i), np.uint64)
    for step in range(1 << i):
        out[:, step] = lanes = _shifted(lanes)
    return out.ravel()[:n]


def first_seed(seed: int) -> int:
    """``new XORShiftRandom(seed).nextInt()``."""
    x = int(_states(seed, 1)[0]) & _32
    return x - (1 << 32) if x >> 31 else x


def draws(seed: int, n: int) -> np.ndarray:
    """``n`` times ``nextDouble()`` of a new XORShiftRandom."""
    s = _states(seed, 2 * n)
    high, low = s[0::2] & np.uint64((1 << 26) - 1), s[1::2] & np.uint64((1 << 27) - 1)
    return ((high << np.uint64(27)) + low).astype(float) * 2.0**-53


class _JavaRandom:
    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.state >> (48 - n)

    def double(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) * 2.0**-53

    def below(self, n: int) -> int:
        x = self.bits(31)
        if n & (n - 1) == 0:
            return n * x >> 31
        while x - x % n + n - 1 >= 1 << 31:
            x = self.bits(31)
        return x % n


class Points:
    """All points, neighbours together in blocks of at most ``BLOCK`` with the box around each block.

    ``order`` has the place of each point in the table, ``sizes`` the rows of the table's partitions.
    """

    def __init__(self, values: np.ndarray, sizes: Sequence[int]):
        todo, done = [np.arange(len(values))], []
        while todo:
            part = todo.pop()
            if len(part) <= BLOCK:
                done.append(part)
                continue
            own = values[part]
            half = np.argpartition(own[:, np.ptp(own, axis=0).argmax()], len(part) // 2)
            todo += [part[half[: len(part) // 2]], part[half[len(part) // 2 :]]]
        self.sizes, self.order = list(sizes), np.concatenate(done)
        self.x = values[self.order]
        self.ends = np.cumsum([len(p) for p in done])
        starts = self.ends - [len(p) for p in done]
        self.low, self.high = np.minimum.reduceat(self.x, starts), np.maximum.reduceat(self.x, starts)

    def closest(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centre (the first on ties) and squared distance to it, for each point."""
        at, start, norms, twice = np.empty(len(self.x), np.intp), 0, (centres * centres).sum(axis=1), -2 * centres.T
        for first in range(0, len(self.ends), BLOCK):
            low, high = self.low[first : first + BLOCK], self.high[first : first + BLOCK]
            least, most = np.zeros((len(low), len(centres))), np.zeros((len(low), len(centres)))
            for j, c in enumerate(centres.T):
                below, above = low[:, j, None] - c, c - high[:, j, None]
                least += np.maximum(np.maximum(below, above), 0) ** 2
                most += np.maximum(-below, -above) ** 2
            # a centre farther from the box than some centre from its farthest corner is nearest to none of its points
            near = least <= most.min(axis=1, keepdims=True) * (1 + 1e-9)
            for end, own in zip(self.ends[first : first + BLOCK], near):
                own = own.nonzero()[0]
                distance = self.x[start:end] @ twice[:, own]
                distance += norms[own]
                at[start:end] = own[distance.argmin(axis=1)]
                start = end
        squared = np.zeros(len(self.x))
        for x, c in zip(self.x.T, centres.T):
            squared += (x - c[at]) ** 2
        return at, squared


def _pick(candidates: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """MLlib's ``LocalKMeans``: k-means++ over weighted candidates."""
    rand = _JavaRandom(0)

    def first_over(scores: np.ndarray) -> int:
        """The last one added before the running total reaches a drawn part of the whole."""
        total = np.cumsum(scores)
        part = rand.double() * total[-1]
        return min(int(np.searchsorted(total, part)), len(total) - 1) if part > 0 else -1

    def squared(c: np.ndarray) -> np.ndarray:
        return ((candidates - c) ** 2).sum(axis=1)

    chosen = [candidates[max(first_over(weights), 0)]]
    cost = squared(chosen[0])
    for _ in range(1, k):
        chosen.append(candidates[max(first_over(weights * cost), 0)])
        cost = np.minimum(cost, squared(chosen[-1]))
    centres, last = np.array(chosen), np.full(len(candidates), -1)
    for _ in range(FIRST_ROUNDS):
        at = ((centres * centres).sum(axis=1) - 2 * (candidates @ centres.T)).argmin(axis=1)
        held, still = np.bincount(at, weights, k), (at == last).all()
        sums = np.stack([np.bincount(at, weights * v, k) for v in candidates.T], axis=1)
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
        for i in np.flatnonzero(held == 0):
            centres[i] = candidates[rand.below(len(candidates))]
        if still:
            break
        last = at
    return centres


def start(points: Points, k: int, seed: int, first: int) -> np.ndarray:
    """k-means||: from the point at place ``first``, two rounds that draw some 2k candidates each, and k of these."""
    new = points.x[points.order == first]
    candidates, cost = new, np.full(len(points.x), np.inf)
    for step in range(FIRST_STEPS):
        if len(new):
            cost = np.minimum(cost, points.closest(new)[1])
        u = np.concatenate([draws(seed ^ step << 16 ^ i, int(n)) for i, n in enumerate(points.sizes)])[points.order]
        with np.errstate(invalid="ignore"):  # all points are centres
            drawn = np.flatnonzero(u < 2.0 * cost * k / cost.sum())
        new = points.x[drawn[np.argsort(points.order[drawn])]]
        candidates = np.concatenate([candidates, new])
    candidates = np.array(list(dict.fromkeys(map(tuple, candidates))))
    if len(candidates) <= k:
        return candidates
    return _pick(candidates, np.bincount(points.closest(candidates)[0], minlength=len(candidates)).astype(float), k)


def training_cost(points: Points, k: int, seed: int, first: int) -> float:
    """The cost that ``KMeans(k=k, seed=...).fit(...).summary.trainingCost`` gives: that of the last round's assignment."""
    centres, cost = start(points, k, seed, first), 0.0
    for _ in range(ROUNDS):
        at, squared = points.closest(centres)
        cost, n = float(squared.sum()), np.bincount(at, minlength=len(centres))
        held = n > 0
        sums = np.stack([np.bincount(at, v, len(centres)) for v in points.x.T], axis=1)
        moved = sums[held] / n[held, None]
        still = (((moved - centres[held]) ** 2).sum(axis=1) <= TOLERANCE**2).all()
        centres[held] = moved
        if still:
            break
    return cost


def gathered(points: DataFrame, vector: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All vectors and their places (``monotonically_increasing_id``), on the driver."""
    array = vector_to_array(vector)
    table = points.select(F.monotonically_increasing_id().alias("place"), *[F.get(array, F.lit(i)).alias(f"x{i}") for i in range(width)]).toArrow()
    return np.stack([table[f"x{i}"].to_numpy() for i in range(width)], axis=1), table["place"].to_numpy()


def training_costs(points: DataFrame, values: np.ndarray, places: np.ndarray, fits: Sequence[tuple[int, int]]) -> list[float]:
    """Costs of all fits (k, seed) on ``points``, whose rows are gathered in ``values`` and ``places``."""
    spark = points.sparkSession
    rows = points.select(F.monotonically_increasing_id())._jdf.javaRDD()
    seeds = {s: first_seed(s) for _, s in fits}
    # drawn by Spark: the row that MLlib begins with
    first = {s: int(np.searchsorted(places, rows.takeSample(False, 1, x)[0].getLong(0))) for s, x in seeds.items()}
    shared = spark.sparkContext.broadcast(Points(values, np.bincount(places >> 33, minlength=rows.getNumPartitions())))
    fits = sorted(enumerate(fits), key=lambda f: -f[1][0])  # the longest first

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [fits[i] for i in batch["id"]]
            yield pd.DataFrame({"fit": [i for i, _ in own], "cost": [training_cost(shared.value, k, seeds[s], first[s]) for _, (k, s) in own]})

    found = spark.range(0, len(fits), 1, min(len(fits), TASKS)).mapInPandas(fit, "fit long, cost double").collect()
    shared.destroy()
    return [c for _, c in sorted((r["fit"], r["cost"]) for r in found)]
