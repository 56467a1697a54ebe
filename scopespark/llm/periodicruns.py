"""Maximal periodic runs of words by string synchronising sets.

Documents are rows; Spark spreads them, and each task takes a bounded block of texts as one array of words with a
separator of its own behind each document, so that no run crosses documents.  A run is a stretch of words
with smallest period q and a length of at least max(LEAST, 2 * q) that can't grow.

Periods up to SMALL are found by comparing the array with itself.  Beyond, scale t = 4, 8, 16, ... answers for
the periods from 3 * t - 1 to 6 * t - 2.  At a scale every stretch of t words has a hash; a position is
chosen if the least hash that starts among the next t + 1 positions is its own or the last of these, where
stretches of period t / 3 or less have no say.  The choice depends on the 2 * t words behind the position only, so
a run repeats its choices one period later: pairs of chosen positions with equal contexts of 2 * t words,
as far apart as the scale's periods, propose a period and are grown to both sides.  A run escapes
only if its first period is itself highly periodic.  Then it begins in one run of that small period and goes on
in the next one of the same period, of the same words, that touches it; such neighbours propose
all periods that shift one onto the other.

Stretches of 2**k words have 64-bit names made of two names of half the length; equal names count as equal words.

Null and empty texts have no words and no runs; texts of any length are handled whole; repeated rows are rows
of their own; a null id is carried along; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopespark.llm.textkernel import blocks, mix64

#: Least length of a run in words; largest period that is found by direct comparison.
LEAST, SMALL = 12, 10
#: Words, in Spark's and in Java's notation of classes: what ``bytes.split`` takes for words.
WORD = r"[^\x20\x09-\x0D]+"

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Names:
    """``level[k][i]`` names the 2**k words from i on; documents stand longest first, so high levels are short."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.sizes, self.ends = sizes, np.cumsum(sizes + 1)
        self.level = [words]
        while reach := self.reach(2 << (len(self.level) - 1)):
            half, last = 1 << (len(self.level) - 1), self.level[-1]
            n = min(reach, len(last) - half)
            self.level.append(mix64(last[:n] * np.uint64(0x9FB21C651E98DF25) + last[half : half + n]))

    def reach(self, least: int) -> int:
        """End of the documents with at least so many words."""
        n = int(np.searchsorted(-self.sizes, -least, side="right"))
        return int(self.ends[n - 1]) if n else 0

    def ahead(self, i: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Words from i on that equal those from i + gap on."""
        done = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            names, a = self.level[k], i + done
            at = np.flatnonzero(a + gap < len(names))
            done[at[names[a[at]] == names[a[at] + gap[at]]]] += 1 << k
        return done

    def behind(self, i: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Words before i that equal those before i + gap."""
        done = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            names, a = self.level[k], i - done - (1 << k)
            at = np.flatnonzero((a >= 0) & (a + gap < len(names)))
            done[at[names[a[at]] == names[a[at] + gap[at]]]] += 1 << k
        return done

    def grown(self, i: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """(start, end, period) rows of the stretches of at least two periods around the pairs (i, i + gap)."""
        left, right = self.behind(i, gap), self.ahead(i, gap)
        ok = left + right >= gap
        return _smallest(np.stack([i - left, i + gap + right, gap], axis=1)[ok])


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Rows by start and end, of equal ones that with the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)))] if len(runs) else runs


def _direct(words: np.ndarray, period: int) -> np.ndarray:
    """Stretches of at least two periods, by comparing the words one period apart."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], words[:-period] == words[period:], [False]))))
    start, end = edge[::2], edge[1::2]
    ok = end - start >= period
    return np.stack([start[ok], end[ok] + period, np.full(ok.sum(), period)], axis=1)


def _chosen(names: Names, runs: np.ndarray, k: int, n: int) -> np.ndarray:
    """Positions below n of the synchronising set for stretches of t = 2**k words."""
    t = 1 << k
    ids = names.level[k][: n + t].copy()
    calm = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= t)]
    depth = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(depth, np.minimum(calm[:, 0], len(ids)), 1)
    np.add.at(depth, np.minimum(calm[:, 1] - t + 1, len(ids)), -1)
    ids[np.cumsum(depth)[:-1] > 0] = _NONE
    least = ids
    for b in range(k):
        least = np.minimum(least[: -(1 << b)], least[1 << b :])
    least = np.minimum(least[:n], ids[t : t + n])
    return np.flatnonzero((least != _NONE) & ((least == ids[:n]) | (least == ids[t : t + n])))


def _proposed(names: Names, runs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period): pairs of chosen positions with equal contexts at the distances of this scale."""
    t = 1 << k
    n = min(names.reach(6 * t - 2), len(names.level[k + 1]))
    at = _chosen(names, runs, k, n)
    context = names.level[k + 1][at]
    order = np.argsort(context, kind="stable")
    context, at = context[order], at[order]
    found = []
    for step in range(1, len(at)):  # equal contexts stand more than t / 3 apart, so a few steps pass them all
        gap = at[step:] - at[:-step]
        near = (context[step:] == context[:-step]) & (gap <= 6 * t - 2)
        if not near.any():
            break
        near &= gap >= 3 * t - 1
        found.append(np.stack([at[:-step][near], gap[near]]))
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
    return both[0], both[1]


def _shifts(names: Names, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, period): periods that carry a run onto the next one of the same period and words touching it."""
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    a, b = runs[:-1], runs[1:]
    touch = (a[:, 2] == b[:, 2]) & (b[:, 0] <= a[:, 1])
    a, b = a[touch], b[touch]
    q = a[:, 2]
    pair = np.repeat(np.arange(len(q)), q)
    turn = np.arange(len(pair)) - np.repeat(np.cumsum(q) - q, q)
    first = a[pair, 0] + turn
    same = names.ahead(first, b[pair, 0] - first) >= q[pair]
    pair, turn = pair[same], turn[same]  # one turn at most, since a period is no power
    a, b, q = a[pair], b[pair], q[pair]
    low = np.maximum(SMALL + 1, 2 * q)
    low += (b[:, 0] - a[:, 0] - turn - low) % q
    count = np.maximum((np.minimum(a[:, 1] - a[:, 0], b[:, 1] - b[:, 0]) - low) // q + 1, 0)
    pair = np.repeat(np.arange(len(q)), count)
    gap = low[pair] + q[pair] * (np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count))
    return np.maximum(a[pair, 0], b[pair, 0] - gap), gap


def runs_of(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs of at least two periods, any length; ``words`` are names with separators.

    ``sizes`` are the words of each document, longest first; behind each stands a name that occurs nowhere else.
    """
    names = Names(words, sizes)
    runs = _smallest(np.concatenate([_direct(words, q) for q in range(1, min(SMALL, len(words) - 1) + 1)] or [np.zeros((0, 3), dtype=np.int64)]))
    k, done = 2, 0
    while names.reach(6 * (1 << k) - 2):
        limit = (1 << k) // 3
        calm = runs[(runs[:, 2] > done) & (runs[:, 2] <= limit)]
        pairs = [_proposed(names, runs, k), _shifts(names, calm)]
        done, k = limit, k + 1
        runs = _smallest(np.concatenate([runs, *[names.grown(*p) for p in pairs]]))
    return runs


def _block(rows: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, list[bytes]]:
    """(words of each row, row of each run, start, length and period of each run, text without the later periods)."""
    texts = [x.split() for x in rows]
    size = np.array([len(x) for x in texts], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    flat = [w for i in order for w in texts[i]]
    codes = pd.factorize(np.array([*flat, None], dtype=object)[:-1])[0].astype(np.uint64)
    sizes = size[order]
    ends = np.cumsum(sizes + 1)
    words = np.zeros(int(ends[-1]), dtype=np.uint64)
    gap = np.zeros(len(words), dtype=bool)
    gap[ends - 1] = True
    words[~gap] = codes
    words[gap] = np.uint64(len(codes)) + np.arange(len(sizes), dtype=np.uint64)
    runs = runs_of(mix64(words + np.uint64(1)), sizes)
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(LEAST, 2 * runs[:, 2])]
    place = np.searchsorted(ends, runs[:, 0], side="right")
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    kept = np.cumsum(depth)[:-1] == 0
    first = ends - sizes - 1
    left = [b" ".join(texts[i]) for i in range(len(rows))]
    for d in np.unique(place):
        i = order[d]
        left[i] = b" ".join([w for w, k in zip(texts[i], kept[first[d] : ends[d] - 1].tolist()) if k])
    row = order[place]
    told = np.stack([row, runs[:, 0] - first[place], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    return size, told[np.lexsort((told[:, 3], told[:, 1], told[:, 0]))], left


def _in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column(1).to_pylist()
        for lo, hi in blocks(rows):
            size, told, left = _block(rows[lo:hi])
            offsets = np.concatenate(([0], np.cumsum(np.bincount(told[:, 0], minlength=hi - lo)))).astype(np.int32)
            fields = pa.StructArray.from_arrays([pa.array(told[:, c]) for c in (1, 2, 3)], fields=list(_RUN_TYPE))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(size), pa.ListArray.from_arrays(pa.array(offsets), fields), pa.array([x.decode() for x in left])],
                names=["doc", "n_words", "runs", "collapsed"],
            )


def find(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_words, runs, collapsed) of every row of ``docs``.

    ``runs`` are structs of start, length and period in words, by start and period; ``collapsed`` is the text
    with the words kept that no run holds behind its first period, joined by single spaces.
    """
    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_in_batches, f"doc {kind}, n_words bigint, runs {_RUNS}, collapsed string")


def longest(runs: Column) -> Column:
    """The run with the greatest length, of these the first, of these that with the smallest period; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(F.size(runs) > 0, F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def written(runs: Column) -> Column:
    """start,length,period and a line feed for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")


def repeated(text: Column, doc: Column) -> Column:
    """``text`` with its tail made periodic in the tenth of the rows that the hash of the id picks.

    With h the CRC-32 of the id in decimal and g = h // 10, a row with h % 10 = 0 and n > 0 words repeats the p words
    from a on to the end, where a = g % n and p = 1 + (n - a) // (3 + g % 8); a null id picks nothing.
    """
    h = F.crc32(doc.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        made = F.concat(F.slice(w, F.lit(1), a), F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)))
        return F.when(n > 0, F.array_join(F.slice(made, F.lit(1), n), " ")).otherwise(text)

    # one element, so that the words are cut once
    return F.when(h % 10 == 0, F.element_at(F.transform(F.array(words), tail), 1)).otherwise(text)
