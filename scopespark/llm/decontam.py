"""Benchmark decontamination: documents that hold a benchmark item within a small edit distance.

Items and texts are sequences of lower-cased words; an item of n words is held by a document if some
stretch of its words is at most n // EDITS_PER edits away.

1. Windows.  Each edit destroys at most GRAM grams of an item, so a stretch within the bound keeps at
   least n - GRAM + 1 - GRAM * (n // EDITS_PER) of them.  A table of fixed size tells for each gram
   hash which item lengths have it; every item-sized window with enough grams of its length is
   walked.  This loses no stretch within the bound.
2. Embedding.  The CGK walk reads a window with a pointer that stays or advances by a random bit of
   (repetition, step, word).  Two walks fall into step again after an edit, so a small edit distance
   becomes a small Hamming distance of the sequences of words read.
3. Bit sampling.  Each repetition hashes SAMPLES steps of its walk; windows and items that share a
   repetition's hash meet in a join.  REPETITIONS are chosen for a recall above 0.95 at the bound.
   A table of fixed size tells which hashes no item has; neighbouring windows that are left share a row.
4. Verification.  The exact edit distance of the item to the best stretch of the window, extended by
   the bound on both sides.

One edit can leave an item of SHORT words without any gram.  These items aren't walked: an exact join on
the sequences of four words that one omission leaves holds every stretch within one edit.  Items of fewer
words have no edit to spare and are joined as they stand.

Items with fewer than ``least`` words are not searched (a filter may want to leave single words alone).
Items over MOST words are cut into passages of MOST words that are searched one by one; ``n_found`` of
``n_passages`` tell how much of such an item a document holds.  Null or empty texts hold nothing.
Repeated documents and items are each reported; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopespark.llm import textkernel
from scopespark.session import spool

GRAM, EDITS_PER = 3, 5
MOST, SHORT = 64, 5
SAMPLES, REPETITIONS = 4, 64
#: Entries of the gram table (a mask of item lengths each), whatever the number of items.
TABLE = 1 << 20
#: Windows that walk side by side.
SIDE_BY_SIDE = 4000
#: log2 of the bits that tell whether an item can have a key.
KEY_BITS = 24


def _bound(n):
    return n // EDITS_PER


def _grams(words: np.ndarray) -> np.ndarray:
    """Hash of the GRAM words from each position on; the last positions have none."""
    n = max(len(words) - GRAM + 1, 0)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):  # the words are well mixed already
        h += words[k : n + k] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def passages(items: DataFrame, item: str = "item_id", text: str = "text", least: int = 1) -> DataFrame:
    """(item, passage, n_passages, words): items as word hashes, long ones cut into passages."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            ids = part[item].tolist()
            for lo, hi, hashes, offsets in textkernel.word_hashes(textkernel.to_bytes(part[text])):
                for i, a, b in zip(range(lo, hi), offsets, offsets[1:]):
                    # the last passage of a long item ends with the item
                    starts = [a] if b - a <= MOST else [*range(a, b - MOST, MOST), b - MOST]
                    rows += [(ids[i], k, len(starts), hashes[s : min(s + MOST, b)].view(np.int64)) for k, s in enumerate(starts) if b - a >= max(least, 1)]
            yield pd.DataFrame(rows, columns=["item", "passage", "n_passages", "words"])

    kind = items.schema[item].dataType.simpleString()
    return items.select(item, text).mapInPandas(cut, f"item {kind}, passage int, n_passages int, words array<long>")


def gram_table(cut: DataFrame) -> np.ndarray:
    """Mask of passage lengths for each gram slot; at most TABLE rows come to the driver."""

    @F.pandas_udf("array<int>")
    def slots(words: pd.Series) -> pd.Series:
        return pd.Series([(_grams(np.asarray(w).view(np.uint64)) >> np.uint64(44)).astype(np.int32) for w in words], dtype=object)

    each = cut.select(F.explode(slots("words")).alias("slot"), F.expr("shiftleft(1L, size(words) - 1)").alias("mask"))
    rows = each.groupBy("slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    table = np.zeros(TABLE, dtype=np.int64)
    table[rows["slot"].to_numpy(dtype=np.int64)] = rows["mask"].to_numpy(dtype=np.int64)
    return table


@lru_cache(maxsize=1)
def _sampled() -> np.ndarray:
    """sampled[n, r, j]: whether repetition r reads step j of the walk over windows of n words."""
    out = np.zeros((MOST + 1, REPETITIONS, 2 * MOST), dtype=bool)
    for n in range(SHORT + 1, MOST + 1):
        rng = np.random.default_rng(n)
        for r in range(REPETITIONS):
            out[n, r, rng.choice(2 * n, SAMPLES, replace=False)] = True
    return out


def walk_keys(windows: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """One key for each window and repetition; all walks go side by side.

    Behind its last word, or behind a shorter row's, a window reads blanks.
    """
    count, n = len(windows), np.array(sizes)
    words = np.zeros((count, max(sizes, default=0) + 1), dtype=np.uint64)
    for i, w in enumerate(windows):
        words[i, : len(w)] = w
    flat, row = words.ravel(), np.arange(count) * words.shape[1]
    keys = np.empty((count, REPETITIONS), dtype=np.int64)
    for r in range(REPETITIONS):
        seed = (r * 1009 + n).astype(np.uint64)
        coins = textkernel.mix64(words ^ textkernel.mix64(seed)[:, None]).ravel()
        chosen = _sampled()[n, r]
        at, key = np.zeros(count, dtype=np.int64), seed.copy()
        for j in range(int(np.flatnonzero(chosen.any(axis=0))[-1]) + 1):
            here = row + at
            read = chosen[:, j]
            if read.any():
                key[read] = textkernel.mix64(key[read] + flat[here[read]])
            at = np.minimum(at + ((coins[here] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64), n)
        keys[:, r] = key.view(np.int64)
    return keys


def _key(words: np.ndarray, at: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    """Key of the words at these steps behind each position."""
    h = np.full(len(at), 0x5851F42D4C957F2D, dtype=np.uint64)
    for k in steps:
        h = textkernel.mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[at + k])
    return h.view(np.int64)


def item_keys(passages: list[np.ndarray]) -> list[np.ndarray]:
    """Keys that a passage is met by."""
    long = [w for w in passages if len(w) > SHORT]
    walked = iter(walk_keys(long, [len(w) for w in long])) if long else iter(())
    zero = np.zeros(1, dtype=np.int64)
    omitted = [tuple(k for k in range(SHORT) if k != p) for p in range(SHORT)]
    few = lambda w: np.concatenate([_key(w, zero, o) for o in (omitted if len(w) == SHORT else [tuple(range(len(w)))])])
    return [few(w) if len(w) <= SHORT else next(walked) for w in passages]


def short_keys(hashes: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, keys) of all runs of n words; for SHORT of all runs of four words, and of SHORT without an inner one."""
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(hashes))
    for steps in ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4)) if n == SHORT else (tuple(range(n)),):
        at = np.flatnonzero(left > steps[-1])
        yield at, _key(hashes, at, steps)


def _known(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether an item can have each key."""
    slot = keys.view(np.uint64) >> np.uint64(64 - KEY_BITS)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def key_table(asked: DataFrame) -> np.ndarray:
    """One bit for each slot of keys ``k``; at most 2 ** (KEY_BITS - 6) rows come to the driver."""
    slot = F.shiftrightunsigned("k", 64 - KEY_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(k, {64 - KEY_BITS}) & 63 as int))")
    rows = asked.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    table = np.zeros(1 << KEY_BITS - 6, dtype=np.int64)
    table[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return table.view(np.uint64)


def windows_of(hashes: np.ndarray, offsets: np.ndarray, table: np.ndarray, lengths: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(n, starts, rows) of the item-sized windows with enough grams."""
    if len(hashes) < GRAM:
        return []
    mask = np.zeros(len(hashes), dtype=np.int64)
    mask[: len(hashes) - GRAM + 1] = table[(_grams(hashes) >> np.uint64(44)).astype(np.int64)]
    ends = offsets[1:]
    for k in range(1, GRAM):  # no gram reaches into the next row
        last = ends - k
        mask[last[(last >= offsets[:-1]) & (last >= 0)]] = 0
    hits = np.flatnonzero(mask)
    if not len(hits):
        return []
    out = []
    row_of = np.searchsorted(ends, hits, side="right")
    for n in lengths[lengths > SHORT].tolist():
        own = (mask[hits] >> (n - 1)) & 1 == 1
        pos, row = hits[own], row_of[own]
        least = max(1, n - GRAM + 1 - GRAM * _bound(n))
        if len(pos) < least:
            continue
        # a window with enough grams begins at most that far before one of them
        reach = n - GRAM
        together = np.searchsorted(pos, pos + reach, side="right") - np.arange(len(pos)) >= least
        if not together.any():
            continue
        starts = np.unique((pos[together][:, None] - np.arange(0, reach + 1)).ravel())
        r = np.searchsorted(ends, np.maximum(starts, 0), side="right")
        size = ends - offsets[:-1]
        ok = (starts >= 0) & (r < len(ends))
        starts, r = starts[ok], r[ok]
        # in a row shorter than the window the window is the row
        starts = np.where(size[r] < n, offsets[:-1][r], np.minimum(starts, ends[r] - n))
        starts, keep = np.unique(starts, return_index=True)
        r = r[keep]
        count = np.searchsorted(pos, starts + reach, side="right") - np.searchsorted(pos, starts)
        good = count >= least
        if not good.any():
            continue
        out.append((n, starts[good], r[good]))
    return out


def windows(docs: DataFrame, table: np.ndarray, lengths: list[int], known: np.ndarray, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc, start, words, keys): stretches of words around windows, and the windows' keys that an item can have."""
    shared = docs.sparkSession.sparkContext.broadcast((table, np.array(lengths), known))

    def join(hashes: np.ndarray, offsets: np.ndarray, n: int, start: np.ndarray, row: np.ndarray, key: np.ndarray) -> Iterator[tuple]:
        """Windows of one row that begin within n words share a stretch."""
        order = np.lexsort((start, row))
        start, row, key = start[order], row[order], key[order]
        slack = 2 * _bound(n) + n // 2
        a = 0
        while a < len(start):
            k = row[a]
            b = min(int(np.searchsorted(row, k, side="right")), int(np.searchsorted(start, start[a] + n, side="right")))
            lo, hi = max(int(offsets[k]), int(start[a]) - slack), min(int(offsets[k + 1]), int(start[b - 1]) + n + slack)
            yield int(k), lo - int(offsets[k]), hashes[lo:hi].view(np.int64).copy(), np.unique(key[a:b])
            a = b

    def walked(blocks: list[tuple]) -> Iterator[tuple]:
        """Stretches of windows whose walks an item can have; all windows of the blocks walk side by side."""
        windows, sizes = [], []
        for _, hashes, offsets, n, starts, rows in blocks:
            windows += [hashes[s : min(s + n, e)] for s, e in zip(starts.tolist(), offsets[rows + 1].tolist())]
            sizes += [n] * len(starts)
        keys = walk_keys(windows, sizes)
        hit, done = _known(keys, shared.value[2]), 0
        for first, hashes, offsets, n, starts, rows in blocks:
            w, r = np.nonzero(hit[done : done + len(starts)])
            for k, *rest in join(hashes, offsets, n, starts[w], rows[w], keys[done + w, r]):
                yield first + k, *rest
            done += len(starts)

    def met(part: pd.DataFrame) -> Iterator[tuple]:
        grams, sizes, bits = shared.value
        blocks: list[tuple] = []
        held = 0
        for lo, _, hashes, offsets in textkernel.word_hashes(textkernel.to_bytes(part[text])):
            for n, starts, rows in windows_of(hashes, offsets, grams, sizes):
                for a in range(0, len(starts), SIDE_BY_SIDE):
                    blocks.append((lo, hashes, offsets, n, starts[a : a + SIDE_BY_SIDE], rows[a : a + SIDE_BY_SIDE]))
                    held += len(blocks[-1][4])
                    if held >= SIDE_BY_SIDE:
                        yield from walked(blocks)
                        blocks, held = [], 0
            for n in sizes[sizes <= SHORT].tolist():
                for at, keys in short_keys(hashes, offsets, n):
                    hit = _known(keys, bits)
                    at, keys = at[hit], keys[hit]
                    for k, *rest in join(hashes, offsets, n, at, np.searchsorted(offsets[1:], at, side="right"), keys):
                        yield lo + k, *rest
        if blocks:
            yield from walked(blocks)

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, held = ["row", "doc", "start", "words", "keys"], []

        def out() -> pd.DataFrame:
            row, who, *rest = zip(*held)
            held.clear()
            return pd.DataFrame(dict(zip(names, (row, pd.Series(who, dtype=object), *rest))))

        for part in parts:
            ids, rows = part[doc].tolist(), part["row"].tolist()
            for k, start, words, keys in met(part):
                held.append((rows[k], ids[k], start, words, keys))
                if len(held) >= 4000:
                    yield out()
        if held:
            yield out()

    kind = docs.schema[doc].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), doc, text)
    return numbered.mapInPandas(find, f"row long, doc {kind}, start int, words array<long>, keys array<long>")


def best_stretch(patterns: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edit distance of each pattern to the best stretch of its text, and where that stretch ends."""
    count, wide = len(patterns), max(map(len, texts), default=0)
    deep = max(map(len, patterns), default=0)
    text = np.zeros((count, wide), dtype=np.int64)
    pattern = np.zeros((count, deep), dtype=np.int64)
    for i, (p, t) in enumerate(zip(patterns, texts)):
        pattern[i, : len(p)], text[i, : len(t)] = p, t
    beyond = np.arange(wide) >= np.array([len(t) for t in texts])[:, None]
    sizes = np.array([len(p) for p in patterns])
    cost = np.zeros((count, wide + 1), dtype=np.int32)  # a stretch may begin anywhere
    last = cost.copy()
    steps = np.arange(wide + 1, dtype=np.int32)
    for d in range(1, deep + 1):
        change = cost[:, :-1] + ((text != pattern[:, d - 1 : d]) | beyond)
        new = np.concatenate([np.full((count, 1), d, dtype=np.int32), np.minimum(change, cost[:, 1:] + 1)], axis=1)
        cost = (np.minimum.accumulate(new - steps, axis=1) + steps).astype(np.int32)  # skipping words of the text
        done = sizes == d
        last[done] = cost[done]
    end = last.argmin(axis=1)
    return last[np.arange(count), end], end


def contaminated(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", least: int = 1) -> DataFrame:
    """(row, doc, item, n_words, edits, end_word, n_found, n_passages): the best match of each document row and item.

    ``row`` numbers the rows of ``docs``; ``end_word`` is the word of the document behind the match.
    """
    spark = docs.sparkSession
    cut = spool(passages(items, item, text, least), "passages")
    lengths = sorted(r[0] for r in cut.select(F.size("words")).distinct().collect())  # at most MOST values

    @F.pandas_udf("array<long>")
    def keys(words: pd.Series) -> pd.Series:
        return pd.Series(item_keys([np.asarray(w).view(np.uint64) for w in words]), dtype=object)

    # a key depends on the repetition and on the number of words too
    asked = spool(cut.select("item", "passage", F.explode(keys("words")).alias("k")), "asked")
    stretches = windows(docs, gram_table(cut), lengths, key_table(asked), doc, text)
    found = spool(stretches.withColumn("window", F.monotonically_increasing_id()), "windows")
    met = found.select("window", F.explode("keys").alias("k")).join(asked, "k").select("window", "item", "passage").distinct()
    pairs = met.join(found.select("window", "row", "doc", "start", "words"), "window").join(cut.withColumnRenamed("words", "wanted"), ["item", "passage"])

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), 1000):
                some = part.iloc[a : a + 1000]
                wanted = [np.asarray(w) for w in some["wanted"]]
                edits, end = best_stretch(wanted, [np.asarray(w) for w in some["words"]])
                sizes = np.array([len(w) for w in wanted])
                out = pd.DataFrame({"row": some["row"], "doc": some["doc"], "item": some["item"], "passage": some["passage"], "n_passages": some["n_passages"], "n_words": sizes, "edits": edits, "end_word": some["start"].to_numpy() + end})
                yield out[edits <= _bound(sizes)]

    d, i = docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    checked = pairs.select("row", "doc", "item", "passage", "n_passages", "start", "words", "wanted").mapInPandas(verify, f"row long, doc {d}, item {i}, passage int, n_passages int, n_words int, edits int, end_word int")
    each = checked.groupBy("row", "doc", "item", "passage", "n_passages").agg(F.min(F.struct("edits", "end_word", "n_words")).alias("b"))
    whole = each.groupBy("row", "doc", "item").agg(F.min("b").alias("b"), F.count("*").cast("int").alias("n_found"), F.max("n_passages").alias("n_passages"))
    return whole.select("row", "doc", "item", "b.n_words", "b.edits", "b.end_word", "n_found", "n_passages")
