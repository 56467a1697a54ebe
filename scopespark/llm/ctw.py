"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text is scored as its lower-cased words joined by single spaces and closed by an end byte.  Each
byte is eight binary decisions; each decision has a tree whose nodes are the last 0 to DEPTH bytes.
A node estimates its bit by Krichevsky and Trofimov, and the weighting mixes the estimates of all
depths: from the training counts the block probability of every node is compared with the product of
its children's weighted probabilities, and that ratio fixes the share that a node's own estimate has
against the deeper ones when the frozen tree predicts.  Where no deeper node has been seen, the node's
own estimate stands.

All nodes are kept.  The distinct grams of the corpus (a byte behind DEPTH bytes) with their counts are
grouped by the last SPLIT bytes of the context: a group holds whole subtrees, and at most 256 ** (DEPTH -
SPLIT + 1) grams however large the corpus.  One pass over the groups weighs their subtrees from the leaves
up; the few levels above are grouped aggregates; a second pass mixes from the root down and gives the log
probability of every distinct gram.  Texts sum these: a table of fixed size, with whole keys, goes to every
task and holds the most frequent gram of each of GRAM_SLOTS hash slots; all other occurrences go through a
join with the table of all grams.  Words for the unigram base are handled alike.

Null or empty text is the end byte alone.  A row with a null id is held out.  Repeated rows count, and are
scored, each on its own; texts of any length are scored whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopespark.llm import textkernel
from scopespark.session import spool

#: Bytes of context at most (up to 6: a context, a byte and a bit prefix share a 64-bit key), and of the
#: contexts whose subtrees are solved together.
DEPTH, SPLIT = 5, 3
#: Hash slots of the tables of grams and words that every task has.
GRAM_SLOTS, WORD_SLOTS = 1 << 22, 1 << 20
#: Entries that a task holds before it adds them up, grams solved and bytes handled at once.
HOLD, SOLVE, PIECE = 1_200_000, 20_000, 1 << 18

_TEXT, _GRAM = 0, 1
_LOG2, _LOG_PI = float(np.log(2)), float(np.log(np.pi))


def canonical(text) -> bytes:
    """Lower-cased words, single spaces, end byte."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    return b" ".join(raw.lower().split()) + b"\n"


def grams(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(DEPTH + 1)-grams that end at every byte of the rows, and the offset of each row's first one.

    Before its first byte a row has end bytes as context.
    """
    pad = b"\n" * DEPTH
    buf = np.frombuffer(b"".join(pad + r for r in rows), dtype=np.uint8).astype(np.uint64)
    n = len(buf) - DEPTH
    g = np.zeros(n, dtype=np.uint64)
    for k in range(DEPTH + 1):
        g = g << np.uint64(8) | buf[k : n + k]
    sizes = np.array([len(r) for r in rows])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    keep = np.repeat(np.arange(len(rows)) * DEPTH, sizes) + np.arange(starts[-1])
    return g[keep], starts


def gram_blocks(rows: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, gram) of all bytes of the rows; a single row of any length comes in blocks."""
    if len(rows) > 1:
        g, starts = grams(rows)
        yield np.repeat(np.arange(len(rows)), np.diff(starts)), g
        return
    for a in range(0, len(rows[0]), PIECE):
        before = min(a, DEPTH)  # these grams belong to the block before
        g = grams([rows[0][a - before : a + PIECE]])[0][before:]
        yield np.zeros(len(g), dtype=np.int64), g


def pieces(texts) -> Iterator[tuple[int, int, list[bytes]]]:
    """Blocks of canonical rows of about PIECE bytes, made one after the other; a longer row stands alone."""
    lo, total, rows = 0, 0, []
    for text in texts:
        row = canonical(text)
        if rows and total + len(row) > PIECE:
            yield lo, lo + len(rows), rows
            lo, total, rows = lo + len(rows), 0, []
        rows.append(row)
        total += len(row) + 1
    if rows:
        yield lo, lo + len(rows), rows


class Sums:
    """Counts (key, n, seen) of one task in arrays of fixed size, added up by key whenever these are full."""

    def __init__(self, size: int):
        self.held, self.used = np.empty((3, size), dtype=np.int64), 0

    def add(self) -> None:
        key, n, seen = self.held[:, : self.used]
        order = np.argsort(key)
        ranked = key[order]
        at = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), dtype=bool), ranked[1:] != ranked[:-1])))
        self.used = len(at)
        for old, new in ((n, np.add.reduceat(n[order], at)), (seen, np.add.reduceat(seen[order], at)), (key, ranked[at])) if len(at) else ():
            old[: len(at)] = new

    def out(self) -> Iterator[np.ndarray]:
        for a in range(0, self.used, 200_000):
            yield self.held[:, a : min(a + 200_000, self.used)].copy()
        self.used = 0

    def put(self, key: np.ndarray, n: np.ndarray | int, seen: np.ndarray) -> Iterator[np.ndarray]:
        """Takes counts in; yields all of them where adding up leaves more than half."""
        size = self.held.shape[1]
        for a in range(0, len(key), size // 2):
            some = slice(a, a + size // 2)
            k = len(key[some])
            if self.used + k > size:
                self.add()
                if self.used > size // 2:
                    yield from self.out()
            into = self.held[:, self.used : self.used + k]
            into[0], into[1], into[2] = key[some].view(np.int64), n if np.ndim(n) == 0 else n[some], seen[some]
            self.used += k


def _slot(key: np.ndarray, slots: int) -> np.ndarray:
    return (textkernel.mix64(key + np.uint64(0x632BE59BD9B4E019)) & np.uint64(slots - 1)).astype(np.int64)


def held_out(doc: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))


def count(docs: DataFrame, text: str = "text", held: str = "held_out") -> DataFrame:
    """(kind, key, n, seen): word hashes of training rows and grams of all rows; tasks add up before the shuffle.

    ``n`` counts training rows only, ``seen`` all rows.
    """

    def tally(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {_TEXT: Sums(HOLD), _GRAM: Sums(HOLD)}

        def batches(kind: int, full: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for key, n, seen in full:
                yield pa.RecordBatch.from_pydict({"kind": np.full(len(key), kind, dtype=np.int32), "key": key, "n": n, "seen": seen})

        for part in parts:
            out = part.column(held).to_numpy(zero_copy_only=False)
            for train in (1, 0):
                for _, _, rows in pieces(x.as_py() for x, left in zip(part.column(text), out) if left != train):
                    for _, g in gram_blocks(rows):
                        keys, n = np.unique(g, return_counts=True)
                        yield from batches(_GRAM, sums[_GRAM].put(keys, n if train else 0, n))
                    for _, _, words, _ in textkernel.word_hashes(rows) if train else ():
                        keys, n = np.unique(words, return_counts=True)
                        yield from batches(_TEXT, sums[_TEXT].put(keys, n, n))
        for kind, own in sums.items():
            own.add()
            yield from batches(kind, own.out())

    each = docs.select(text, held).mapInArrow(tally, "kind int, key long, n long, seen long")
    return each.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def _log_gamma(x, log):
    """Stirling's series at x + 7 and the recurrence back; x > 0; for columns and arrays."""
    y = x + 7
    series = (y - 0.5) * log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - log(x) - log((x + 1) * (x + 2) * (x + 3)) - log((x + 4) * (x + 5) * (x + 6))


def _block(n0, n1, log):
    """Log of the estimator's probability of n0 zeros and n1 ones in a row."""
    return _log_gamma(n0 + 0.5, log) + _log_gamma(n1 + 0.5, log) - _log_gamma(n0 + n1 + 1.0, log) - _LOG_PI


class Level:
    """Nodes of one depth as arrays: keys (context and node), counts, log weights, place of each one's parent."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.key, self.n0, self.n1 = key, n0, n1
        self.one = (n1 + 0.5) / (n0 + n1 + 1)
        own = _block(n0, n1, np.log)
        if below is None:
            self.share, self.log_w = np.ones(len(key)), own
        else:
            self.share = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
            self.log_w = np.logaddexp(own, below) - _LOG2


def climb(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[Level], list[np.ndarray]]:
    """Subtrees of distinct grams ``g``, from depth DEPTH up to SPLIT.

    Returns, for each gram and bit, its node among those of depth DEPTH; the levels, deepest first; and for
    each level but the last the place of each node's parent.  Grams of count 0 make nodes without counts.
    """
    context, byte = g >> np.uint64(8), g & np.uint64(255)
    k = np.arange(8, dtype=np.uint64)
    node = np.uint64(1) << k | byte[:, None] >> (np.uint64(8) - k)
    key, at = np.unique((context[:, None] << np.uint64(8) | node).ravel(), return_inverse=True)
    one = (byte[:, None] >> (np.uint64(7) - k) & np.uint64(1)).ravel() == 1
    times = np.repeat(n, 8).astype(np.float64)
    count = lambda w: np.bincount(at, weights=w, minlength=len(key))
    levels, ups = [Level(key, count(times * ~one), count(times * one), None)], []
    for d in range(DEPTH - 1, SPLIT - 1, -1):
        low = levels[-1]
        key, up = np.unique(low.key & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
        add = lambda w: np.bincount(up, weights=w, minlength=len(key))  # noqa: E731,B023
        levels.append(Level(key, add(low.n0), add(low.n1), add(low.log_w)))
        ups.append(up)
    return at.reshape(-1, 8), levels, ups


def descend(level: Level, left: np.ndarray, sure: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mix one level into what comes from above: share left for deeper nodes, sum of the estimates so far,
    and the probability of a one if nothing deeper has been seen."""
    seen = level.n0 + level.n1 > 0
    stop = np.where(seen, sure + left * level.one, stop)
    return left * (1 - level.share), sure + left * level.share * level.one, stop


def _groups(parts: Iterator[pd.DataFrame], by: str, size: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``by`` in frames of about ``size`` rows that never cut a group."""
    held: list[pd.DataFrame] = []
    for part in parts:
        held.append(part)
        if sum(map(len, held)) >= size:
            rows = pd.concat(held)
            value = rows[by].to_numpy()
            cut = int(np.searchsorted(value, value[-1]))
            if cut:
                yield rows.iloc[:cut]
            held = [rows.iloc[cut:]]
    if held and (rows := pd.concat(held)).size:
        yield rows


def gram_values(counted: DataFrame, slots: int, solve: int = SOLVE) -> DataFrame:
    """(key, slot, seen, value): log10 probability of the last byte of every gram of ``counted`` (key, n, seen)."""
    group = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * SPLIT) - 1)).alias("c")
    counted = counted.select(group, "key", "n", "seen")

    def up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(parts, "c", solve):
            top = climb(rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy())[1][-1]
            yield pd.DataFrame({"key": top.key.view(np.int64), "n0": top.n0, "n1": top.n1, "log_w": top.log_w})

    dealt = lambda x: x.repartition("c").sortWithinPartitions("c")
    level = spool(dealt(counted).mapInPandas(up, "key long, n0 double, n1 double, log_w double"), "level")
    levels = [level]
    for d in range(SPLIT - 1, -1, -1):
        parent = F.col("key").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1))
        level = level.groupBy(parent.alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_w").alias("below"))
        gap = _block(F.col("n0"), F.col("n1"), F.log) - F.col("below")
        log_w = F.greatest(gap, F.lit(0.0)) + F.col("below") + F.log(1 + F.exp(-F.abs(gap))) - _LOG2
        level = spool(level.select("key", "n0", "n1", log_w.alias("log_w"), (1 / (1 + F.exp(-gap))).alias("share")), "level")
        levels.append(level)
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    above = None
    for d, level in enumerate(reversed(levels)):
        if above is None:
            entered = level.select("*", F.lit(1.0).alias("left"), F.lit(0.0).alias("sure"), F.lit(0.5).alias("stop"))
        else:
            parent = F.col("key").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("parent")
            entered = level.select("*", parent).join(above.withColumnRenamed("key", "parent"), "parent")
        if d == SPLIT:
            break
        stop = F.when(F.col("n0") + F.col("n1") > 0, F.col("sure") + F.col("left") * one).otherwise(F.col("stop"))
        above = entered.select("key", (F.col("left") * (1 - F.col("share"))).alias("left"), (F.col("sure") + F.col("left") * F.col("share") * one).alias("sure"), stop.alias("stop"))
    none = F.lit(None).cast("double")
    mixed = counted.select("c", "key", "n", "seen", none.alias("left"), none.alias("sure"), none.alias("stop")).unionByName(
        entered.select(F.shiftright("key", 8).alias("c"), "key", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("seen"), "left", "sure", "stop")
    )

    def down(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(parts, "c", solve):
            top = rows["n"].isna().to_numpy()
            own, start = rows[~top], rows[top].sort_values("key")
            g = own["key"].to_numpy().view(np.uint64)
            at, levels, ups = climb(g, own["n"].to_numpy(dtype=np.float64))
            if not np.array_equal(levels[-1].key, start["key"].to_numpy().view(np.uint64)):
                raise ValueError("a group of grams was cut")
            state = [start[c].to_numpy() for c in ("left", "sure", "stop")]
            for k in range(len(levels) - 1, -1, -1):
                state = list(descend(levels[k], *state))
                if k:
                    state = [x[ups[k - 1]] for x in state]
            p = np.clip(state[2], 1e-12, 1 - 1e-12)
            zero, one = np.log10(1 - p), np.log10(p)
            bit = (g[:, None] >> (np.uint64(7) - np.arange(8, dtype=np.uint64)) & np.uint64(1)) == 1
            value = np.where(bit, one[at], zero[at]).sum(axis=1)
            yield pd.DataFrame({"key": own["key"], "slot": _slot(g, slots), "seen": own["seen"].astype("int64"), "value": value})

    return dealt(mixed).mapInPandas(down, "key long, slot long, seen long, value double")


def _head(table: DataFrame, slots: int, value: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of the most frequent entry of each slot; at most ``slots`` rows come to the driver."""
    best = table.groupBy("slot").agg(F.max(F.struct("seen", "key", value)).alias("b")).select("slot", "b.key", f"b.{value}").toArrow()
    key, out = np.full(slots, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(slots, dtype=kind)
    at = best["slot"].to_numpy()
    key[at], out[at] = best["key"].to_numpy().view(np.uint64), best[value].to_numpy()
    return key, out


def score(docs: DataFrame, doc: str = "doc_id", text: str = "text", gram_slots: int = GRAM_SLOTS, solve: int = SOLVE) -> DataFrame:
    """(doc, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes) per row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), held_out(F.col(doc)).alias("held_out"))
    counts = spool(count(rows), "counts")
    ends = rows.where("not held_out").count()
    words = counts.where(F.col("kind") == _TEXT).select("key", "n", "seen")
    seen = words.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    total, distinct = (seen["n"] or 0) + ends, seen["v"] + (ends > 0)
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    values = spool(gram_values(counts.where(F.col("kind") == _GRAM).select("key", "n", "seen"), gram_slots, solve), "values")
    gram_key, gram_value = _head(values, gram_slots, "value", np.float32)
    word_key, word_n = _head(words.withColumn("slot", F.col("key").bitwiseAND(F.lit(WORD_SLOTS - 1))), WORD_SLOTS, "n", np.int64)
    shared = spark.sparkContext.broadcast((gram_key, gram_value, word_key, np.log10(word_n + 0.5)))
    del gram_key, gram_value, word_key, word_n

    def counted(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (row, key) and how often each occurs."""
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        at = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1]))))
        return row[at], key[at].view(np.int64), np.diff(np.append(at, len(row)))

    def made(part: pa.RecordBatch, size: int, **own) -> pa.RecordBatch:
        """``size`` rows of ``scores``: what isn't given is 0, or null for a document or key."""
        whole, real = pa.int64(), pa.float64()
        kinds = {"row": whole, "doc": part.schema.field("doc").type, "n_tokens": whole, "n_known": whole, "base": real, "score": real, "n_bytes": whole, "kind": pa.int32(), "key": whole, "n": pa.int32()}
        zero = lambda c, t: pa.nulls(size, t) if c in ("doc", "kind", "key") else pa.array(np.zeros(size), t)
        return pa.RecordBatch.from_pydict({c: own[c] if isinstance(own.get(c), pa.Array) else pa.array(own[c], t) if c in own else zero(c, t) for c, t in kinds.items()})

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_key, gram_value, word_key, word_log = shared.value
        for part in parts:
            numbers = part.column("row").to_numpy()
            for lo, hi, texts in pieces(x.as_py() for x in part.column("text")):
                rest: list[tuple] = []
                score = np.zeros(hi - lo)
                for own, some in gram_blocks(texts):
                    s = _slot(some, gram_slots)
                    hit = gram_key[s] == some
                    score += np.bincount(own, weights=np.where(hit, gram_value[s], 0), minlength=hi - lo)
                    if not hit.all():
                        rest.append((_GRAM, *counted(own[~hit], some[~hit])))
                tokens, known, base = [], [], []
                for a, b, hashes, offsets in textkernel.word_hashes(texts):
                    s = (hashes & np.uint64(WORD_SLOTS - 1)).astype(np.int64)
                    hit = word_key[s] == hashes
                    row = np.repeat(np.arange(b - a), np.diff(offsets))
                    tokens += (np.diff(offsets) + 1).tolist()
                    known += (np.bincount(row[hit], minlength=b - a) + (ends > 0)).tolist()
                    base += (np.bincount(row[hit], weights=word_log[s[hit]], minlength=b - a) + np.log10(ends + 0.5)).tolist()
                    if not hit.all():
                        rest.append((_TEXT, *counted(row[~hit] + a, hashes[~hit])))
                yield made(part, hi - lo, row=numbers[lo:hi], doc=part.column("doc").slice(lo, hi - lo), n_tokens=tokens, n_known=known, base=base, score=score, n_bytes=[len(x) for x in texts])
                for kind, row, key, n in rest:
                    yield made(part, len(row), row=numbers[lo + row], kind=np.full(len(row), kind), key=key, n=n)

    kind = docs.schema[doc].dataType.simpleString()
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc", "text")
    each = spool(numbered.mapInArrow(measure, f"row long, doc {kind}, n_tokens long, n_known long, base double, score double, n_bytes long, kind int, key long, n int"), "scores")
    table = values.select(F.lit(_GRAM).alias("kind"), "key", "value").unionByName(words.select(F.lit(_TEXT).alias("kind"), "key", F.log10(F.col("n") + 0.5).alias("value")))
    others = each.where("key is not null").select("row", "kind", "key", "n").join(table, ["kind", "key"], "left")
    is_word = F.col("kind") == _TEXT
    of = lambda which, x: F.sum(F.when(which, x).otherwise(0))
    value = F.col("n") * F.coalesce("value", F.lit(float(np.log10(0.5))))
    others = others.groupBy("row").agg(of(is_word & F.col("value").isNotNull(), F.col("n")).alias("k"), of(is_word, value).alias("l"), of(~is_word, value).alias("g"))
    return each.where("key is null").drop("key", "n", "kind").join(others, "row", "left").select(
        "doc",
        held_out(F.col("doc")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("l", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("score") + F.coalesce("g", F.lit(0.0))).alias("score"),
        "n_bytes",
        ((F.col("score") + F.coalesce("g", F.lit(0.0))) * (-3.321928094887362) / F.col("n_bytes")).alias("bits_per_byte"),
    )
