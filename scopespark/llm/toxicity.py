"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-cased words and of their first letters, hashed into ``2**BITS`` slots.  Besides a weight for each
slot the machine learns a short vector for each slot; the inner product of two vectors is the weight
of their pair, so that terms which are harmless alone can count together.  The fit takes at most
``MAX_ROWS`` labelled rows (those of smallest id hash, a fixed choice) with all their slots; every
text is scored.  A slot that no labelled row has keeps a zero weight and a zero vector.

Null or empty text has no terms and scores the bias alone.  Without labelled rows of both classes the
score is the share of positives (0 without rows).  Of rows that share an id the smallest term set is
used for the fit, of labels that share an id the largest; null labels and ids are left out.  Equal texts
score equally; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopespark.llm import textkernel
from scopespark.session import spool

#: Texts with this score or more are toxic.
REJECT = 0.7
#: log2 of the hash slots.
BITS = 18
#: Labelled rows used by the fit, at most.
MAX_ROWS = 20_000
#: Prefixes of words, in bytes, that count as terms of their own.
PREFIXES = (4, 5)
#: Factors of each slot's vector, passes over the sample, rows per step, step size and shrinkage.
FACTORS, EPOCHS, BATCH, RATE, SHRINK = 4, 20, 64, 0.4, 1e-5


@dataclass(frozen=True)
class Machine:
    """Bias, slot weights and slot vectors."""

    bias: float
    weight: np.ndarray
    vector: np.ndarray

    def raw(self, slots: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """Score before the logistic function of ``n`` rows; row k owns slots[starts[k]:starts[k+1]]."""
        row = np.repeat(np.arange(n), np.diff(starts))
        out = np.bincount(row, weights=self.weight[slots], minlength=n) + self.bias
        for f in range(self.vector.shape[1]):
            v = self.vector[:, f][slots].astype(np.float64)
            out += 0.5 * (np.bincount(row, weights=v, minlength=n) ** 2 - np.bincount(row, weights=v * v, minlength=n))
        return out


def term_slots(texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block of texts: first and end row, the distinct slots of each row, and their offsets."""
    for lo, hi, hashes, offsets in textkernel.word_hashes(textkernel.to_bytes(texts), textkernel.PUNCTUATION, PREFIXES):
        row = np.repeat(np.arange(hi - lo, dtype=np.int64), np.diff(offsets))
        both = np.unique(row << BITS | (hashes >> np.uint64(64 - BITS)).astype(np.int64))
        yield lo, hi, both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(hi - lo + 1))


def fit(slots: np.ndarray, starts: np.ndarray, labels: np.ndarray, seed: int = 7) -> Machine:
    """Logistic loss by adaptive steps over shuffled batches; row k owns slots[starts[k]:starts[k+1]]."""
    size = 1 << BITS
    weight, vector = np.zeros(size), np.zeros((size, FACTORS))
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Machine(-30.0 if share == 0 else 30.0, weight, vector)
    rng = np.random.default_rng(seed)
    vector += rng.normal(0, 0.01, vector.shape)
    bias, seen_b = float(np.log(share / (1 - share))), 1e-8
    seen_w, seen_v = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2)
    met, place = np.zeros(size, dtype=bool), np.zeros(size, dtype=np.int64)
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            flat, n = np.concatenate([slots[starts[i] : starts[i + 1]] for i in part]), len(part)
            sizes = starts[part + 1] - starts[part]
            row = np.repeat(np.arange(n), sizes)
            raw = Machine(bias, weight, vector).raw(flat, np.concatenate(([0], np.cumsum(sizes))), n)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]) / n
            met[flat] = True
            used = np.flatnonzero(met)
            met[used] = False
            place[used] = np.arange(len(used))
            back = place[flat]
            g = np.bincount(back, weights=slope[row], minlength=len(used)) + SHRINK * weight[used]
            seen_w[used] += g * g * n
            weight[used] -= RATE * g * np.sqrt(n) / np.sqrt(seen_w[used])
            for f in range(FACTORS):
                v = vector[:, f]
                own = v[flat]
                total = np.bincount(row, weights=own, minlength=n)
                g = np.bincount(back, weights=slope[row] * (total[row] - own), minlength=len(used)) + SHRINK * v[used]
                seen_v[used, f] += g * g * n
                vector[used, f] -= RATE / 4 * g * np.sqrt(n) / np.sqrt(seen_v[used, f])
            g = float(slope.sum())
            seen_b += g * g * n
            bias -= RATE * g * np.sqrt(n) / np.sqrt(seen_b)
    met[slots] = True
    vector[~met] = 0  # never fitted: no random start in the scores
    return Machine(bias, weight.astype(np.float32), vector.astype(np.float32))


def held_out(doc: Column, folds: int = 3, fold: int = 1) -> Column:
    """Rows never used for fitting: crc32 of the id as text falls into ``fold``; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> Machine:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold."""
    usable = labels.where(F.col(doc).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(doc)))
    chosen = usable.groupBy(doc).agg(F.max(label).alias("y")).orderBy(F.xxhash64(doc), doc).limit(max_rows)
    picked = docs.select(doc, text).join(F.broadcast(chosen), doc)

    def featurise(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            slots = [s[a:b].astype(np.int32) for _, _, s, o in term_slots(part[text]) for a, b in zip(o, o[1:])]
            yield pd.DataFrame({"doc": part[doc], "y": part["y"].astype("int32"), "slots": slots})

    kind = docs.schema[doc].dataType.simpleString()
    rows = picked.mapInPandas(featurise, f"doc {kind}, y int, slots array<int>")
    rows = spool(rows.groupBy("doc", "y").agg(F.min("slots").alias("slots")), "labelled")
    # at most MAX_ROWS rows come to the driver, their slots as one packed array of 32-bit numbers
    sample = rows.orderBy("doc").select("y", "slots").toArrow().combine_chunks()
    packed = sample["slots"].combine_chunks()
    starts = np.concatenate(([0], np.cumsum(np.diff(packed.offsets.to_numpy()), dtype=np.int64)))
    return fit(packed.flatten().to_numpy(), starts, (sample["y"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a probability for each text; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for part in parts:
            raw = [m.raw(slots, offsets, hi - lo) for lo, hi, slots, offsets in term_slots(part)]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.concatenate(raw), -30, 30))) if raw else np.zeros(0))

    return docs.withColumn(out, probability(F.col(text)))
