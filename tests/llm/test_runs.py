"""Periodic runs against comparison at every period, on made texts and on the documents of the smallest tables."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from scopespark.llm import periodicruns, registry

SCHEMA = "doc_id long, text string"


def brute(w):
    """(start, length, period) of all runs, by comparing words at every distance."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s >= q:
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(12, 2 * q))


def left(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def made(rng, kind):
    two = lambda n: [rng.choice("ab") for _ in range(n)]
    if kind == 0:
        return two(rng.randrange(160))
    if kind == 1:  # powers of powers
        x = two(rng.randrange(1, 5)) * rng.randrange(1, 12) + ["c"] * rng.randrange(3)
        return (x * rng.randrange(1, 6) + two(5)) * rng.randrange(1, 3)
    if kind == 2:  # highly periodic stretches that touch out of step
        r, c = two(rng.randrange(1, 4)) * 30, rng.randrange(4)
        return r[: rng.randrange(1, 90)] + r[c : c + rng.randrange(1, 90)] + r[: rng.randrange(1, 60)]
    if kind == 3:  # Fibonacci words
        a, b = ["a"], ["a", "b"]
        while len(b) < 150:
            a, b = b, b + a
        return b[: rng.randrange(150)]
    if kind == 4:
        return [str(bin(i).count("1") % 2) for i in range(rng.randrange(200))]
    some = lambda n: [str(rng.randrange(50)) for _ in range(n)]
    base = some(rng.randrange(1, 90))
    return some(rng.randrange(20)) + base * rng.randrange(1, 5) + base[: rng.randrange(len(base))] + some(9)


def test_runs_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [made(rng, i % 6) for i in range(900)]
    texts.append([x for i in range(40) for x in [f"w{rng.randrange(9)}"] * (i % 3 + 1)] * 60)  # thousands of words
    rows = {r["doc"]: r for r in periodicruns.find(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], SCHEMA)).collect()}
    for i, w in enumerate(texts):
        want = brute(w)
        assert [(r["start"], r["length"], r["period"]) for r in rows[i]["runs"]] == want
        assert rows[i]["n_words"] == len(w) and rows[i]["collapsed"] == left(w, want)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in registry.op13_periodic_runs(spark, sf).collect()}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        want = brute(w)
        r = got[i]
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["n_runs"] == len(want)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(left(w, want).encode()).hexdigest()


def test_odd_rows(spark):
    long = "a b " * 200_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "x " * 12), (4, long), (5, "y " * 11), (6, "z" * 3_000_000), (7, "x x " * 12), (7, "x x " * 12)]
    got = periodicruns.find(spark.createDataFrame([(d, t, 1, "e", 2) for d, t in rows], SCHEMA + ", doc long, runs string, n_words long")).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc"], []).append(([tuple(x) for x in r["runs"]], r["collapsed"], r["n_words"]))
    assert by[1] == by[2] == by[3] == [([], "", 0)]
    assert by[None] == [([(0, 12, 1)], "x", 12)]
    assert by[4] == [([(0, 400_000, 2)], "a b", 400_000)]
    assert by[5] == [([], ("y " * 11).strip(), 11)] and by[6][0][2] == 1
    assert by[7] == [([(0, 12, 1)], "x x", 12)] * 2  # only ASCII white space separates
    assert periodicruns.find(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("doc, text", [(None, "a b c"), (1, None), (1, "")])
def test_repeated_leaves_odd_rows(spark, doc, text):
    row = spark.createDataFrame([(doc, text)], SCHEMA).select(periodicruns.repeated(F.col("text"), F.col("doc_id")).alias("t")).first()
    assert row["t"] == text or doc == 1
