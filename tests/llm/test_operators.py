"""Operators against brute force on small fixtures, and defined results for odd rows."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from scopespark.llm import bpe, ctw, decontam, grouping_sa, itq, minhash, secretscan, sharding, suffixdedup, tokencount, toxicity
from scopespark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, seg int"
WORDS = "the of and a river stone window letter garden winter copper lantern meadow violet harbor thunder saffron".split()


def _text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and long texts, ties, repeated rows, columns with clashing names."""
    long = _text(1, 4000)
    base = _text(2, 120)
    near = base.replace("river", "brook", 1)
    texts = [(0, base), (1, base), (2, near), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (6, "one two"), (None, base), (7, long), (8, "x" * 3000), (9, _text(3, 90) + " " + base)]
    rows = [(i, t, "en" if i else None, None if i == 3 else "src1", None if i == 4 else len(t or ""), 7, "k", 1) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_hilbert_curve_is_continuous():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = np.argsort(sharding.hilbert_index(grid, 3))
    assert np.abs(np.diff(grid[order], axis=0)).sum(axis=1).max() == 1


def test_shards(spark, odd, empty):
    rows = odd.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8)
    out = sharding.hilbert_shards(rows, ["lang", "source", "n_chars"], "size", ["doc_id", "size"], 3).collect()
    assert len(out) == 12
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sharding.hilbert_shards(empty.withColumn("size", F.lit(1).cast("long")), ["lang"], "size", ["doc_id"], 3).count() == 0


def test_shards_carry_and_write_all_columns(spark, odd, tmp_path):
    rows = odd.select("doc_id", "lang", F.lit(5).cast("long").alias("total"), *[F.lit(i).alias(c) for i, c in enumerate(("part", "first", "before_rows", "before_weight", "curve", "shard", "n", "w"))])
    out = sharding.hilbert_shards(rows, ["lang"], "total", ["doc_id"], 3)
    assert out.columns == ["doc_id", "lang", "total", "part", "first", "before_rows", "before_weight", "n", "w", "curve", "shard", "slot"]
    assert {(r.part, r.first, r.before_rows, r.before_weight, r.n, r.w) for r in out.collect()} == {(0, 1, 2, 3, 6, 7)}
    sharding.write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.doc_id or -1, r.shard, r.slot) for r in back.collect()) == sorted((r.doc_id or -1, r.shard, r.slot) for r in out.collect())
    for s in range(3):
        for name in (tmp_path / "shards" / f"shard={s}").glob("*.parquet"):
            slots = [r.slot for r in spark.read.parquet(str(name)).collect()]
            assert slots == sorted(slots)


def test_minhash(spark, odd, empty):
    out = minhash.near_duplicates(odd).collect()
    assert len(out) == 12
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    sets = {d: _shingles(t) for d, t in texts.items()}
    for r in out:
        if r.doc is not None:
            reach, todo = {r.doc}, [r.doc]
            while todo:
                a = todo.pop()
                for b in sets:
                    if b not in reach and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                        reach.add(b)
                        todo.append(b)
            assert (r.n_shingles, r.component, r.kept) == (len(sets[r.doc]), min(reach), min(reach) == r.doc)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.one_of_each(odd.where("doc_id is not null").withColumn("k", F.concat_ws(":", "doc_id", "text")), "k")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 8, 9]


def test_minhash_group_without_a_central_member(spark):
    """A chain of near copies far apart at its ends: every link has to be found."""
    words = _text(5, 400).split()
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words)))
        at = 13 * i
        words[at : at + 3] = [f"w{i}a", f"w{i}b", f"w{i}c"]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component for r in out} == {0} and sum(r.kept for r in out) == 1


def _classes(rows):
    """Components of (id, text) rows by brute force: for each row the smallest id it reaches."""
    sets = [_shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group = [group[i] if g == group[j] else g for g in group]
    low = {}
    for (d, _), s, g in zip(rows, sets, group):
        low[g] = min((x for x in (d, low.get(g)) if x is not None), default=None)
    return collections.Counter((d, len(s), low[g]) for (d, _), s, g in zip(rows, sets, group))


def test_minhash_large_group_beyond_the_threshold(spark):
    """Copies of one text with ever more edits, a common passage, repeated and null ids."""
    rng = np.random.default_rng(8)
    base, passage = _text(6, 150).split(), _text(7, 60)
    base[::3] = [f"{w}{i}" for i, w in enumerate(base[::3])]
    rows = []
    for i in range(240):
        words = list(base)
        for at in rng.choice(150, i % 14, replace=False):
            words[at] = f"x{rng.integers(1000)}"
        rows.append((i + 10, " ".join(words)))
    rows += [(400 + i, passage + " " + " ".join(f"y{x}" for x in rng.integers(0, 10**6, 12 + i % 9))) for i in range(120)]
    near = " ".join(["other", *base[1:]])
    # one id with two texts, of which the second links; a text without an id that links two others
    rows += [(5, _text(9, 80)), (5, near), (None, " ".join(base[:70] + ["z"] * 10)), (None, _text(10, 50)), (None, _text(10, 50))]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert collections.Counter((r.doc, r.n_shingles, r.component) for r in out) == _classes(rows)
    assert all(r.kept == (r.doc is not None and r.doc == r.component) for r in out)


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    label = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {n: c for n, c in label.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_token_counts(spark, odd, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(20, "ΑΣ don't <|endoftext|> ½Ⅷ é İ　x", None, None, 1, 1, "", 1)], SCHEMA)
    for slots in (4, tokencount.SLOTS):  # nearly everything through the join, or through the head
        out = tokencount.token_counts(odd.union(extra), path, slots=slots).collect()
        want = collections.Counter((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.union(extra).collect())
        assert collections.Counter((r.doc, r.n_bytes, r.n_tokens) for r in out) == want
    assert tokencount.token_counts(empty, path).count() == 0


def test_decontamination(spark, odd, empty):
    items = spark.createDataFrame([(1, _text(11, 30)), (2, _text(12, 200)), (3, "too short"), (4, None), (5, _text(11, 30)), (5, _text(11, 30))], "item_id long, text string")
    edited = _text(11, 30).split()
    edited[10] = "changed"
    del edited[20]
    leaks = [(100, _text(13, 50) + " " + _text(11, 30).upper() + " tail"), (101, _text(14, 40) + " " + " ".join(edited)), (102, _text(12, 200)), (103, _text(15, 300)), (None, _text(11, 30))]
    leaks += [(104, " ".join(_text(12, 200).split()[:70])), (105, "this is TOO\nshort"), (106, "too very short"), (100, leaks[0][1])]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(leaks, "doc_id long, text string"))
    found = decontam.contaminated(docs.withColumn("row", F.lit(1)), items.withColumn("passage", F.lit("x"))).collect()
    got = {(r.doc, r.item): r.edits for r in found}
    assert sum((r.doc, r.item) == (100, 1) for r in found) == 2  # repeated rows are each reported
    assert {(r.doc, r.n_found, r.n_passages) for r in found if r.item == 2} == {(102, 4, 4), (104, 1, 4)}
    assert {k for k in got if k[1] == 3} == {(105, 3)}
    assert {r.doc for r in found if r.item == 5} == {r.doc for r in found if r.item == 1}
    assert not {r.item for r in decontam.contaminated(docs, items, least=5).collect()} & {3}
    want = {}
    texts = {r.item_id: r.text for r in items.collect()}
    for d in docs.collect():
        words = (d.text or "").lower().split()
        p = texts[1].split()
        row = [0] * (len(words) + 1)
        for i, w in enumerate(p):  # exact distance to the best stretch
            new = [i + 1]
            for j, x in enumerate(words):
                new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
            row = new
        if min(row) <= len(p) // decontam.EDITS_PER:
            want[(d.doc_id, 1)] = min(row)
    assert {k: v for k, v in got.items() if k[1] == 1} == want
    assert not {k for k in got if k[1] == 4}
    assert decontam.contaminated(empty, items).count() == 0
    assert decontam.contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_beside_another_item(spark):
    word = lambda i, k: f"w{i}x{k}"
    items, docs = [], []
    for i in range(0, 120, 2):  # the item before has a fifth of its words replaced, the next one follows word by word
        n = (20, 30, 40)[i % 3]
        own, other = [word(i, k) for k in range(n)], [word(i + 1, k) for k in range(n)]
        items += [(i, " ".join(own)), (i + 1, " ".join(other))]
        for k in np.random.default_rng(i).choice(n, n // 5, replace=False):
            own[k] = f"new{k}"
        docs.append((i, " ".join(["in"] * 9 + own + other + ["out"] * 9)))
    five = "five words make this item".split()
    items.append((1000, " ".join(five)))
    docs += [(1000 + p, "so " + " ".join(five[:p] + ["new"] + five[p + 1 :])) for p in range(5)]
    docs += [(1010 + p, "so " + " ".join(five[:p] + five[p + 1 :]) + " it is") for p in range(5)]
    docs += [(1020 + p, " ".join(five[:p] + ["new"] + five[p:])) for p in range(1, 5)]
    docs.append((1030, "five words new new item"))
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc, r.item) for r in found}
    assert sum((i, i) in got for i in range(0, 120, 2)) >= 57 and all((i, i + 1) in got for i in range(0, 120, 2))
    assert {d for d, i in got if i == 1000} == {*range(1000, 1005), *range(1010, 1015), *range(1021, 1025)}


def _context_trees(rows, depth):
    """log10 probability of each row's text by direct recursion over all nodes; rows of (id, text)."""

    def bits(text):
        data = b"\n" * depth + ctw.canonical(text)
        for i in range(depth, len(data)):
            for k in range(8):
                yield data[i - depth : i], (1 << k) | data[i] >> (8 - k), data[i] >> (7 - k) & 1

    counts = collections.defaultdict(lambda: [0, 0])
    children = collections.defaultdict(set)
    for d, text in rows:
        if d is not None and zlib.crc32(str(d).encode()) % 5 != 1:
            for context, node, bit in bits(text):
                for k in range(depth + 1):
                    counts[context[depth - k :], node][bit] += 1
                    if k:
                        children[context[depth - k + 1 :], node].add(context[depth - k :])

    def block(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    memo = {}

    def weighted(context, node):
        """(log weighted probability, share of the node's own estimate)"""
        if (context, node) not in memo:
            own = block(counts[context, node])
            if len(context) == depth:
                memo[context, node] = own, 1.0
            else:
                below = sum(weighted(c, node)[0] for c in children[context, node])
                memo[context, node] = float(np.logaddexp(own, below)) - math.log(2), float(1 / (1 + np.exp(min(below - own, 700))))
        return memo[context, node]

    def one(context, node):
        if (b"", node) not in counts:
            return 0.5
        chain = [k for k in range(depth + 1) if (context[depth - k :], node) in counts]
        p = None
        for k in reversed(chain):
            c = context[depth - k :]
            n = counts[c, node]
            kt = (n[1] + 0.5) / (sum(n) + 1)
            share = weighted(c, node)[1]
            p = kt if p is None else share * kt + (1 - share) * p
        return p

    return [sum(math.log10(one(c, v) if bit else 1 - one(c, v)) for c, v, bit in bits(text)) for _, text in rows]


def test_context_tree(spark, odd, empty):
    rows = [(i, _text(i, 12).replace("river", f"ri{i}ver").title()) for i in range(40, 52)] + [(None, "stone É z"), (77, "q" * 40)]
    docs = odd.where("length(text) < 1000 or text is null").select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + ["\0"] for _, t in rows]
    train = [w for (d, _), t in zip(rows, tokens) for w in t if d is not None and zlib.crc32(str(d).encode()) % 5 != 1]
    counts, n, v = collections.Counter(train), len(train), len(set(train))
    base = [sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t) for t in tokens]
    want = sorted(zip(map(len, tokens), (sum(counts[w] > 0 for w in t) for t in tokens), base, _context_trees(rows, ctw.DEPTH)))
    for slots, solve in ((ctw.GRAM_SLOTS, ctw.SOLVE), (16, 50)):  # through the table, or nearly all through the join
        out = ctw.score(docs, gram_slots=slots, solve=solve).collect()
        got = sorted((r.n_tokens, r.n_known, r.base_score, r.score) for r in out)
        assert len(got) == len(want) and all(r.train_tokens == n for r in out)
        assert all(g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], rel=1e-6) for g, w in zip(got, want))
    assert ctw.score(odd).count() == 12 and ctw.score(empty).count() == 0


def test_context_tree_long_text_in_blocks(monkeypatch):
    row = ctw.canonical(_text(3, 300))
    whole = ctw.grams([row])[0]
    monkeypatch.setattr(ctw, "PIECE", 64)
    assert np.array_equal(np.concatenate([g for _, g in ctw.gram_blocks([row])]), whole)


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for n in (1, 7, 40):
        for k in (1, 2, 4):
            rows = np.concatenate([rng.integers(1, k + 1, (50, n)), np.zeros((50, 1), int)], axis=1).astype(np.int16)
            for row in rows.tolist():
                assert grouping_sa.suffix_array(row) == sorted(range(len(row)), key=lambda i: row[i:])


@pytest.mark.parametrize("most", [2, 512])
def test_suffix_dedup(spark, odd, empty, monkeypatch, most):
    monkeypatch.setattr(suffixdedup, "MOST", most)
    passage = _text(21, 25)
    more = [(30 + i, _text(40 + i, 30) + (passage if i % 3 else passage[:60]) + _text(80 + i, 20)) for i in range(25)] + [(60, "ab" * 200), (61, "ab" * 90), (62, "é" * 100), (63, "é" * 26)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    low = {}
    for d, b in rows:
        if d is not None:
            for i in range(len(b) - 49):
                s = b[i : i + 50]
                low[s] = min(low.get(s, d), d)
    want = []
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and low[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((str(d), len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = [(str(r.doc), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffixdedup.remove(docs).collect()]
    assert sorted(got) == sorted(want)
    if most == 512:
        assert suffixdedup.remove(empty).count() == 0


def test_secrets(spark, odd, empty):
    key = "AKIA" + "Q7" * 9
    live = "zq81Kd02mWp55xTr99Lb"
    rows = [(0, f"é API_KEY: 'abc' token=\"{live[:12]}\" {key} {'0a' * 14}", "s1"), (1, f"bare {live} here", "s1"), (2, None, None), (3, "secret = x=yzw1", "s2")]
    rows += [(10 + i, "sample Zx12Cv34Bn56Mk78Lp90 text", f"s{i}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc: r for r in secretscan.scan(docs).withColumn("w", secretscan.written(F.col("spans"))).collect()}
    text = rows[0][1]
    assert out[0].w == ",".join(f"{k}:{text.index(s)}:{text.index(s) + len(s)}" for k, s in (("assign", f'token="{live[:12]}'), ("access", key), ("hex", "0a" * 14)))
    assert out[1].w == f"owned:5:{5 + len(live)}" and out[2].w == "" and out[3].w == "assign:0:15"
    assert all(out[10 + i].w == "" for i in range(4))  # four owners: a copied example
    # a value is counted wherever it stands: in an assignment, bare, copied within one owner
    more = [(20 + i, f"token={live[::-1]}", f"s{i}") for i in range(5)] + [(30, f"bare {live[::-1]}", "s1"), (None, None, None)]
    more += [(40 + i, f"see {live.lower()} twice {live.lower()}", None) for i in range(secretscan.MOST_REPOSITORIES + 1)] + [(60, "z" * 30_000 + " " + live.swapcase(), None)]
    spread = {r.doc: (r.w, r.s) for r in secretscan.scan(spark.createDataFrame(more, "doc_id long, text string, source string").withColumn("row", F.lit(1)).withColumn("hash", F.lit(""))).withColumn("w", secretscan.written(F.col("spans"))).withColumn("s", secretscan.spread(F.col("spans"))).collect()}
    assert spread[20] == ("assign:0:26", "5:6") and spread[30] == ("", "") and spread[40] == ("", "") and spread[None] == ("", "")
    assert spread[60] == (f"owned:30001:{30001 + len(live)}", "1:1")
    masked = secretscan.scan(docs).join(docs.withColumnRenamed("doc_id", "doc"), "doc").select("doc", secretscan.redact(F.col("text"), F.col("spans")).alias("t"))
    assert {r.doc: r.t for r in masked.collect()}[1] == "bare [SECRET] here"
    assert secretscan.scan(odd).count() == 12 and secretscan.scan(empty).count() == 0


def test_toxicity(spark, odd, empty):
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, _text(i, 20) + (" you vile moron" if bad else "")))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs, marks)
    out = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    assert all((out[i] >= toxicity.REJECT) == bool(y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1)
    assert toxicity.score(odd, machine).count() == 12
    assert [r.score < 0.01 for r in toxicity.score(odd, toxicity.train(docs, marks.limit(0))).collect()] == [True] * 12
    assert toxicity.score(empty, toxicity.train(empty, marks)).count() == 0


def test_toxicity_of_neutral_terms_together(spark):
    rows, labels = [], []
    for i in range(1600):  # each mark is in half of both classes; toxic is both or neither
        one, two = i & 1, i >> 1 & 1
        rows.append((i, _text(i, 8) + " quartz" * one + " jbxkw" * two))
        labels.append((i, int(one == two)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    machine = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    held = [(out[i] >= 0.5) == bool(y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(held) > 0.95 * len(held)
    _, _, new, _ = next(toxicity.term_slots(["neverseenbefore"]))
    assert not machine.vector[new].any() and not machine.weight[new].any()


def test_factorization_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    n = 1 << toxicity.BITS
    machine = toxicity.Machine(0.3, rng.normal(size=n), rng.normal(size=(n, toxicity.FACTORS)))
    rows = [np.sort(rng.choice(n, k, replace=False)) for k in (0, 1, 2, 7)]
    got = machine.raw(np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows]))), len(rows))
    want = [0.3 + machine.weight[r].sum() + sum(machine.vector[a] @ machine.vector[b] for i, a in enumerate(r) for b in r[:i]) for r in rows]
    assert got == pytest.approx(want)


def test_toxicity_ties_and_repeated_labels(spark):
    rows = [(i, _text(i, 15) + (" foul brute" if i % 2 else "")) for i in range(200)] * 2
    labels = [(i, i % 2) for i in range(200)] * 2 + [(1, 0), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("y", F.lit(1))
    machine = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = toxicity.score(docs, machine, out="p").collect()
    assert len(out) == 400 and len({(r.doc_id, r.p) for r in out}) == 200  # equal texts score equally
    assert all((r.p >= 0.7) == (r.doc_id % 2 == 1) for r in out)


def test_bpe(spark, odd, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(9)
    parts = ["'", "s", "t", "r", "e", "ll", "'ve", " ", "  ", "\n", "\t", "1", "٣", "!", "é", "中", "　", "😀", "word"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(2000)] + ["a" * 5000, "ab " * 3000, " " * 500 + "x"]
    got = bpe.encode_batch(texts, bpe.PieceCache(ranks))
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
    rows = odd.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts[:300], 100)), "doc_id long, text string"))
    want = {}
    for r in rows.collect():
        ids = library.encode_ordinary(r.text or "")
        want.setdefault(r.doc_id, (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = rows.select("doc_id", bpe.digest(path)("text").alias("d")).select("doc_id", "d.*").collect()
    assert len(got) == 312 and all(tuple(r)[1:] == want[r.doc_id] for r in got)
    for r in bpe.encode_documents(rows.withColumn("ids", F.lit(1)), path).join(rows.dropDuplicates(["doc_id"]), "doc_id").collect():
        raw = (r.text or "").encode()
        assert [raw[a:b] for a, b in zip(r.offsets, [*r.offsets[1:], len(raw)])] == [library.decode_single_token_bytes(i) for i in r.ids]
    out = bpe.encode_documents(odd, path).collect()
    assert len(out) == 12 and all(r.intact for r in out) and bpe.encode_documents(empty, path).count() == 0
    both = odd.select("text", bpe.encode(path)("text").alias("ids")).select("text", bpe.decode(path)("ids").alias("b"), bpe.offsets(path)("ids").alias("o"), "ids")
    for r in both.collect():
        assert bytes(r.b) == (r.text or "").encode() and len(r.o) == len(r.ids)


def test_itq(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(150, 64))
    near = np.concatenate([b + rng.normal(size=(3, 64)) * s for b, s in zip(base[:60], np.linspace(0.02, 0.4, 60))])
    vectors = np.concatenate([base, near, base[:5], 2 * base[:3]]).astype(np.float32)
    odd_rows = [None, [0.0] * 64, [float("nan")] * 64, [None] * 64, [1.0] * 3, [float("inf")] + [1.0] * 63]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(10000 + i, v) for i, v in enumerate(odd_rows)]
    out = {r.vec_id: r for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    x = vectors.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.95
    np.fill_diagonal(links, False)
    assert [out[i].n_links for i in range(len(x))] == links.sum(axis=1).tolist()
    assert all(out[10000 + i].n_links == 0 and out[10000 + i].kept for i in range(len(odd_rows)))
    assert itq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_decontamination_recall(spark):
    """Items with all numbers of edits within the bound: at least 0.99 of them are found."""
    rng = np.random.default_rng(12)
    items, docs = [], []
    for i in range(400):
        n = int(rng.integers(6, 60))
        own = [f"w{rng.integers(3000)}" for _ in range(n)]
        items.append((i, " ".join(own)))
        for _ in range(rng.integers(0, n // 5 + 1)):
            at = int(rng.integers(len(own)))
            own[at : at + 1] = [[], ["new"], [own[at], "more"]][rng.integers(3)]
        docs.append((i, " ".join([*(f"b{x}" for x in rng.integers(0, 999, 30)), *own, *(f"c{x}" for x in rng.integers(0, 999, 30))])))
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len({r.doc for r in found if r.doc == r.item}) >= 396


def test_itq_odd_rows(spark):
    rows = [(1, [1.0, 0.0], "x"), (None, [1.0, 0.1], "x"), (3, [1.0, 0.3], None), (3, [0.0, 1.0], "y"), (None, [-1.0, 0.0], "y"), (None, [-1.0, 0.05], "y"), (7, [1.0, 0.0], "z"), (8, [1.0], "z"), (9, [2.0], "z")]
    out = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string").withColumn("vector", F.lit(0))).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out), key=str) == sorted([(1, 3, 1, True), (None, 3, 1, False), (3, 3, 1, False), (3, 0, 3, True), (None, 1, None, False), (None, 1, None, False), (7, 3, 1, False), (8, 1, 8, True), (9, 1, 8, False)], key=str)


def test_itq_recall_with_a_common_direction():
    """Tables chosen from a sample find pairs at the threshold among other vectors of the same kind."""
    rng = np.random.default_rng(9)
    for common in (0.0, 0.9, 0.95):
        x = rng.normal(size=(4000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x = common * np.eye(64)[0] + np.sqrt(1 - common**2) * x
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        mean, projection, width, far, recall = itq.tables_for(x[:2000], 4000, 0.95)
        assert recall >= itq.RECALL
        y, z = itq.made_pairs(x[2000:], 0.95, seed=3)[0]
        differ = ((y - mean) @ projection >= 0) != ((z - mean) @ projection >= 0)
        met = (differ.reshape(len(differ), -1, width).sum(axis=2) <= 1).any(axis=1) & (differ.sum(axis=1) <= far)
        assert met.mean() >= 0.99


def test_itq_common_direction_and_lengths(spark):
    rng = np.random.default_rng(8)
    groups = []
    for n, d in ((600, 64), (300, 48)):
        x = 2 * np.eye(d)[0] + rng.normal(size=(n, d)) / np.sqrt(d)
        near = x[: n // 2] / np.linalg.norm(x[: n // 2], axis=1, keepdims=True)
        groups.append(np.concatenate([x, near + rng.normal(size=near.shape) * 0.25 / np.sqrt(d)]).astype(np.float32))
    want = []
    for x in groups:
        x = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
        want += ((x @ x.T >= 0.95).sum(axis=1) - 1).tolist()
    rows = [(i, v.tolist()) for i, v in enumerate(v for g in groups for v in g)]
    got = {r.vec_id: r.n_links for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert sum(want[900:]) and [got[i] for i in range(len(rows))] == want
