"""Personal data against Python's patterns and DuckDB, contexts that have to be found, odd rows."""

import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scopespark.llm import pii

PLAIN = {p.kind: re.compile(p.plain.replace(r"\x20", " ")) for p in pii.BASE}
SCHEMA = "doc_id long, text string"


def _luhn(d):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def _valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in v.split(".")), "card": lambda: 12 <= len(d) <= 19 and _luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def brute(text):
    return sorted((m.start(), pii.KINDS.index(k), m.end()) for k, p in PLAIN.items() for m in p.finditer(text or "") if _valid(k, m.group()))


def _run(spark, rows, schema=SCHEMA):
    return [r.asDict(recursive=True) for r in pii.scan(spark.createDataFrame(rows, schema)).collect()]


def _against_sql(spark, rows):
    found = pii.scan(spark.createDataFrame(rows, SCHEMA)).select(F.col("doc").alias("doc_id"), F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    want = con.execute(f"SELECT doc_id, base_sha256, spans FROM ({pii.sql()})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
    return {r[0]: r[2] for r in want}


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(3)
    parts = ["a@b.c", "x.y@mail.example.org", "@", ".", "..", "-", "+", " ", "\n", "1.2.3.4", "256.1.1.1", "010.0.0.1", "4111 1111 1111 1111", "4111111111111111", "+1 (375) 555-4393", "+", "12", "7", "é", "\U0001f600", "a", "b-", "_%", "(", ")", "0000000000000", "x" * 50]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(400)]
    texts += ["a@b.c+d@e.f", "a@b@c.d", "a@b.c..d@e.f", "1.2.3.4.5.6.7.8", "1." * 5000, "1 2" * 6000, "a." * 9000 + "@x", "x@y" + ".z" * 9000, "+" + "1." * 4000, "9" * 30000]
    got = {r["doc"]: r for r in _run(spark, list(enumerate(texts)))}
    for i, t in enumerate(texts):
        assert [(s["start"], s["kind"], s["end"]) for s in got[i]["base"]] == brute(t), t[:200]


def _planted():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    rows = []
    for i in range(40):  # a context that personal data follows, most of it known by pattern
        rows.append((i, f"{word()} {word()} reach me: +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} {word()}"))
    for i in range(40, 60):  # the same context with identifiers no pattern knows
        rows.append((i, f"{word()} reach me: Q{rng.randrange(10**7, 10**8)}X {word()} {word()}"))
    for i in range(60, 90):  # numbers in a context that personal data hardly ever follows
        rows.append((i, f"order number {rng.randrange(10**6, 10**7)} shipped"))
    rows.append((90, "order number +1 (375) 555-4393 shipped"))
    rows.append((91, "the order 1-375-555-4393 again, and AKIA12345678"))  # a known number without its plus
    for i in range(92, 100):  # identifiers found above lead to a second context, which leads to new ones
        rows.append((i, f"member id {rows[40 + i - 92][1].split('reach me: ')[1].split()[0]} joined"))
    rows.append((100, "member id Z99887766 joined"))
    rows.append((101, "reach me: tomorrow at noon"))
    return rows


def test_contexts_find_unseen_identifiers(spark):
    rows = _planted()
    spans = _against_sql(spark, rows)
    texts = dict(rows)
    told = {i: [texts[i][int(s.split(":")[1]) : int(s.split(":")[2])] for s in x.split(",") if s.startswith("context")] for i, x in spans.items()}
    assert all(len(told[i]) == 1 and told[i][0].startswith("Q") for i in range(40, 60))
    assert not any(told[i] for i in range(60, 91)) and told[101] == []
    assert told[91] == ["1-375-555-4393"]
    assert all(told[i] for i in range(92, 100)) and told[100] == ["Z99887766"]


def test_confidence_counts_all_places(spark):
    """Where ordinary words mostly follow, a context proves nothing."""
    rows = [(i, f"call on +1 (375) 555-{1000 + i} now") for i in range(9)] + [(100, "call on B1234567 now")] + [(200 + i, f"call on friend{i} now") for i in range(10)]
    spans = _against_sql(spark, rows)
    assert "context" not in spans[100]
    assert "context" in _against_sql(spark, rows[:-6])[100]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.cd"), (3, "a@b.cd"), (3, "a@b.cd"), (4, "x " * 60000 + "a@b.cd " + "12345 " * 3000)]
    got = _run(spark, [(d, t, 7, "e") for d, t in rows], SCHEMA + ", base long, candidates string")
    assert len(got) == 6 and sorted(len(r["base"]) for r in got) == [0, 0, 1, 1, 1, 1]
    assert [r["base"][0]["start"] for r in got if r["doc"] == 4] == [120000]
    assert _run(spark, []) == []


@pytest.mark.parametrize("text", ["plain words only", "version 2.0, page 14"])
def test_clean_text_has_no_spans(spark, text):
    assert _run(spark, [(1, text)])[0]["spans"] == []


def test_written(spark):
    r = pii.scan(spark.createDataFrame([(1, "x a@b.cd 1.2.3.4")], SCHEMA)).select(pii.written(F.col("base")).alias("w"), F.sha2(pii.written(F.col("base")), 256).alias("h")).first()
    assert r["w"] == "email:2:8,ip:9:16" and r["h"] == hashlib.sha256(b"email:2:8,ip:9:16").hexdigest()
