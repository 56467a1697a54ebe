"""The pipeline's decisions, and the registered SQL."""

import collections
import re

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scopespark.llm import registry
from tests.llm.test_operators import SCHEMA, _classes, _text
from tests.test_oracle import TABLES, rows_of


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    count = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.spool(stage(spark, docs, sf), name)
        assert out.columns == docs.columns and 0 < out.count() <= count, name
        docs, count = out, out.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == count and last.where("not intact").count() == 0


def test_decisions_on_odd_rows(spark, sf):
    """Every stage against a plain rendering of its decision, on null, empty, long, repeated and clashing rows."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("size(split(text, ' ')) > 20").orderBy("item_id").first().text
    base = _text(2, 120)
    key = "AKIA" + "Q7" * 9
    texts = [(0, base), (1, base.replace("river", "brook", 1)), (2, None), (3, ""), (4, " \n"), (5, _text(1, 3000)), (6, "one two"), (6, "one two"), (6, "other"), (None, "no id"), (None, None)]
    texts += [(7, f"password: {key} and é {'0a' * 14} end"), (8, _text(4, 40) + " " + item + " " + _text(5, 40)), (9, "x" * 3000), (10, "token = abc" + "1" * 30)]
    docs = spark.createDataFrame([(i, t, None, "s", 1, 7, "k", 1) for i, t in texts], SCHEMA).withColumn("score", F.lit(0)).withColumn("component", F.lit("c"))
    stages = dict(corpus_pipeline.STAGES)
    out = corpus_pipeline.spool(stages["toxicity"](spark, docs, sf), "t")
    assert out.columns == docs.columns and out.count() == len(texts)
    out = corpus_pipeline.spool(stages["minhash_near_duplicates"](spark, out, sf), "m")
    once = list(dict.fromkeys((d, t or "") for d, t in texts))
    named = [(d, low) for (d, n, low), k in _classes([(i, t) for i, (_, t) in enumerate(once)]).items() if n]
    stay = [once[i] for i, low in named if i == low] + [x for x in once if not x[1].split()]
    assert collections.Counter((r.doc_id, r.text or "") for r in out.collect()) == collections.Counter(stay)
    out = corpus_pipeline.spool(stages["benchmark_decontamination"](spark, out, sf), "b")
    stay = [x for x in stay if x[0] != 8]
    assert collections.Counter((r.doc_id, r.text or "") for r in out.collect()) == collections.Counter(stay)
    out = corpus_pipeline.spool(stages["secret_scan"](spark, out, sf), "s")
    masked = [(d, re.sub(r"password: \w+", "[SECRET]", re.sub(r"(0a){14}", "[SECRET]", re.sub(r"token = \w+", "[SECRET]", t)))) for d, t in stay]
    assert collections.Counter((r.doc_id, r.text or "") for r in out.collect()) == collections.Counter(masked)
    last = stages["byte_bpe"](spark, out, sf).collect()
    import tiktoken.load

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tiktoken.load.load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in last) == collections.Counter((d, tuple(library.encode_ordinary(t))) for d, t in masked)
    nothing = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, sf)
        assert nothing.count() == 0, name


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows_of(registry.queries()[name](spark, sf).toPandas()) == rows_of(con.execute(registry.oracle_sql()[name]).df())
