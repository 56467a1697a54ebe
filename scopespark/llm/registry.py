"""Queries of this subpackage: ``opN_<name>(spark, sf_dir)`` and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopespark.llm import bpe, covertree, ctw, decontam, itq, minhash, periodicruns, pii, secretscan, sharding, suffixdedup, tokencount, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of near equal bytes along a Hilbert curve over language, source and length."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.hilbert_shards(rows, ["lang", "source", "n_chars"], "size", ["doc_id", "text_crc32", "size"], 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op2_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over 5-word shingles at similarity 0.75."""
    found = minhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text by the word-end BPE model."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select(F.col("doc").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op4_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within the edit bound: one row per document and item."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contaminated(docs, _read(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_words", "edits", "end_word", "n_found", "n_passages")


def op5_context_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-tree score of every text beside the unigram base."""
    return ctw.score(_read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("doc", "doc_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left after removing 50-byte strings that start in earlier documents."""
    kept = suffixdedup.remove(_read(spark, sf_dir, "documents").select("doc_id", "text"), view=lambda kept: F.sha2(kept, 256))
    return kept.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def op7_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and owner-specific tokens of every text."""
    found = secretscan.scan(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    base = F.col("base")
    return found.select(
        F.col("doc").alias("doc_id"),
        *[secretscan.count_kind(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secretscan.written(base), 256).alias("base_sha256"),
        secretscan.written(F.col("spans")).alias("spans"),
        secretscan.count_kind(F.col("spans"), "owned").alias("n_owned"),
        secretscan.spread(F.col("spans")).alias("ownership"),
    )


def op8_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text by a factorization machine fitted outside the held-out fold."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids, and digest both."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return _read(spark, sf_dir, "documents").select("doc_id", bpe.digest(path)("text").alias("d")).select("doc_id", "d.*")


def op10_itq_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.95."""
    return itq.near_duplicates(_read(spark, sf_dir, "embeddings"), 0.95)


def op11_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, with the label of every seventh moved on by one."""
    rows = _read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return covertree.hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


def op12_private_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of personal data and the identifiers that their contexts lead to."""
    found = pii.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("base")
    return found.select(
        F.col("doc").alias("doc_id"),
        *[pii.count_kind(base, k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.written(base), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
        pii.count_kind(F.col("spans"), "context").alias("n_context"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every text, a tenth of the texts made periodic first."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", periodicruns.repeated(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodicruns.find(docs)
    best = periodicruns.longest(F.col("runs"))
    return found.select(
        F.col("doc").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(periodicruns.written(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_hilbert_shards": op1_hilbert_shards,
        "op2_minhash_components": op2_minhash_components,
        "op3_token_counts": op3_token_counts,
        "op4_cgk_decontamination": op4_cgk_decontamination,
        "op5_context_tree_score": op5_context_tree_score,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_secret_ownership": op7_secret_ownership,
        "op8_toxicity_fm": op8_toxicity_fm,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_itq_near_duplicates": op10_itq_near_duplicates,
        "op11_cover_tree_negatives": op11_cover_tree_negatives,
        "op12_private_contexts": op12_private_contexts,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_hilbert_shards": sharding.sql(),
        "op2_minhash_components": minhash.sql(),
        "op7_secret_ownership": secretscan.sql(),
        "op10_itq_near_duplicates": itq.sql(0.95),
        "op11_cover_tree_negatives": covertree.sql(),
        "op12_private_contexts": pii.sql(),
    }
