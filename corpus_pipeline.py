"""Training-corpus pipeline: five stages, each written as Parquet and read again by the next.

Toxic documents go; one document of each near-duplicate component stays; documents that hold a
benchmark item (of LEAST words or more) go; secrets are masked in place; what is left is encoded.  Rows are
told apart by a key of id and text, so null and repeated ids need no special case: of rows equal in both one
stays.  Null and empty texts are clean, near no other and encoded as nothing; texts of any length are handled
whole; other columns pass through every stage but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scopespark.llm import bpe, decontam, minhash, secretscan, toxicity
from scopespark.session import spool

_KEY = "__row_key"
#: Items of fewer words say too little to drop a document for.
LEAST = 5


def _key() -> Column:
    """Sorts as the id does (null last), and tells rows of one id apart by their text."""
    return F.concat_ws(":", F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("~")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, machine, out="__score").where(F.col("__score") < toxicity.REJECT).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs.withColumn(_KEY, _key()), _KEY).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.withColumn(_KEY, _key())
    found = decontam.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc=_KEY, least=LEAST)
    return keyed.join(found.select(F.col("doc").alias(_KEY)).distinct(), _KEY, "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.withColumn(_KEY, _key())
    found = secretscan.scan(keyed, doc=_KEY).where(F.size("spans") > 0).groupBy(F.col("doc").alias(_KEY)).agg(F.first("spans").alias("__spans"))
    joined = keyed.join(found, _KEY, "left")
    masked = F.when(F.col("__spans").isNotNull(), secretscan.redact(F.col("text"), F.col("__spans"))).otherwise(F.col("text"))
    return joined.withColumn("text", masked).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_duplicates", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("byte_bpe", encode),
]

#: The classifier, the signatures and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), name)
    return docs
