"""Incremental screening of text lines: resumes after the last processed file, appends only new output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scopespark.operators.clean import screen_records
from scopespark.sources.molecules import parsed


def screened(lines: DataFrame, text: str = "value", parse: bool = False) -> DataFrame:
    """Lines with status, reason and fragment; with ``parse`` kept fragments that are no molecule are ``failed``."""
    found = lines.select(text, *screen_records(F.col(text)))
    if not parse:
        return found
    bad = (F.col("status") == "keep") & ~parsed(F.trim("fragment"))["graph"]["good"]
    return found.withColumn("status", F.when(bad, "failed").otherwise(F.col("status")))


def screen_stream(spark: SparkSession, in_dir: str, out: str, checkpoint: str, parse: bool = False) -> StreamingQuery:
    """One pass over the files that have come since the last one; lines go to a sink for each status.

    Kept and rejected ones, and with ``parse`` those that fail.  Each batch writes under its own number, so a
    batch that is repeated after a failure replaces itself.  With ``parse`` empty lines are left out.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        for status in ("keep", "reject", "failed")[: 3 if parse else 2]:
            batch.where(F.col("status") == status).drop("status").write.mode("overwrite").parquet(f"{out}/{status}/batch={number}")
        batch.unpersist()

    lines = spark.readStream.option("lineSep", "\n").text(in_dir)
    lines = lines.where(F.trim("value") != "") if parse else lines
    query = screened(lines, parse=parse).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
