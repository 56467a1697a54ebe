"""Session defaults and scratch storage shared by every operator."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName("scopespark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Where none is configured, a local session (tests) takes a temporary folder; on a cluster this is an error,
    because its executors and driver share no local folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="scopespark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage into the shared folder, survives lost executors."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def spool(df: DataFrame, name: str = "t", compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back (columnar, prunable)."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    schema = df.schema
    del df
    # Spark deletes a finished step's shuffle files when the driver collects the step's garbage
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._spool_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a spool that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._spool_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
