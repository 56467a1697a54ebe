"""Reading and writing tables: labelled scans, matrices, routes, pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_labelled(spark: SparkSession, glob: str, label_regex: str, label: str = "chemistry", fmt: str = "csv", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """All files of a glob with a label taken from each file's path by the first group of a pattern."""
    reader = spark.read.format(fmt).options(**({"header": "true"} | options if fmt == "csv" else options))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(glob).select("*", F.regexp_extract(F.col("_metadata.file_path"), label_regex, 1).alias(label))


def label_counts(spark: SparkSession, glob: str, label_regex: str, label: str = "chemistry", fmt: str = "binaryFile") -> DataFrame:
    """(label, files): how many files carry each label, to find missing and doubled inputs."""
    return spark.read.format(fmt).load(glob).select(F.regexp_extract("path", label_regex, 1).alias(label)).groupBy(label).agg(F.count("*").alias("files"))


def read_matrix(spark: SparkSession, path: str, key: str, sep: str = ",") -> DataFrame:
    """Key and double columns of a delimited file; the header names the columns, nothing is inferred from rows."""
    names = spark.read.option("sep", sep).option("header", "true").csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType() if c == key else T.DoubleType()) for c in names])
    return spark.read.option("sep", sep).option("header", "true").schema(schema).csv(path)


def write_routes(df: DataFrame, path: str, by: str) -> None:
    """One folder per value of ``by``; a rerun replaces the whole."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_pool(df: DataFrame, path: str) -> None:
    """(key, mask) as JSON lines."""
    df.select("key", "mask").write.mode("overwrite").json(path)


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, mask long").json(path)


def read_in_order(spark: SparkSession, glob: str, name_regex: str = "([^/]+)$", fmt: str = "csv", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """All files of a glob as one table, with ``file_no`` numbering their names (a group of the path) from 0 in order."""
    rows = read_labelled(spark, glob, name_regex, "__name", fmt, schema, **options)
    names = label_counts(spark, glob, name_regex, "__name")
    numbered = names.select("__name", (F.row_number().over(Window.orderBy("__name")) - 1).alias("file_no"))  # one row per name
    return rows.join(numbered, "__name").drop("__name")
