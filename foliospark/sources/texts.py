"""Item lists and key-value files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as tx


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """(item) of a list file: lines that are blank or begin with # are skipped, others split at commas."""
    return items_of_lines(spark.read.text(path))


def items_of_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    bare = tx.trim(F.col(value))
    return lines.where((bare != "") & ~bare.startswith("#")).select(F.explode(tx.split_items(bare)).alias("item"))


def items_of_arg_rows(rows: DataFrame, value: str = "value") -> DataFrame:
    """The other columns and each item of arguments that commas part; none is a comment."""
    return rows.select(*(c for c in rows.columns if c != value), F.explode(tx.split_items(F.col(value))).alias("item"))


def items_of_args(spark: SparkSession, *args: str) -> DataFrame:
    return items_of_arg_rows(spark.createDataFrame([(a,) for a in args], "value string"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a key-value file: split at the first =, keys in upper case, the last line of a key wins."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return settings_of_lines(lines)


def settings_of_lines(lines: DataFrame, value: str = "value", order: str = "line_no") -> DataFrame:
    bare = tx.trim(F.col(value))
    pairs = lines.where((bare != "") & ~bare.startswith("#") & bare.contains("=")).withColumn("_p", F.split(bare, "=", 2))
    pairs = pairs.select(F.upper(tx.trim(F.col("_p")[0])).alias("key"), tx.trim(F.col("_p")[1]).alias("value"), order)
    return pairs.groupBy("key").agg(F.max_by("value", order).alias("value"))
