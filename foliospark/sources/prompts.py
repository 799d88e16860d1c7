"""Prompts: a user's file if it says something, else the built-in text, else a constant."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as tx
from foliospark.tables import path_exists


def read_prompt(spark: SparkSession, path: str | None, builtin: str | None, fallback: str) -> str:
    """The first of the three that isn't blank; a path that doesn't exist is passed over."""
    rows = spark.read.text(path, wholetext=True) if path and path_exists(spark, path) else spark.createDataFrame([(None,)], "value string")
    chosen = rows.agg(F.max("value").alias("value")).select(tx.first_filled(F.col("value"), F.lit(builtin), F.lit(fallback))).first()
    return chosen[0]
