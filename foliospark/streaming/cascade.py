"""The cascade over streams, an extension for files that keep arriving; running progress is in progress.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.cascade import cascade_stage


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def judge_stream(items: DataFrame, verdicts: DataFrame, key: str, local: Column) -> DataFrame:
    """Each arriving item's stage by a static table of verdicts (key, should_colorize, error); an item without one passes, fail-open."""
    joined = items.join(verdicts, key, "left")
    error = F.coalesce("error", F.when(F.col("should_colorize").isNull(), "no verdict"))
    return joined.withColumn("stage", cascade_stage(local, F.lit(None), F.col("should_colorize"), error)).drop("should_colorize", "error")


def stage_counts(stream: DataFrame, ts: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Stages counted by window of event time; rows later than the watermark are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), "stage").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "stage", "n")
