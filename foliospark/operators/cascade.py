"""The cheap-first, fail-open filter cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

APPROVED, LOCAL, TRIAGE, FAIL_OPEN = "approved", "local", "triage", "fail_open"


def cascade_stage(local: Column, local_error: Column, verdict: Column, verdict_error: Column, enabled: bool = True) -> Column:
    """Where a row's way ends: the local rule rejects (an error of it lets pass), then the model rejects; a model error keeps the row."""
    if not enabled:
        return F.lit(APPROVED)
    return (
        F.when(local_error.isNull() & F.coalesce(local, F.lit(False)), LOCAL)
        .when(verdict_error.isNotNull(), FAIL_OPEN)
        .when(~F.coalesce(verdict, F.lit(False)), TRIAGE)
        .otherwise(APPROVED)
    )


def kept(stage: Column) -> Column:
    return stage.isin(APPROVED, FAIL_OPEN)


def run_cascade(items: DataFrame, local: Column, local_error: Column, ask, key: str, enabled: bool = True) -> DataFrame:
    """Add stage and reason; `ask` maps the rows that pass the local rule to (key, should_colorize, reason, error).

    Only survivors of the local rule reach `ask`: a projection wouldn't spare the others the model call.
    """
    if not enabled:
        return items.withColumns({"stage": F.lit(APPROVED), "reason": F.lit("")})
    rejected = local_error.isNull() & F.coalesce(local, F.lit(False))
    survivors = items.where(~rejected)
    verdicts = ask(survivors)
    judged = survivors.join(verdicts.select(F.col(key), "should_colorize", F.col("reason").alias("_reason"), "error"), key, "left")
    error = F.coalesce("error", F.when(F.col("should_colorize").isNull(), "no verdict"))
    judged = judged.withColumn("stage", cascade_stage(F.lit(False), F.lit(None), F.col("should_colorize"), error)).withColumn("reason", F.coalesce("_reason", F.lit(""))).drop("_reason", "should_colorize", "error")
    return judged.unionByName(items.where(rejected).withColumns({"stage": F.lit(LOCAL), "reason": F.lit("already coloured")}))


def summary(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by, "stage").agg(F.count("*").alias("n"))
