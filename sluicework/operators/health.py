"""Health of sources from their check log: failures in a row, state, retry delay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failures_in_row(df: DataFrame, key: str, order: Sequence[str], failed: Column) -> DataFrame:
    """Adds ``failures``: how many failures end at this row; a success sets it to 0."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("__failed", F.coalesce(failed, F.lit(False))).withColumn("__island", F.sum(F.when(~F.col("__failed"), 1).otherwise(0)).over(w))
    inside = Window.partitionBy(key, "__island").orderBy(*order)
    return marked.withColumn("failures", F.sum(F.col("__failed").cast("int")).over(inside)).drop("__failed", "__island")


def state(failures: Column, degraded_at: int = 3) -> Column:
    return F.when(failures >= degraded_at, "degraded").otherwise("enabled")


def backoff_seconds(failures: Column, base: int = 300, most: int = 3600) -> Column:
    """base, 2 base, 4 base and 8 base seconds, at most ``most``; failures are those before this one."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2), F.least(failures, F.lit(3))).cast("int"))


def due(df: DataFrame, status: str, next_at: str, now: Column, states: Sequence[str] = ("enabled", "degraded")) -> DataFrame:
    """Sources to be checked by now, those never checked first."""
    return df.where(F.col(status).isin(*states) & (F.col(next_at).isNull() | (F.col(next_at) <= now))).orderBy(F.asc_nulls_first(next_at))
