"""Deterministic top-k, top-k of each group, diverse top-k, and checks of a selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(limit: int, most: int) -> int:
    return max(1, min(limit, most))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """Spark keeps k rows of each group before the shuffle (window group limit)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def diverse_top_k(df: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """First the best of each different group in order, then the rest in order, k in all; a blank group is its own.

    A row that is k-th or later in its group can't be among the first k, so each group is cut to k by a window group
    limit, ahead of the shuffle; rows without a group are cut to the k first of all of them. Then they are brought together.
    """
    blank = F.coalesce(F.trim(group), F.lit("")) == ""
    grouped = top_k_per_group(df.where(~blank), group, order, k).withColumnRenamed("rank", "__n")
    single = top_k(df.where(blank), order, k).withColumn("__n", F.lit(1))
    return grouped.unionByName(single).orderBy((F.col("__n") > 1).cast("int"), *order).limit(k).drop("__n")


def selection_violations(selected: DataFrame, pool: DataFrame, key: str, group: str, order: str, by: str, most: int = 3) -> DataFrame:
    """Why each selected row is refused, null if it isn't: unknown, repeated, a second of its group, or beyond ``most``.

    ``by`` tells the selections apart; each is a handful of rows, checked on its own, so any number of them is checked at once.
    """
    joined = selected.join(pool.select(key, F.col(group).alias("__group"), F.lit(True).alias("__known")), key, "left")
    again = F.row_number().over(Window.partitionBy(by, key).orderBy(order)) > 1
    reason = F.when(F.col("__known").isNull(), "unknown").when(F.col("__again"), "repeated")
    first = joined.withColumn("__again", again).withColumn("violation", reason)
    sound = F.col("violation").isNull() & F.col("__group").isNotNull()
    first = first.withColumn("__nth", F.sum(F.when(sound, 1).otherwise(0)).over(Window.partitionBy(by, "__group").orderBy(order)))
    first = first.withColumn("violation", F.when(sound & (F.col("__nth") > 1), "same group").otherwise(F.col("violation")))
    kept = F.sum(F.when(F.col("violation").isNull(), 1).otherwise(0)).over(Window.partitionBy(by).orderBy(order))
    return first.withColumn("violation", F.when(F.col("violation").isNull() & (kept > most), "too many").otherwise(F.col("violation"))).drop("__group", "__known", "__again", "__nth")


def within_budget(df: DataFrame, group: str, order: Sequence[Column], size: str, budget: int, most: int) -> DataFrame:
    """The first rows of each group, at most ``most``, whose sizes add up to the budget."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("used", F.sum(size).over(w)).withColumn("rank", F.row_number().over(w)).where((F.col("used") <= budget) & (F.col("rank") <= most))
