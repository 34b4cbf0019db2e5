"""Expectations on tables: missing values, repeats, foreign keys, allowed values; all-or-nothing batches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_errors(df: DataFrame, checks: dict[str, Column], unique: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Adds ``errors``: names of the checks that fail, then ``repeated <column>`` for all but the first row of a value."""
    failed = [F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(name)) for name, ok in checks.items()]
    for c in unique:
        # Nulls repeat nothing; a number of their own keeps them out of one another's window.
        apart = F.when(F.col(c).isNull(), F.monotonically_increasing_id())
        df = df.withColumn("__apart", apart).withColumn(f"__n_{c}", F.row_number().over(Window.partitionBy(c, "__apart").orderBy(*(order or df.columns[:1])))).drop("__apart")
        failed.append(F.when(F.col(c).isNotNull() & (F.col(f"__n_{c}") > 1), F.lit(f"repeated {c}")))
    errors = F.filter(F.array(*failed), lambda e: e.isNotNull()) if failed else F.array().cast("array<string>")
    return df.withColumn("errors", errors).drop(*(f"__n_{c}" for c in unique))


def registration_errors(batch: DataFrame, registry: DataFrame, regions: DataFrame, institutions: DataFrame) -> DataFrame:
    """Adds ``errors`` to sources that are to be registered: address, an address that another id owns, unknown region, and for colleges no verified institution of the same region.

    batch and registry: id, entry_url, region_code, source_group, institution_id; regions: region_code; institutions: institution_id, region_code. All lookups are equi-joins.
    """
    owners = registry.select("entry_url", F.col("id").alias("__owner")).groupBy("entry_url").agg(F.min("__owner").alias("__owner"))
    known = regions.select("region_code").distinct().withColumn("__region", F.lit(True))
    verified = institutions.groupBy("institution_id").agg(F.min("region_code").alias("__at"))
    rows = batch.join(owners, "entry_url", "left").join(known, "region_code", "left").join(verified, "institution_id", "left")
    checks = {
        "address": F.col("entry_url").rlike("^https?://[^/]+"), "address of another source": F.col("__owner").isNull() | (F.col("__owner") == F.col("id")), "unknown region": F.col("__region").isNotNull(),
        "institution": (F.col("source_group") != "college") | (F.col("__at") == F.col("region_code")),
    }
    return row_errors(rows, checks).select(*batch.columns, "errors")


def accepted_or_nothing(df: DataFrame) -> DataFrame:
    """The batch if no row has errors; else its first use raises, before anything is written."""
    bad = df.agg(F.sum((F.size("errors") > 0).cast("long")).alias("bad"))
    checked = bad.select(F.when(F.coalesce("bad", F.lit(0)) > 0, F.raise_error(F.concat(F.col("bad").cast("string"), F.lit(" rows refused")))).otherwise(F.lit(True)).cast("boolean").alias("__ok"))
    return df.drop("errors").crossJoin(F.broadcast(checked)).where(F.coalesce("__ok", F.lit(True))).drop("__ok")  # the check is one row


def counts(df: DataFrame, name: str, not_null: Sequence[str] = (), unique: Sequence[str] = (), allowed: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(check_name, violations) rows for one table."""
    out = []
    if not_null or allowed:
        sums = [F.sum(F.col(c).isNull().cast("long")).alias(f"{name}.{c} missing") for c in not_null]
        sums += [F.sum((~F.col(c).isin(*values)).cast("long")).alias(f"{name}.{c} not allowed") for c, values in (allowed or {}).items()]
        one = df.agg(*sums)
        out.append(one.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in one.columns)), F.array(*(F.coalesce(f"`{c}`", F.lit(0)) for c in one.columns)))).alias("check_name", "violations")))
    for c in unique:
        repeated = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).where("n > 1")
        out.append(repeated.agg(F.count("*").alias("violations")).select(F.lit(f"{name}.{c} repeated").alias("check_name"), "violations"))
    return reduce(DataFrame.unionByName, out)


def orphans(df: DataFrame, column: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    lost = df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")
    return lost.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
