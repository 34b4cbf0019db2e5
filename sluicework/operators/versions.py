"""Latest versions, changes, upserts and idempotent inserts on append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The row with the greatest order values of each key, by map-side aggregation: no sort of a hot key's rows.

    ``columns``: what is kept beside the keys, by default all; nothing else is read or shuffled. Rows alike in the order columns
    are told apart by a hash of what is kept.
    """
    kept = [c for c in (df.columns if columns is None else columns) if c not in keys]
    unordered = [c for c in kept if c not in order]
    marked = [x for c in unordered for x in (F.col(c).isNull(), F.col(c))]  # the hash alone passes nulls over
    rank = F.struct(*order, *([F.xxhash64(*marked)] if marked else []))
    best = F.max_by(F.struct(*(kept or order)), rank)
    out = [*keys, *kept] if columns is not None else df.columns
    return df.groupBy(*keys).agg(best.alias("__best")).select(*(c if c in keys else F.col(f"__best.{c}").alias(c) for c in out))


def with_latest(left: DataFrame, right: DataFrame, on: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join to the latest row of the other side; the other side is aggregated before it is joined."""
    best = right.groupBy(on).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__best"))
    return left.join(best, on, "left").select(*left.columns, *(F.col(f"__best.{c}").alias(c) for c in columns))


def changes(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from the key's row before; a key's first row is no change."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("__old", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w))
    return marked.where((F.col("__n") > 1) & ~F.col("__old").eqNullSafe(F.col(value))).withColumnRenamed("__old", "old_value").drop("__n")


def version_numbers(df: DataFrame, key: str, order: Sequence[str], payload: str) -> DataFrame:
    """A version that grows only when the payload differs from the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    bump = F.when(F.row_number().over(w) == 1, 1).when(F.lag(payload).over(w).eqNullSafe(F.col(payload)), 0).otherwise(1)
    return df.withColumn("__bump", bump).withColumn("version", F.sum("__bump").over(w)).drop("__bump")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """The table after the new rows: they win, but a null in a ``keep_old`` column leaves the old value.

    A key repeated in the new rows counts once: the last by ``order``. Running it again changes nothing.
    """
    fresh = latest(new, keys, list(order) or [c for c in new.columns if c not in keys]) if new.columns else new
    mark = fresh.select(*keys, F.struct(*(c for c in fresh.columns)).alias("__new"))
    both = old.select(*keys, F.struct(*old.columns).alias("__old")).join(mark, list(keys), "full")
    columns = []
    for c in old.columns:
        if c in keys:
            columns.append(F.col(c))
        elif c in keep_old:
            columns.append(F.coalesce(F.col(f"__new.{c}"), F.col(f"__old.{c}")).alias(c))
        else:
            columns.append(F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c))
    return both.select(*columns)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The new rows whose key is in no old row, one for each key."""
    return new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")


def import_report(old: DataFrame, new: DataFrame, key: str, valid: Column, compared: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """What an import does: the table after it, and one row of counts ``inserted``, ``updated``, ``unchanged`` and ``rejected``.

    Rows that aren't valid, or whose key is null, are rejected and change nothing. A key repeated in the batch counts as one row, the one of the greatest hash.
    ``compared``: the columns a difference in which is an update.
    """
    checked = new.withColumn("__valid", F.coalesce(valid, F.lit(False)) & F.col(key).isNotNull())
    accepted = latest(checked.where("__valid").drop("__valid"), [key], [])
    differs = F.lit(False)
    for c in compared:
        differs = differs | ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    both = accepted.alias("n").join(old.select(key, *compared).withColumn("__held", F.lit(True)).alias("o"), key, "left")
    kind = F.when(F.col("__held").isNull(), "inserted").when(differs, "updated").otherwise("unchanged")
    kinds = both.select(kind.alias("kind")).unionByName(checked.where(~F.col("__valid")).select(F.lit("rejected").alias("kind")))
    counts = kinds.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("inserted", "updated", "unchanged", "rejected")))
    return upsert(old, accepted, [key]), counts


def looked_up(ids: DataFrame, table: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Each id with its row of the table, or with the defaults if it has none; version 0 where there is no row."""
    held = table.select(key, *(F.col(c).alias(f"__{c}") for c in defaults), F.lit(True).alias("__held"))
    both = ids.select(key).distinct().join(held, key, "left")
    return both.select(key, *(F.when(F.col("__held"), F.col(f"__{c}")).otherwise(F.lit(v)).alias(c) for c, v in defaults.items()))


def composite_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("::", *(p.cast("string") for p in parts)), 256)


def content_classes(df: DataFrame, key: str, content: str) -> DataFrame:
    """Exact copies: of each content its digest, first key and number of rows. Only digests are shuffled."""
    return df.where(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("digest"), key).groupBy("digest").agg(F.min(key).alias("first_id"), F.count("*").alias("copies"))
