"""What changed between full snapshots (problem 5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of the values, each with its length, so that null, '' and shifted borders differ."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.unhex(F.sha2(F.concat_ws(";", *parts), 256))


def snapshot_changes(df: DataFrame, key: str, snapshot: str, compared: Sequence[str], loaded_at: str | None = None) -> DataFrame:
    """Records added, removed or changed between consecutive delivered snapshots.

    Returns ``snapshot_no`` (the later one), the key column and ``change``. Snapshots are the
    distinct numbers that occur: a number never delivered leaves no gap. Each key is windowed by
    snapshot index; a lagged digest that differs is a change, an index gap a removal and a later
    addition. The first snapshot gives nothing.

    Repeated rows of a key in a snapshot count once; should they differ, the last ``loaded_at``
    holds, then the greatest digest. Null equals null and differs from ''. Rows without a snapshot
    number belong to none and are left out; a null key is a record of its own. An empty table gives
    no row. Columns other than those named aren't read.

    Only (key, snapshot, digest) is shuffled, pre-aggregated before, so a key repeated millions of
    times reaches the window as one row per snapshot. The list of snapshots has a row per delivery.
    """
    rank = F.struct(F.col(loaded_at) if loaded_at else F.lit(0), F.col("__digest"))
    rows = df.where(F.col(snapshot).isNotNull()).select(
        F.col(key).alias("__key"), F.col(snapshot).alias("__no"), *([F.col(loaded_at)] if loaded_at else []), row_digest([F.col(c) for c in compared]).alias("__digest")
    )
    once = rows.groupBy("__key", "__no").agg(F.max(rank)["__digest"].alias("__digest"))
    by_no = Window.orderBy("__no")
    deliveries = (
        df.where(F.col(snapshot).isNotNull()).select(F.col(snapshot).alias("__no")).distinct()
        .select("__no", F.row_number().over(by_no).alias("__at"), F.lead("__no").over(by_no).alias("__next"))
    )
    w = Window.partitionBy("__key").orderBy("__at")
    seen = once.join(deliveries, "__no").select(
        "__key", "__no", "__at", "__next", "__digest",
        F.lag("__at").over(w).alias("__before"), F.lag("__digest").over(w).alias("__old"), F.lead("__at").over(w).alias("__after"),
    )
    kept = F.col("__before") == F.col("__at") - 1
    here = (
        F.when((F.col("__at") > 1) & (F.col("__before").isNull() | ~kept), F.lit("added"))
        .when(kept & (F.col("__old") != F.col("__digest")), F.lit("changed"))
    )
    gone = F.col("__next").isNotNull() & (F.col("__after").isNull() | (F.col("__after") > F.col("__at") + 1))
    events = F.array(
        F.struct(F.col("__no").alias("no"), here.alias("change")),
        F.struct(F.col("__next").alias("no"), F.when(gone, F.lit("removed")).alias("change")),
    )
    out = seen.select("__key", F.explode(F.filter(events, lambda e: e["change"].isNotNull())).alias("__e"))
    return out.select(F.col("__e.no").alias("snapshot_no"), F.col("__key").alias(key), F.col("__e.change").alias("change"))
