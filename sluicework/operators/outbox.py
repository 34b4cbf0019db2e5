"""An outbox of messages: one for each subscriber, record and kind of event, sent again until its attempts are used up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.operators.versions import composite_id

KEY = ("profile_id", "notice_id", "event_type")


def enqueue(outbox: DataFrame, hits: DataFrame, at: str) -> DataFrame:
    """The messages that the outbox lacks, as pending rows: insert or ignore by (profile, notice, event).

    hits: profile_id, notice_id, event_type and the time of the event, as often as it may be seen; the first time holds. Hits are
    aggregated before they are shuffled, so an event reported again and again is one row.
    """
    first = hits.where(" AND ".join(f"{k} IS NOT NULL" for k in KEY)).groupBy(*KEY).agg(F.min(at).alias("created_at"))
    fresh = first.join(outbox.select(*KEY), list(KEY), "left_anti")
    return fresh.select(composite_id(*(F.col(k) for k in KEY)).alias("id"), *KEY, "created_at", F.lit("pending").alias("status"), F.lit(0).alias("attempts"))


def retryable(outbox: DataFrame, profiles: DataFrame, notices: DataFrame, most_attempts: int = 3) -> DataFrame:
    """Messages still to be sent with what they need: pending or failed, with attempts left, joined to their profile and notice.

    A message of a profile or notice that is gone isn't sent.
    """
    waiting = outbox.where(F.col("status").isin("pending", "failed") & (F.col("attempts") < most_attempts))
    return waiting.join(profiles, "profile_id").join(notices, "notice_id")


def mark(outbox: DataFrame, results: DataFrame) -> DataFrame:
    """The outbox after a round: results have id, sent and error; a failure uses up an attempt, its error is cut to 1,000 characters."""
    out = outbox.join(results.select("id", F.col("sent").alias("__sent"), F.col("error").alias("__error")), "id", "left")
    failed = F.col("__sent") == F.lit(False)
    return out.select(
        *(c for c in outbox.columns if c not in ("status", "attempts", "error")),
        F.when(F.col("__sent"), "sent").when(failed, "failed").otherwise(F.col("status")).alias("status"),
        (F.col("attempts") + F.coalesce(failed.cast("int"), F.lit(0))).alias("attempts"),
        F.when(failed, F.substring("__error", 1, 1000)).alias("error"),
    )
