"""All core queries by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.operators import topk, triage, versions
from sluicework.plans import events, notices, packed
from sluicework.session import table

_MODULES = [packed, notices, events]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest notices, triaged by title, joined to their sources, the newest fifty of them."""
    found = versions.latest(table(spark, sf_dir, "notice"), ["id"], ["last_seen_at"])
    found = found.withColumn("t", triage.triage(F.col("normalized_title"), notices.POLICY)).where("t.decision <> 'noise'")
    sources = table(spark, sf_dir, "source_registry").select(F.col("id").alias("source_id"), "publisher", "region_code")
    joined = found.join(F.broadcast(sources), "source_id", "left")  # the registry is a fixed list
    out = topk.top_k(joined, [F.col("first_seen_at").desc(), F.col("id")], 50)
    return out.select("id", "title", "publisher", "region_code", F.col("t.decision").alias("decision"), F.array_join("t.matched_terms", ",").alias("matched_terms"), "first_seen_at")



def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
