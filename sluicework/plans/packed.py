"""Queries of the core's problems 2 and 5 on the recruitment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluicework.operators.multivalue import split_packed
from sluicework.operators.snapshots import snapshot_changes
from sluicework.session import table

PACKED_FIELDS = ("major_requirement", "other_requirements", "certificate_requirement")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = split_packed(table(spark, sf_dir, "position_record"), ["id"], PACKED_FIELDS).where("n_items > 1")
    return values.selectExpr("id AS position_id", "field_name", "item_no", "item_value").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = table(spark, sf_dir, "evidence_snapshot")
    return snapshot_changes(snapshots, "id", "snapshot_no", ["source_url", "content_sha256", "extracted_text"], "loaded_at").distinct()


QUERIES = {"p2_found": p2_found, "p5_found": p5_found}

ORACLES = {
    "p5_found": """
        WITH one AS (
          SELECT snapshot_no, id, source_url, content_sha256, extracted_text FROM evidence_snapshot
          QUALIFY row_number() OVER (PARTITION BY snapshot_no, id ORDER BY loaded_at DESC) = 1),
        steps AS (
          SELECT snapshot_no AS later, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before
          FROM (SELECT DISTINCT snapshot_no FROM evidence_snapshot)),
        pairs AS (
          SELECT s.later, a.id AS old_id, b.id AS new_id, a.source_url IS DISTINCT FROM b.source_url
            OR a.content_sha256 IS DISTINCT FROM b.content_sha256 OR a.extracted_text IS DISTINCT FROM b.extracted_text AS differs
          FROM steps s JOIN one b ON b.snapshot_no = s.later
          LEFT JOIN one a ON a.snapshot_no = s.before AND a.id = b.id WHERE s.before IS NOT NULL
          UNION ALL
          SELECT s.later, a.id, NULL, true FROM steps s JOIN one a ON a.snapshot_no = s.before
          WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.snapshot_no = s.later AND b.id = a.id))
        SELECT DISTINCT later AS snapshot_no, coalesce(new_id, old_id) AS id,
          CASE WHEN new_id IS NULL THEN 'removed' WHEN old_id IS NULL THEN 'added' ELSE 'changed' END AS change
        FROM pairs WHERE differs OR old_id IS NULL
    """,
}
