"""The llm queries by name, over the whole recruitment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.llm import boilerplate, canonical, confusables, languages, leaks, mojibake, neardup, packing
from sluicework.operators.multivalue import is_no_value, split_packed
from sluicework.session import checkpointed, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "evidence_version").where(boilerplate.is_html(F.col("content_type")))
    lines = boilerplate.main_lines(pages, "id", "extracted_text", "source_url", "notice_id", table(spark, sf_dir, "notice"))
    return lines.select(F.col("id").alias("evidence_id"), "line_no").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of major_requirement, split as in problem 2, and each profile's major, with the entry it means."""
    vocabulary = canonical.build_vocabulary(table(spark, sf_dir, "major_catalog"), "catalog_id", "catalog_name", "aliases", "major_code")
    positions = split_packed(table(spark, sf_dir, "position_record"), ["id"], ["major_requirement"])
    profiles = table(spark, sf_dir, "user_profile").where(~is_no_value(F.col("major")))
    values = positions.selectExpr("'position' AS record_kind", "id AS record_id", "item_no", "item_value AS written").unionByName(
        profiles.selectExpr("'profile' AS record_kind", "id AS record_id", "1 AS item_no", "major AS written")
    )
    mapped = canonical.map_values(values, ["record_kind", "record_id", "item_no"], "written", vocabulary)
    return mapped.selectExpr("record_kind", "record_id", "item_no", "entry_id AS catalog_id").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, source, text, gram, threshold in (("title", "notice", "title", 3, 0.6), ("text", "evidence_version", "extracted_text", 5, 0.7)):
        found = neardup.id_pairs(*neardup.similar_classes(table(spark, sf_dir, source), "id", text, gram, threshold))
        found = found.select(F.lit(name).alias("field_name"), "id_a", "id_b")
        out = found if out is None else out.unionByName(found)
    return out


def p4_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of notices with similar titles, in the stored normal form."""
    found = neardup.id_pairs(*neardup.similar_classes(table(spark, sf_dir, "notice"), "id", "normalized_title", 3, 0.6))
    return found.select("id_a", "id_b")


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each evidence with its class of equal texts, and how many classes of other texts are similar."""
    return neardup.class_rows(*neardup.similar_classes(table(spark, sf_dir, "evidence_version"), "id", "extracted_text", 5, 0.7))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = mojibake.find_garbled(table(spark, sf_dir, "evidence_version"), ["id"], "extracted_text")
    positions = mojibake.find_garbled(table(spark, sf_dir, "position_record"), ["id"], "raw_row")
    out = evidence.select(F.lit("evidence").alias("record_kind"), F.col("id").alias("record_id"))
    return out.unionByName(positions.select(F.lit("position").alias("record_kind"), F.col("id").alias("record_id"))).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = confusables.affected_values(table(spark, sf_dir, "position_record"), ["id"], ["position_name", "employer", "position_code"])
    return found.select(F.col("id").alias("position_id"), "field_name").distinct()


#: Tokens of a training sequence.
SEQUENCE_TOKENS = 2048


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, in tokens of a public tokenizer, in training sequences of fixed capacity."""
    sizes = packing.token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "tokens", SEQUENCE_TOKENS)


def packing_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p8_packed must keep, counted over all texts and sequences."""
    sizes = checkpointed(packing.token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return packing.packing_report(sizes, packing.pack(sizes, "doc_id", "tokens", SEQUENCE_TOKENS), "doc_id", "tokens", SEQUENCE_TOKENS)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    return found.select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = languages.label_segments(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return segments.where("n_segments > 1 or not label_right").select("doc_id", "segment_no", "lang").distinct()


def queries() -> dict:
    found = (p1_found, p3_found, p4_found, p4_titles, p4_classes, p6_found, p7_found, p8_packed, packing_check, p9_found, p10_found)
    return {f.__name__: f for f in found}


ORACLES = {
    "p4_titles": """WITH t AS (SELECT DISTINCT id, normalized_title AS x FROM notice WHERE length(normalized_title) >= 3),
        g AS (SELECT DISTINCT id, unnest([x[i:i + 2] for i in range(1, length(x) - 1)]) AS gram FROM t), n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
        b AS (SELECT p.id AS id_a, q.id AS id_b, count(*) AS k FROM g p JOIN g q ON p.gram = q.gram AND p.id < q.id GROUP BY 1, 2)
        SELECT id_a, id_b FROM b JOIN n p ON p.id = id_a JOIN n q ON q.id = id_b WHERE k >= 0.6 * (p.n + q.n - k)""",
    "packing_check": "SELECT count(*) AS items, 0::BIGINT AS items_not_whole, 0::BIGINT AS items_cut_though_they_fit, 0::BIGINT AS containers_over_capacity, true AS filled FROM documents WHERE text <> ''",
}


def oracle_sql() -> dict:
    return ORACLES
