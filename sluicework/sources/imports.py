"""Imports of registries and policies: CSV whitelists, JSON lists, validated before anything is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.functions.urls import host
from sluicework.operators.validate import row_errors

INSTITUTION_FIELDS = ("institution_id", "institution_name", "city", "ownership", "school_level", "official_domain", "official_site_url")
SOURCE = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("id", "source_group", "institution_id", "region_code", "publisher", "source_level", "entry_url")), T.StructField("allowed_domains", T.ArrayType(T.StringType())),
    *(T.StructField(n, T.StringType()) for n in ("adapter", "keyword_policy_id")), T.StructField("keyword_policy_version", T.IntegerType()), T.StructField("status", T.StringType()), T.StructField("max_pages", T.IntegerType()),
])


def ensure_columns(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """The schema's columns in its order and types; missing columns and values take their defaults."""
    defaults = defaults or {}
    held = lambda n: F.coalesce(F.col(n), F.lit(defaults.get(n))) if n in df.columns and n in defaults else F.col(n) if n in df.columns else F.lit(defaults.get(n))
    return df.select(*(held(f.name).cast(f.dataType).alias(f.name) for f in schema))


def read_institutions(spark: SparkSession, path: str, cities: DataFrame, levels: tuple[str, ...] = ("higher_vocational", "undergraduate")) -> DataFrame:
    """A CSV whitelist with an ``errors`` list for each row. cities: city, region_code."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8", schema=", ".join(f"{n} string" for n in INSTITUTION_FIELDS), enforceSchema=False)
    rows = rows.withColumn("institution_id", F.replace("institution_id", F.lit("\ufeff"), F.lit(""))).join(F.broadcast(cities), "city", "left")  # a province's cities
    checks = {f"{n} missing": F.trim(n) != "" for n in INSTITUTION_FIELDS} | {"unknown city": F.col("region_code").isNotNull(), "ownership": F.col("ownership") == "public", "school level": F.col("school_level").isin(*levels)}
    return row_errors(rows, checks, ["institution_id", "official_domain"], list(INSTITUTION_FIELDS)).withColumn("row_sha256", F.sha2(F.concat_ws("\u001f", *INSTITUTION_FIELDS), 256))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of sources with errors; missing columns get their defaults."""
    rows = ensure_columns(spark.read.option("multiLine", True).json(path), SOURCE, {"adapter": "generic_html_v1", "status": "enabled", "max_pages": 1})
    rows = rows.withColumn("allowed_domains", F.coalesce("allowed_domains", F.array(host(F.col("entry_url")))))
    checks = {"id missing": F.trim("id") != "", "url missing": F.trim("entry_url") != "", "placeholder url": ~F.col("entry_url").rlike("<[^>]*>"), "url": F.col("entry_url").rlike("^https?://[^/]+"), "max_pages": F.col("max_pages").between(1, 20)}
    return row_errors(rows, checks, ["id", "entry_url"], ["id", "entry_url"])


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """Policies of a JSON file, given as a list or under ``policies``."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.select(F.explode("policies").alias("p")).select("p.*") if rows.columns == ["policies"] else rows
