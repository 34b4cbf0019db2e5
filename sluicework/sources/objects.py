"""A content-addressed store of bodies: <root>/<first two hex>/<sha256>.parquet rows, written once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put(df: DataFrame, body: str, root: str) -> DataFrame:
    """Writes the bodies the store lacks, and returns the input with their ``sha256``. Writing again adds nothing."""
    spark = df.sparkSession
    named = df.withColumn("sha256", F.sha2(F.col(body), 256))
    new = named.where(F.col("sha256").isNotNull()).select("sha256", F.col(body).alias("body"), F.substring("sha256", 1, 2).alias("prefix")).dropDuplicates(["sha256"])
    try:
        new = new.join(spark.read.parquet(root).select("sha256"), "sha256", "left_anti")
    except Exception as e:  # no store yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    new.write.mode("append").partitionBy("prefix").parquet(root)
    return named


def get(spark: SparkSession, root: str, digest: str) -> bytes:
    """One body. Anything but a SHA-256 digest is refused."""
    if len(digest) != 64 or set(digest) - set("0123456789abcdef"):
        raise ValueError("not a SHA-256 digest")
    rows = spark.read.parquet(root).where((F.col("prefix") == digest[:2]) & (F.col("sha256") == digest)).select("body").limit(1).collect()
    if not rows:
        raise KeyError(digest)
    return bytes(rows[0].body)


def fetch_bodies(df: DataFrame, digest: str, root: str) -> DataFrame:
    """Joins the bodies to rows by digest; a missing body is null."""
    store = df.sparkSession.read.parquet(root).select(F.col("sha256").alias(digest), "body")
    return df.join(store, digest, "left")


def write_snapshot(df: DataFrame, root: str) -> str:
    """A table's new version in a folder of its own; readers move on when the pointer file names it."""
    path = f"{root}/version-{uuid.uuid4()}"
    df.write.parquet(path)
    df.sparkSession.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").parquet(f"{root}/current")
    return path


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(spark.read.parquet(f"{root}/current").first().path)
