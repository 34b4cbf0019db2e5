"""Category catalogs: lookups and the closure of cross-references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.session import checkpointed


def bare(name: Column) -> Column:
    """A name without white space and without its bracketed parts."""
    return F.regexp_replace(F.regexp_replace(name, "(?U)\\s+", ""), "[(（][^()（）]*[)）]", "")


def members(catalog: DataFrame, category: str, level: str | None = None) -> DataFrame:
    chosen = catalog.where(F.col("category") == category)
    return (chosen.where(F.col("study_level") == level) if level else chosen).select("catalog_name").distinct()


def memberships(df: DataFrame, column: str, catalog: DataFrame, name: str = "catalog_name", aliases: str | None = None) -> DataFrame:
    """The rows with each catalog entry that a name equals, by itself or without its bracketed parts: an equi-join on both forms.

    White space counts for nothing; an entry is met once by a row, however many of its names fit. Rows without an entry are left out.
    """
    names = F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))) if aliases else F.array(name)
    plain = lambda c: F.regexp_replace(c, "(?U)\\s+", "")
    forms = lambda c: F.array_distinct(F.filter(F.array(plain(c), bare(c)), lambda x: x != ""))
    entries = catalog.withColumn("__form", F.explode(F.array_distinct(F.transform(names, plain)))).where("__form <> ''")
    numbered = df.withColumn("__row", F.monotonically_increasing_id())
    met = numbered.withColumn("__form", F.explode(forms(F.col(column)))).join(entries, "__form").drop("__form")
    return met.dropDuplicates(["__row", *[c for c in catalog.columns if catalog.schema[c].dataType.simpleString() != "array<string>"]]).drop("__row")


def closure(edges: DataFrame, src: str, dst: str, most_rounds: int = 64) -> DataFrame:
    """All (src, dst) pairs that a path of edges joins, cycles included, by doubling: n rounds follow paths of 2^n edges.

    Each round's pairs are checkpointed, so the plan doesn't grow; it ends when a round adds none. A pair
    (a, a) comes out only if a cycle leads back.
    """
    known = checkpointed(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct())
    n = known.count()
    for _ in range(most_rounds):
        longer = known.alias("x").join(known.alias("y"), F.col("x.d") == F.col("y.s")).select(F.col("x.s").alias("s"), F.col("y.d").alias("d"))
        known = checkpointed(known.unionByName(longer).distinct())
        grown = known.count()
        if grown == n:
            return known.select(F.col("s").alias(src), F.col("d").alias(dst))
        n = grown
    raise ValueError("no end in sight")
