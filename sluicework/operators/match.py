"""Fan-out of events to subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicework.session import checkpointed


def in_region(code: Column, wanted: Column) -> Column:
    """Equal, or below: no LIKE, as codes hold its wildcards."""
    return (code == wanted) | code.startswith(F.concat(wanted, F.lit("-")))


def region_ancestors(code: Column) -> Column:
    """A code and all codes above it: A-B-C gives A, A-B and A-B-C."""
    parts = F.split(code, "-")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))


def region_fanout(events: DataFrame, code: str, profiles: DataFrame, regions: str) -> DataFrame:
    """Events with each profile that watches their region or one above it: an equi-join on the ancestors, no nested loop.

    A region below another that the profile watches adds nothing and is left out, so an event meets a
    profile once and nothing need be made distinct afterwards; repeated events stay repeated.
    """
    wide = events.withColumn("__region", F.explode(F.array_distinct(region_ancestors(F.col(code)))))
    return wide.join(profiles.withColumn("__region", F.explode(_top_regions(regions))), "__region").drop("__region")


def _top_regions(regions: str) -> Column:
    """The different regions of a list without those below another of them."""
    own = F.array_distinct(regions)
    return F.filter(own, lambda r: r.isNotNull() & ~F.exists(own, lambda s: F.coalesce(r.startswith(F.concat(s, F.lit("-"))), F.lit(False))))


def region_pairs(events: DataFrame, event: str, code: str, profiles: DataFrame, profile: str, regions: str, side: int = 12_288) -> DataFrame:
    """The fan-out's pairs of ids, where a region may have any number of either: the rows of ``region_fanout``, only the two columns.

    The events and the profiles of a region are split by a hash of their ids into blocks of about ``side``, and each pair of blocks is a
    tile, which is a task of its own, so no task has more than about side x side pairs however many watch one region. A tile
    takes its ids in chunks, 16 events with 256 profiles at a time, as rows in such an order are written in a
    fraction of the bytes; 12,288 ids of 64 characters fit a dictionary of Parquet (1 MB). An id is shuffled once for each block
    that its own meets. The numbers of events and profiles of each region are counted first.
    """
    left = events.select(F.col(event).alias("__id"), F.explode(F.array_distinct(region_ancestors(F.col(code)))).alias("__region"))
    right = profiles.select(F.col(profile).alias("__id"), F.explode(_top_regions(regions)).alias("__region"))
    held = left.groupBy("__region").agg(F.count("*").alias("l")).join(right.groupBy("__region").agg(F.count("*").alias("r")), "__region")
    held = held.select("__region", F.ceil(F.col("l") / side).alias("l"), F.ceil(F.col("r") / side).alias("r"))
    # As many rows as regions.
    held = checkpointed(held.withColumn("first", F.sum(F.col("l") * F.col("r")).over(Window.orderBy("__region")) - F.col("l") * F.col("r")))
    tiles = held.agg(F.sum(F.col("l") * F.col("r"))).first()[0] or 1

    def chunks(ids: DataFrame, own: str, other: str, name: str, size: int) -> DataFrame:
        blocks = ids.join(held, "__region").withColumn("__block", F.pmod(F.xxhash64("__id"), F.col(own)))
        # In structs, as a list would lose ids that are null.
        blocks = blocks.groupBy("__region", "first", "l", "r", "__block").agg(F.collect_list(F.struct("__id"))["__id"].alias("ids"))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / size)), lambda k: F.slice("ids", (k * size + 1).cast("int"), size))
        met = blocks.select("first", "l", "r", "__block", F.explode(cut).alias(name)).withColumn("__met", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
        at = F.col("__block") * F.col("r") + F.col("__met") if own == "l" else F.col("__met") * F.col("r") + F.col("__block")
        return met.select((F.col("first") + at).cast("int").alias("__tile"), name).repartitionById(tiles, F.col("__tile"))

    met = chunks(left, "l", "r", event, 16).hint("merge").join(chunks(right, "r", "l", profile, 256), "__tile")
    return met.select(F.explode(event).alias(event), profile).select(event, F.explode(profile).alias(profile))


def watched_regions(regions: Column) -> Column:
    """The different regions of a list in order: one form for all lists that watch the same."""
    return F.array_sort(F.array_distinct(regions))


def watched_cells(cells: DataFrame, cell: str, profiles: DataFrame, regions: str) -> DataFrame:
    """The fan-out without its pairs: each different cell, a list of region codes, with each different list of regions that watches one of its codes or one above it.

    What all events of a cell have in common is reduced to a row of the cell first, joined here, and reduced to a row of each list of
    regions; the profiles are joined to that last. So no event is paired with a profile to be counted or ranked.
    Each cell and list are one row, however many of their codes meet. Empty and null ones give none.
    """
    codes = F.array_distinct(F.flatten(F.transform(cell, region_ancestors)))
    wide = cells.select(cell).distinct().withColumn("__region", F.explode(codes))
    own = profiles.select(regions).distinct().withColumn("__region", F.explode(regions))
    return wide.join(own, "__region").select(cell, regions).distinct()


def terms_fit(text: Column, include: Column, exclude: Column) -> Column:
    """Some included term (or none asked for) and no excluded one."""
    none = F.size(F.coalesce(include, F.array().cast("array<string>"))) == 0
    return (none | F.exists(include, lambda t: text.contains(t))) & ~F.coalesce(F.exists(exclude, lambda t: text.contains(t)), F.lit(False))


def is_wanted(value: Column, wanted: Column) -> Column:
    """Whether a value is among the wanted ones; none wanted means any, and a null is among none."""
    return (F.size(F.coalesce(wanted, F.array().cast("array<string>"))) == 0) | F.coalesce(F.array_contains(wanted, value), F.lit(False))


def subscription_fits(text: Column, institution: Column, event_type: Column, include: Column, exclude: Column, institutions: Column, event_types: Column) -> Column:
    """A subscription's whole predicate but for the region, which ``region_fanout`` joins: terms, institutions and kinds of event."""
    return terms_fit(text, include, exclude) & is_wanted(institution, institutions) & is_wanted(event_type, event_types)


def scopes_overlap(group: Column, groups: dict[str, list[str]], wanted: Column) -> Column:
    """Whether a source group's scopes meet the wanted ones."""
    scopes = F.create_map(*(x for k, v in groups.items() for x in (F.lit(k), F.array(*(F.lit(s) for s in v)))))
    return F.coalesce(F.arrays_overlap(F.element_at(scopes, group), wanted), F.lit(False))
