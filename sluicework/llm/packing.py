"""Filling fixed-capacity containers with items (problem 8).

Bulk-synchronous best-fit. The pieces are range-sorted by size, which leaves at most ``capacity``
different sizes however many pieces there are; the gaps of the containers are kept sorted likewise,
as runs of containers with the same gap. Each superstep takes all pieces of the next smaller size at once,
sweeps the gaps from the smallest that is large enough (the successor) upwards, gives the pieces to the
containers by rank, updates the gaps, and opens containers for those left over. A piece thus learns its
container from its size and its rank alone: the sweeps run on the runs, of which there are as many as
the capacity allows, and the pieces meet them by an equi-join on size and a bucket of ranks.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.session import checkpointed

#: Rows of a plan up to which it is broadcast, at some 40 bytes each; a longer one is shuffled.
BROADCAST_ROWS = 1_000_000
#: Pieces of one size in a bucket at most, so that a size that fills a third of the table is spread.
BUCKET_PIECES = 1 << 18


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(size, first rank, pieces, first container) of runs of pieces that go to consecutive containers, one each.

    counts: pieces of each size from 1 to capacity. Ranks start at 0 in each size.
    """
    gaps: list[int] = []  # sorted
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> (first container, containers)
    out, opened = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap > 0:
            if gap not in runs:
                bisect.insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            at = bisect.bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                take = min(left, n)
                if take < n:
                    runs[gap].append((first + take, n - take))
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                # Pieces of one size that share a container are no reason to open another.
                gap, take = capacity, -(-left // (capacity // size))
                first, opened = opened, opened + take
            out.append((size, rank, take, first))
            add(gap - size, first, take)
            rank, left = rank + take, left - take
    return out


def encoding(vocabulary: str | None = None, pattern: str | None = None):
    """A byte-level tokenizer; vocabulary: path of a file of ranks, pattern: how texts are cut into words, by default the installed public ones."""
    import tiktoken

    if vocabulary is None or pattern is None:
        import public_tokenizers

        vocabulary, pattern = vocabulary or str(public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, key: str, text: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, tokens) of each text, whole; null and '' have none. Strings of special tokens are ordinary text."""
    schema = T.StructType([df.schema[key], T.StructField("tokens", T.LongType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoding(vocabulary, pattern)
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "tokens": [len(own.encode_ordinary(t)) for t in batch["__t"]]})

    return df.select(key, F.coalesce(df[text], F.lit("")).alias("__t")).mapInPandas(count, schema)


def rank_buckets(rows: list[tuple[int, int, int, int]], counts: dict[int, int]) -> tuple[dict[int, int], dict[str, np.ndarray]]:
    """Width of each size's buckets of ranks, and the plan's runs cut at the buckets' borders.

    A bucket is as wide as a size's runs on average, so the cuts at most double the runs, and never wider than
    BUCKET_PIECES.
    """
    size, first, n, container = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
    runs = dict(zip(*(x.tolist() for x in np.unique(size, return_counts=True))))
    widths = {s: min(BUCKET_PIECES, -(-counts[s] // k)) for s, k in runs.items()}
    wide = np.array([widths[s] for s in size.tolist()], np.int64)
    low, high = first // np.maximum(wide, 1), (first + n - 1) // np.maximum(wide, 1)
    times = high - low + 1
    at = np.repeat(np.arange(len(size)), times)
    bucket = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    return widths, {"length": size[at], "__bucket": bucket, "__first": first[at], "__n": n[at], "__container": container[at]}


def pack(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Containers of the items.

    Returns key, ``piece_no`` (from 1), ``start`` and ``length`` (the item's part, in units of size) and
    ``container`` (from 0). An item is cut only if it is larger than the capacity: into full
    containers and a rest. Null sizes and sizes below 1 take no room and give no row; repeated items are packed as
    often as they occur; only key and size are read. Equal input gives an equal result.

    Sizes are checkpointed first, as what measures them may be dear and the range sort reads them twice. The
    pieces are sorted by range with a number of their own as the last key, so that neither a size nor a key which
    a third of all pieces have fills one task; what the driver holds has a row for each different size and each
    task, and the plan at most a few for each pair of sizes, whatever the number of items. A plan of more than
    BROADCAST_ROWS rows is shuffled instead of broadcast; no bucket of a size has more than BUCKET_PIECES pieces.
    """
    if capacity < 1:
        raise ValueError("capacity is at least 1")
    spark = df.sparkSession
    items = checkpointed(df.select(F.col(key).alias("k"), F.col(size).cast("long").alias("n")).where("n >= 1"))
    items = items.withColumn("__own", F.monotonically_increasing_id())
    parts = F.sequence(F.lit(1), F.ceil(F.col("n") / capacity))
    pieces = items.select("k", F.explode(parts).alias("piece_no"), "n", "__own")
    pieces = pieces.withColumn("start", (F.col("piece_no") - 1) * capacity).withColumn("length", F.least(F.lit(capacity), F.col("n") - F.col("start"))).drop("n")
    order = ("length", "k", "piece_no", "__own")
    ranged = checkpointed(pieces.repartitionByRange(*order).sortWithinPartitions(*order).drop("__own"))
    placed = ranged.withColumn("__id", F.monotonically_increasing_id())
    placed = placed.withColumn("__part", F.shiftright("__id", 33)).withColumn("__row", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    # One row for each partition and size at its border: bounded by both.
    runs = placed.groupBy("length", "__part").agg(F.count("*").alias("n"), F.min("__row").alias("low")).collect()
    counts: dict[int, int] = {}
    offsets = []
    for r in sorted(runs, key=lambda r: (r.length, r["__part"])):
        offsets.append((r.length, r["__part"], counts.get(r.length, 0) - r.low))
        counts[r.length] = counts.get(r.length, 0) + r.n
    widths, cut = rank_buckets(plan(counts, capacity), counts)
    ints = lambda names, columns: pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})
    offset = spark.createDataFrame(ints(("length", "__part", "__shift", "__wide"), zip(*((*o, widths[o[0]]) for o in offsets)) if offsets else [[]] * 4))
    steps = spark.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in cut.items()}))
    sized = lambda table, rows: F.broadcast(table) if rows <= BROADCAST_ROWS else table
    ranked = placed.join(sized(offset, len(offsets)), ["length", "__part"]).withColumn("__rank", F.col("__row") + F.col("__shift"))
    ranked = ranked.withColumn("__bucket", F.floor(F.col("__rank") / F.col("__wide")))
    found = ranked.join(sized(steps, len(cut["length"])), ["length", "__bucket"]).where((F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__first") + F.col("__n")))
    return found.select(F.col("k").alias(key), F.col("piece_no").cast("int"), "start", "length", (F.col("__container") + F.col("__rank") - F.col("__first")).alias("container"))


def packing_report(items: DataFrame, packed: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """One row on what a packing must keep: ``items``, ``items_not_whole``, ``items_cut_though_they_fit``,
    ``containers_over_capacity``, and whether they are ``filled`` to 0.98 of their number's room, but for the last.

    Keys are unique here. Nothing is brought together but one row a container and an item, aggregated before the shuffle.
    """
    own = packed.groupBy(F.col(key).alias("k")).agg(F.sum("length").alias("got"), F.count("*").alias("pieces"))
    both = items.select(F.col(key).alias("k"), F.col(size).alias("n")).where("n >= 1").join(own, "k", "left")
    whole = both.agg(F.count("*").alias("items"), F.count_if(~F.col("n").eqNullSafe(F.col("got"))).alias("items_not_whole"), F.count_if((F.col("n") <= capacity) & (F.col("pieces") > 1)).alias("items_cut_though_they_fit"))
    load = packed.groupBy("container").agg(F.sum("length").alias("n"))
    filled = (F.coalesce(F.sum("n"), F.lit(0)) >= 0.98 * capacity * (F.count("*") - 1)).alias("filled")
    return whole.crossJoin(load.agg(F.count_if(F.col("n") > capacity).alias("containers_over_capacity"), filled))
