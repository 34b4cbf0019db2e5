"""The incremental side: dedup, change events and source health as streams, and a poll loop.

Each is the streaming form of a batch operator and gives the same rows over input that arrives in order.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluicework.session import ensure_checkpoint_dir


def novel(stream: DataFrame, keys: list[str], time: str | None = None, late: str = "7 days") -> DataFrame:
    """Rows of keys not seen before: at most one for each key. With a time column the state is dropped after ``late``."""
    if time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


HEALTH = T.StructType([T.StructField("key", T.StringType()), T.StructField("at", T.TimestampNTZType()), T.StructField("failures", T.LongType()), T.StructField("state", T.StringType())])


def _health(degraded_at: int):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        # A micro-batch's rows of one source, in time order.
        rows = pd.concat(list(batches)).sort_values(["at", "n"])
        for failed in rows["failed"]:
            failures = failures + 1 if failed else 0
        state.update((int(failures),))
        yield pd.DataFrame({"key": [key[0]], "at": [rows["at"].iloc[-1]], "failures": [failures], "state": ["degraded" if failures >= degraded_at else "enabled"]})

    return update


def source_health(stream: DataFrame, key: str, at: str, n: str, failed: str, degraded_at: int = 3) -> DataFrame:
    """Failures in a row and state of each source after each micro-batch (update mode); the state is one number a source."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.col(n).alias("n"), F.col(failed).alias("failed"))
    return rows.groupBy("key").applyInPandasWithState(_health(degraded_at), HEALTH, "failures long", "update", GroupStateTimeout.NoTimeout)


VERSIONS = T.StructType([T.StructField("key", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("event_type", T.StringType())])


def _versions(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["at", "digest"])
    kinds = [f"content_change:{d[:16]}" for d in rows["digest"]]
    if not state.exists:
        kinds[0] = "new"
        state.update((True,))
    yield pd.DataFrame({"key": key[0], "digest": rows["digest"].to_numpy(), "event_type": kinds})


def version_events(stream: DataFrame, key: str, at: str, digest: str) -> DataFrame:
    """An event for each new content of a record: ``new`` for the first that arrives, else ``content_change:`` and the digest's start.

    Contents are made distinct by a stateful dedup, a row of the state store each, so no record's state grows into one value; what follows keeps one flag a record.
    """
    rows = stream.where(F.col(digest).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.col(digest).alias("digest"))
    return rows.dropDuplicates(["key", "digest"]).groupBy("key").applyInPandasWithState(_versions, VERSIONS, "known boolean", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Runs a stream over all that is available now, and returns what it wrote, with the number of its micro-batch."""
    spark = stream.sparkSession
    base = folder or os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4()}")
    out = f"{base}/out"

    def write(batch: DataFrame, n: int) -> None:
        # By the batch's number: a batch that runs again after a failure replaces what it wrote.
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)


def poll(cycle: Callable[[], dict], seconds: float, cycles: int | None = None, sleep: Callable[[float], None] | None = None, report: Callable[[dict], None] = print) -> None:
    """Runs a cycle again and again, at least five seconds apart; a failed cycle is reported and doesn't end the loop."""
    import time

    n = 0
    while cycles is None or n < cycles:
        try:
            report(cycle())
        except Exception as e:  # one bad cycle must not stop the monitor
            report({"error": str(e)})
        n += 1
        if cycles is None or n < cycles:
            (sleep or time.sleep)(max(5.0, seconds))


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def arrivals(df: DataFrame, order: str, parts: int = 4) -> str:
    """The table in the shared folder as files that arrive one after another, by equal ranges of a column; returns the folder.

    For replaying a stored table as a stream of several micro-batches. Nulls arrive first.
    """
    folder = os.path.join(ensure_checkpoint_dir(df.sparkSession), f"arrivals-{uuid.uuid4()}")
    low, high = df.agg(F.min(F.col(order).cast("timestamp").cast("double")), F.max(F.col(order).cast("timestamp").cast("double"))).first()
    width = ((high or 0.0) - (low or 0.0)) / parts or 1.0
    part = F.least(F.lit(parts - 1), F.floor((F.coalesce(F.col(order).cast("timestamp").cast("double"), F.lit(low or 0.0)) - (low or 0.0)) / width))
    for n in range(parts):
        df.where(part == n).coalesce(1).write.mode("append").parquet(folder)
    return folder
