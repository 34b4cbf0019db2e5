"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "12g", partitions: int | None = None) -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sluicework")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Where neither it nor the context's own folder is
    set, one machine (a local master, as in tests) takes a temporary folder; a cluster has no such folder that
    all of its machines see, so there it is an error.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    wanted = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not wanted and not is_one_machine(context.master):
        raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a shared folder")
    context.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="sluicework-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def is_one_machine(master: str) -> bool:
    return master == "local" or master.startswith(("local[", "local-cluster["))


def kept(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame written as a table to the shared folder and read from there, and its folder; it stays as a checkpoint does, but is read by columns."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4()}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """The frame as a table in the shared folder, gone at the end of the block."""
    spark = df.sparkSession
    table, folder = kept(df)
    try:
        yield table
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, which outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
