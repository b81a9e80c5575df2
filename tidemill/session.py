"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every result depends on (time zone) or every plan profits from.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HotSpot never compiles methods above 8000 bytes; beyond that, generated code without
    # whole-stage fusion, which is split into small methods, runs several times faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Long texts: a batch for a Python task stays at a few megabytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


_START_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def get_session(app: str = "tidemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; a cluster supplies its own master."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Recording the Python line of every column expression costs more than planning the query.
    conf = {"spark.python.sql.dataFrameDebugging.enabled": "false", **conf}
    for key, value in {**_RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return settle(builder.getOrCreate())


def settle(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    if not spark.sparkContext.master.startswith("local") and not spark.conf.get(_START_PARTITIONS, None):
        # Shuffles start wide enough for the cluster; adaptive execution merges what turns out small.
        width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
        spark.conf.set(_START_PARTITIONS, str(width))
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder path every executor can reach.

    It lies under ``spark.checkpoint.dir``. Only a local master may fall back to
    a temporary folder of the machine, because there all tasks share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several steps read to the scratch folder, and read it from there."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Inside, every execution's shuffle files go when it ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
