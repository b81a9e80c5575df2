"""Batch and streamed writes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def write_json(df: DataFrame, path: str) -> None:
    """JSON, one record per line, times in ISO form."""
    df.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").json(path)


def write_partitioned(df: DataFrame, path: str, partition_by: Sequence[str], mode: str = "overwrite") -> None:
    """Partitioned parquet; rebalancing avoids both tiny files and one task for a large partition."""
    df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)


def save_table(df: DataFrame, name: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """A managed parquet table."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.format("parquet").mode(mode).partitionBy(*partition_by).saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": name})


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it; a missing one is fine."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def replace_parts(rows: DataFrame, touched: DataFrame, path: str) -> None:
    """Make ``rows`` the content of the ``touched`` partitions (one row of partition values each) and leave all others.

    Partitions that get no row go. Writing the same again gives the same, so a write that broke off is simply repeated.
    ``rows`` is read twice.
    """
    parts = touched.columns
    rows.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    same = [rows[c].eqNullSafe(touched[c]) for c in parts]
    for gone in touched.join(rows.select(*parts).distinct(), same, "left_anti").collect():  # Folders to delete, one by one as all listings are.
        folder = "/".join(f"{c}={'__HIVE_DEFAULT_PARTITION__' if gone[c] is None else gone[c]}" for c in parts)
        remove_folder(rows.sparkSession, f"{path}/{folder}")


def append_rows(df: DataFrame, path: str) -> None:
    """Append to a parquet log."""
    df.write.mode("append").parquet(path)


def ensure_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Make an empty folder where a parquet table is yet to come, so that it can be read and streamed from."""
    try:
        spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        spark.createDataFrame([], schema).limit(0).write.mode("append").partitionBy(schema.names[-1]).parquet(path)


def write_anomalies(records: DataFrame, path: str) -> None:
    """Anomaly records as JSON under kind=/date=; writing a day again replaces that day."""
    (records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("kind", "date").json(path))


def write_stream(df: DataFrame, checkpoint: str, path: str | None = None, partition_by: Sequence[str] = (),
                 each_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Process everything available, then stop. Appends parquet, or hands each batch over."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if each_batch:
        query = writer.foreachBatch(each_batch).start()
    else:
        query = writer.format("parquet").outputMode("append").partitionBy(*partition_by).start(path)
    query.awaitTermination()
    return query
