"""Incremental ingestion of CSV feeds into the bronze layer."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..plans.retail import stamp_ingestion
from ..sources import file_stream, write_stream

FEEDS = {
    "bronze_sales_transactions": ("sales", schemas.SALES_FEED),
    "bronze_product_master": ("products", schemas.PRODUCT_FEED),
    "bronze_store_region": ("stores", schemas.STORE_FEED),
}


def ingest(spark: SparkSession, landing: str, bronze: str, checkpoint: str, schema: T.StructType,
           files_per_batch: int | None = None) -> StreamingQuery:
    """Append the new files of one feed, stamped, partitioned by ingestion date.

    The checkpoint remembers the files, so a rerun adds nothing twice.
    """
    feed = stamp_ingestion(file_stream(spark, landing, schema, "csv", files_per_batch))
    return write_stream(feed, checkpoint, bronze, ["ingestion_date"])


def ingest_all(spark: SparkSession, landing: str, bronze: str, checkpoints: str) -> None:
    """All three feeds, each with its own checkpoint."""
    for table, (feed, schema) in FEEDS.items():
        ingest(spark, f"{landing}/{feed}", f"{bronze}/{table}", f"{checkpoints}/{table}", schema)
