"""All retail layers in one incremental run.

New landing files become bronze rows, bronze rows change the type-1 states, and the
partitions of silver and gold tables that the changes touch are replaced. A rerun
without new files writes no table and only adds log rows; a run that broke off is
made good by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans import retail as r
from ..sources import append_rows, ensure_table, file_stream
from .gold import Notes, SalesSums, gold_tables, silver_table
from .ingest import FEEDS, ingest_all
from .retail import StreamedState, append_quarantine

# Bronze table -> (silver table, key, staging step).
SILVER = {
    "bronze_sales_transactions": ("silver_sales_transactions", "transaction_id", r.stage_sales),
    "bronze_product_master": ("silver_product_master", "product_id", r.stage_products),
    "bronze_store_region": ("silver_store_region", "store_id", r.stage_stores),
}
_STAMPS = [T.StructField("ingestion_timestamp", T.TimestampType()), T.StructField("source_system", T.StringType()),
           T.StructField("ingestion_date", T.DateType())]


def _bronze_shape(table: str) -> T.StructType:
    return T.StructType(FEEDS[table][1].fields + _STAMPS)


def _bronze_stream(spark: SparkSession, store: str, table: str) -> DataFrame:
    schema = _bronze_shape(table)
    ensure_table(spark, f"{store}/bronze/{table}", schema)  # a feed may have no file yet
    stream = file_stream(spark, f"{store}/bronze/{table}", schema, "parquet")
    return stream.withWatermark("ingestion_timestamp", "1 day") if table == "bronze_sales_transactions" else stream


def run(spark: SparkSession, landing: str, store: str) -> DataFrame:
    """Process what is new under ``landing``; returns the metric rows it logged.

    Rows of one micro-batch carry one ingestion time; among them a hash of the
    row decides which goes first. A feed may have no file yet.
    """
    ingest_all(spark, landing, f"{store}/bronze", f"{store}/checkpoints/bronze")
    notes, silver, states = Notes(spark, f"{store}/built"), {}, []
    for bronze, (name, key, stage) in SILVER.items():
        changes = stage(_bronze_stream(spark, store, bronze))
        states.append(StreamedState(spark, f"{store}/state/{name}", [key], ["ingestion_timestamp"], changes.schema, few=True))
        states[-1].absorb(changes, f"{store}/checkpoints/{name}")
        states[-1].advance()
        silver[name] = silver_table(notes, store, f"silver/{name}", states[-1])
    staged = r.stage_sales(_bronze_stream(spark, store, "bronze_sales_transactions"))
    quarantine = f"{store}/silver/silver_sales_quarantine"
    append_quarantine(staged, quarantine, f"{store}/checkpoints/silver_sales_quarantine")
    sales, products, stores = states
    gold = gold_tables(notes, store, SalesSums(notes, f"{store}/sums", sales), stores, products)
    bronze = {name: spark.read.schema(_bronze_shape(name)).parquet(f"{store}/bronze/{name}") for name in SILVER}
    rejected = T.StructType(staged.schema.fields + [T.StructField("rejection_reason", T.StringType())])
    ensure_table(spark, quarantine, rejected)
    metrics = r.layer_counts(bronze, silver, gold).unionByName(
        r.rejection_counts(spark.read.schema(rejected).parquet(quarantine)))
    append_rows(r.stamp_run(metrics), f"{store}/pipeline_data_quality_log")
    return metrics
