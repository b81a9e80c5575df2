"""Streaming jobs over the given tables.

Each query writes a landing folder in the shared scratch folder where the job
reads files, runs the stream to the end, and returns the stored result without
the ingestion stamps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..plans import retail as r
from ..session import scratch_dir
from ..sources import file_stream, table, write_stream
from ..streaming import drift, gold
from ..streaming import ingest as bronze
from ..streaming import retail as stream
from ..streaming import trips as ride
from . import retail as retail_inputs
from . import trips as trip_inputs

STAMPS = ["ingestion_timestamp", "ingestion_date"]


def _as_text(df: DataFrame, schema) -> DataFrame:
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast("string").alias(n) for n in schema.names])


def _ingested(spark: SparkSession, feed: DataFrame, schema) -> DataFrame:
    """Land a feed as CSV files, run the ingestion, read the bronze table back."""
    work = scratch_dir(spark, "ingest")
    _as_text(feed, schema).write.option("header", True).csv(f"{work}/landing")
    bronze.ingest(spark, f"{work}/landing", f"{work}/bronze", f"{work}/checkpoint", schema)
    return spark.read.parquet(f"{work}/bronze").drop(*STAMPS)


def sales(spark, d):
    feed = retail_inputs.sales_feed(spark, d)
    whole = {"store_id": "bigint", "product_id": "bigint", "quantity": "int"}
    fixed = {c: "decimal(12,2)" for c in ("unit_price", "discount", "total_amount")}
    return _ingested(spark, feed.withColumns({c: F.col(c).cast(t) for c, t in {**whole, **fixed}.items()}).withColumn(
        "transaction_timestamp", F.date_format("transaction_timestamp", "yyyy-MM-dd")), schemas.SALES_FEED)


def products(spark, d):
    feed = retail_inputs.product_feed(spark, d)
    return _ingested(spark, feed.withColumn("unit_price", F.col("unit_price").cast("decimal(10,2)")), schemas.PRODUCT_FEED)


def stores(spark, d):
    return _ingested(spark, retail_inputs.store_feed(spark, d), schemas.STORE_FEED)


def _trips(spark, d) -> DataFrame:
    events = table(spark, d, "events")
    return trip_inputs.as_trips(file_stream(spark, d, events.schema, "parquet", name_pattern="events.parquet"))


def bronze_trips(spark, d):
    work = scratch_dir(spark, "trips")
    ride.append_valid(_trips(spark, d), f"{work}/bronze", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/bronze")


def flagged_trips(spark, d):
    """A stream from the stored output of another stream."""
    work = scratch_dir(spark, "trips")
    ride.append_valid(_trips(spark, d), f"{work}/bronze", f"{work}/checkpoint-bronze")
    stored = spark.read.parquet(f"{work}/bronze").schema
    valid = file_stream(spark, f"{work}/bronze", stored, "parquet")
    ride.append_flagged(valid, f"{work}/flagged", f"{work}/checkpoint-flagged")
    return spark.read.parquet(f"{work}/flagged")


def _landed_sales(spark, d, work: str) -> DataFrame:
    """The sales feed as a stream over several files, in no particular order of time."""
    feed = retail_inputs.sales_feed(spark, d).withColumn("ingestion_timestamp", F.col("ingestion_timestamp").cast("timestamp"))
    feed.hint("rebalance").write.option("maxRecordsPerFile", 1 + feed.count() // 4).parquet(f"{work}/landing")
    return file_stream(spark, f"{work}/landing", feed.schema, "parquet", files_per_batch=2)


def scd1_sales(spark, d):
    """The type-1 table built by micro-batches; equal to the batch result."""
    work = scratch_dir(spark, "scd1")
    feed = _landed_sales(spark, d, work).withWatermark("ingestion_timestamp", "1 day")
    state = stream.StreamedState(spark, f"{work}/state", ["transaction_id"], retail_inputs.SEQUENCE, few=True)
    state.absorb(r.stage_sales(feed), f"{work}/checkpoint")
    return state.current().select(retail_inputs.STAGED_COLUMNS)


def quarantined(spark, d):
    work = scratch_dir(spark, "quarantine")
    stream.append_quarantine(r.stage_sales(_landed_sales(spark, d, work)), f"{work}/out", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/out").select(*retail_inputs.STAGED_COLUMNS, "rejection_reason")


class _Deliveries:
    """The sales in three deliveries, of which later ones correct earlier ones, and the stores in two."""

    def __init__(self, spark, d):
        self.spark, self.d, self.store = spark, d, scratch_dir(spark, "gold")
        self.notes = gold.Notes(spark, f"{self.store}/built")
        self.sales = stream.StreamedState(spark, f"{self.store}/state/sales", ["transaction_id"], retail_inputs.SEQUENCE, r.stage_sales(self._feed()).schema, few=True)
        self.stores, self.products = (stream.StreamedState(spark, f"{self.store}/state/{name}", [key], ["ingestion_timestamp"], df.schema) for name, key, df in (
            ("stores", "store_id", self._stores()), ("products", "product_id", self._products())))
        self.sums = gold.SalesSums(self.notes, f"{self.store}/sums", self.sales)

    def _feed(self) -> DataFrame:
        return retail_inputs.sales_feed(self.spark, self.d).withColumn("ingestion_timestamp", F.col("ingestion_timestamp").cast("timestamp"))

    def _stores(self) -> DataFrame:
        rows = retail_inputs.store_feed(self.spark, self.d).withColumn("ingestion_timestamp", F.col("ingestion_timestamp").cast("timestamp"))
        return r.stage_stores(rows).withColumn("store_id", F.col("store_id").cast("long"))

    def _products(self) -> DataFrame:
        return r.stage_products(retail_inputs.product_feed(self.spark, self.d)).withColumn("product_id", F.col("product_id").cast("long"))

    def deliver(self, number: int) -> None:
        """Two thirds of the sales, some of which are wrong at first; then most of the rest; then the last ones and the moved stores."""
        feed, share = self._feed(), F.pmod(F.xxhash64("transaction_id", "ingestion_timestamp", "total_amount"), F.lit(24))
        first, last = ((0, 16), (16, 23), (23, 24))[number]
        part = feed.where((share >= first) & (share < last))
        if number == 0:
            other = {c: F.when(F.col(c).isNotNull(), 1 + F.pmod(F.col(c) * 7, F.lit(10))) for c in ("store_id", "product_id", "quantity")}
            early = feed.where(share >= 13).withColumns(other).withColumns({
                c: F.col(c) - F.expr("interval 10 days") for c in ("transaction_timestamp", "ingestion_timestamp")})
            part = part.unionByName(early.select([F.col(c).cast(feed.schema[c].dataType) for c in feed.columns]))
            moved = F.when(F.col("store_id") % 3 == 0, F.concat(F.lit("OLD "), "region")).otherwise(F.col("region"))
            self.stores.put(self._stores().withColumns({"region": moved, "ingestion_timestamp": F.col("ingestion_timestamp") - F.expr("interval 1 day")}), "all", 0)
            self.products.put(self._products(), "all", 0)
        if number == 2:
            self.stores.put(self._stores(), "all", 1)
        self.sales.put(r.stage_sales(part), "all", number)
        for state in (self.sales, self.stores, self.products):
            state.advance()


def _delivered(table: str, *more: str):
    def query(spark, d):
        deliveries = _Deliveries(spark, d)
        dimension = deliveries.products if "product" in table else deliveries.stores
        for number in range(3):
            deliveries.deliver(number)
            found = getattr(gold, table)(deliveries.notes, deliveries.store, deliveries.sums, dimension)
        return found.drop(*more)
    return query


def drifting_sales(spark, d):
    """A feed in three deliveries: the second has its columns in another order, the third lacks the price, has the currency, and writes quantities as text."""
    work = scratch_dir(spark, "drift")
    line = F.substring_index("transaction_id", "-", -1).cast("int")
    feed = retail_inputs.sales_feed(spark, d).select(
        "transaction_id", F.date_format("transaction_timestamp", "yyyy-MM-dd").alias("day"), F.col("store_id").cast("long").alias("store_id"),
        F.col("quantity").cast("int").alias("quantity"), F.col("unit_price").cast("decimal(12,2)").alias("unit_price"), "currency", line.alias("line"))
    deliveries = [feed.where("line < 3").select("transaction_id", "day", "store_id", "quantity", "unit_price"),
                  feed.where("line in (3, 4)").select("quantity", "unit_price", "transaction_id", "store_id", "day"),
                  feed.where("line > 4").select("currency", "transaction_id", "day", "store_id", F.concat("quantity", F.lit(" pcs")).alias("quantity"))]
    for rows in deliveries:
        rows.write.mode("append").option("header", True).csv(f"{work}/landing")
        drift.ingest_drifting(spark, f"{work}/landing", f"{work}/bronze", f"{work}/schema", f"{work}/checkpoint")
    return drift.read_drifting(spark, f"{work}/bronze", f"{work}/schema").drop(*STAMPS)


#: Days from the first of 2024 that a delivery of events spans; the fifth has all later ones.
_SPAN = 6


def _deliver(spark, rows: DataFrame, work: str):
    """The landed events as a stream, after one more delivery."""
    rows.write.mode("append").parquet(f"{work}/landing")
    return file_stream(spark, f"{work}/landing", rows.schema, "parquet")


def _day(ts: str):
    return F.datediff(ts, F.lit("2024-01-01"))


def counted_trips(spark, d):
    """Kept and dropped trips of each of five micro-batches, as counted while they were written."""
    work, events = scratch_dir(spark, "counted"), table(spark, d, "events")
    for number in range(5):
        rows = events.where(F.least(F.floor(_day("ts") / _SPAN), F.lit(4)) == number)
        ride.append_valid_counted(trip_inputs.as_trips(_deliver(spark, rows, work)), f"{work}/bronze", f"{work}/counts", f"{work}/checkpoint")
    written = spark.read.parquet(f"{work}/bronze").groupBy("batch").agg(F.count("*").alias("written"))
    return spark.read.parquet(f"{work}/counts").join(written, "batch").select(F.col("batch").cast("long").alias("batch"), "rule", "kept", "dropped", "written")


def events_once(spark, d):
    """Events in five deliveries that repeat the last day of the one before, bring some of it late, and some of two days earlier too late.

    The watermark of a day keeps each event once as long as it may still be repeated, and drops what comes later than that.
    """
    work, events = scratch_dir(spark, "once"), table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day, turn = _day("ts") % _SPAN, F.least(F.floor(_day("ts") / _SPAN), F.lit(4))
    held = ((day == _SPAN - 1) & (F.col("event_id") % 10 == 3)) | ((day == _SPAN - 3) & (F.col("event_id") % 10 == 7))
    for number in range(5):
        of_turn, before = turn == number, (turn == number - 1) & (held | (day == _SPAN - 1))
        rows = events.where((of_turn & ~held) | before)
        stream_once = stream.drop_replayed(_deliver(spark, rows.repartition(4), work), ["event_id"], "ts", "1 day")
        write_stream(stream_once, f"{work}/checkpoint", f"{work}/out")
    return spark.read.parquet(f"{work}/out").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")


QUERIES = {
    "taxi_counted_stream": counted_trips,
    "events_once_stream": events_once,
    "bronze_schema_drift": drifting_sales,
    "gold_incremental_daily": _delivered("daily_table"),
    "gold_incremental_monthly": _delivered("monthly_table"),
    "gold_incremental_products": _delivered("product_table", "bucket"),
    "bronze_ingest": sales,
    "bronze_ingest_products": products,
    "bronze_ingest_stores": stores,
    "taxi_bronze_stream": bronze_trips,
    "taxi_flagged_stream": flagged_trips,
    "scd1_stream": scd1_sales,
    "quarantine_stream": quarantined,
}

_TEXT = "WITH " + retail_inputs.STAGED_SQL

ORACLE = {
    "bronze_ingest": _TEXT + """SELECT transaction_id, strftime(transaction_timestamp, '%Y-%m-%d') AS transaction_timestamp,
  CAST(store_id AS VARCHAR) AS store_id, CAST(product_id AS VARCHAR) AS product_id, CAST(quantity AS VARCHAR) AS quantity,
  CAST(unit_price AS VARCHAR) AS unit_price, CAST(CASE WHEN discount > 0 THEN discount END AS VARCHAR) AS discount,
  CAST(total_amount AS VARCHAR) AS total_amount, currency, 'us_retail_csv' AS source_system FROM feed""",
    "bronze_schema_drift": _TEXT + """SELECT transaction_id, CAST(transaction_timestamp AS DATE) AS day, CAST(store_id AS BIGINT) AS store_id,
  CASE WHEN line < 5 THEN CAST(quantity AS BIGINT) END AS quantity, CASE WHEN line < 5 THEN CAST(CAST(unit_price AS DECIMAL(12,2)) AS DECIMAL(38,10)) END AS unit_price,
  CASE WHEN line > 4 THEN currency END AS currency,
  CASE WHEN line > 4 AND quantity IS NOT NULL THEN '{"quantity":"' || CAST(CAST(quantity AS INT) AS VARCHAR) || ' pcs"}' END AS _rescued,
  'us_retail_csv' AS source_system
FROM (SELECT *, CAST(split_part(transaction_id, '-', 2) AS INT) AS line FROM feed)""",
    "bronze_ingest_products": """SELECT CAST(p_partkey AS VARCHAR) AS product_id, upper(p_name) AS product_name, p_type AS category,
  lower(p_brand) AS brand, CAST(CAST(CASE WHEN p_size = 1 THEN 0 ELSE p_retailprice END AS DECIMAL(10,2)) AS VARCHAR) AS unit_price,
  'USD' AS currency, 'us_retail_csv' AS source_system FROM part""",
    "bronze_ingest_stores": """SELECT CAST(s_suppkey AS VARCHAR) AS store_id, upper(s_name) AS store_name,
  CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS state, lower(n_name) AS country, lower(r_name) AS region,
  'us_retail_csv' AS source_system
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    # The streamed results equal the batch ones, so they share the SQL.
    "taxi_bronze_stream": trip_inputs.ORACLE["taxi_bronze"],
    "taxi_flagged_stream": trip_inputs.ORACLE["taxi_flagged"],
    "taxi_counted_stream": """WITH trips AS (
  SELECT least(date_diff('day', DATE '2024-01-01', ts::DATE) // 6, 4) AS batch, CAST(json_extract_string(props, '$.k') AS DECIMAL(10,2)) AS trip_distance FROM events)
SELECT batch::BIGINT AS batch, 'valid_distance' AS rule, count(*) FILTER (trip_distance > 0) AS kept,
  count(*) FILTER (trip_distance IS NULL OR trip_distance <= 0) AS dropped, count(*) FILTER (trip_distance > 0) AS written FROM trips GROUP BY batch""",
    "events_once_stream": """WITH dated AS (
  SELECT *, date_diff('day', DATE '2024-01-01', ts::DATE) % 6 AS d, least(date_diff('day', DATE '2024-01-01', ts::DATE) // 6, 4) AS turn FROM events),
marked AS (SELECT *, (d = 5 AND event_id % 10 = 3) OR (d = 3 AND event_id % 10 = 7) AS held FROM dated),
delivered AS (
  SELECT *, turn AS delivery FROM marked WHERE NOT held
  UNION ALL SELECT *, turn + 1 FROM marked WHERE (held OR d = 5) AND turn < 4),
marks AS (SELECT x.n AS delivery, max(ts) - INTERVAL 1 DAY AS mark FROM delivered, (SELECT unnest([1, 2, 3, 4]) AS n) x WHERE delivery < x.n GROUP BY x.n)
SELECT DISTINCT event_id, ts, user_id, event_type, value FROM delivered LEFT JOIN marks USING (delivery) WHERE mark IS NULL OR ts > mark""",
    "scd1_stream": retail_inputs.ORACLE["scd1_sales"],
    # Tables that follow their changes equal those built from all rows.
    "gold_incremental_daily": retail_inputs.ORACLE["gold_daily_sales"],
    "gold_incremental_monthly": retail_inputs.ORACLE["gold_monthly_region"],
    "gold_incremental_products": retail_inputs.ORACLE["gold_product_perf"],
    "quarantine_stream": retail_inputs.ORACLE["sales_quarantine"],
}
