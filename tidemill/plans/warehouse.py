"""Daily warehouse load: staging, dimensions, fact, checks."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import (as_date, as_timestamp, blank_to, mismatched_currency, to_int_half_even, try_number)
from ..operators.checks import anomaly_records, count_check, low_volume
from ..operators.latest import latest_per_key
from ..operators.upsert import upsert
from ..operators.versioned import VersionedTable
from ..sources import json_records, landing_path, read_csv_text, write_anomalies

MIN_ORDERS = 10  # fixed value: fewer facts than this on a day is a low-volume day


# Staging ---------------------------------------------------------------------

def stage_customers(raw: DataFrame) -> DataFrame:
    return raw.withColumn("signup_date", as_date(F.col("signup_date")))


def stage_products(raw: DataFrame) -> DataFrame:
    return raw.withColumn("unit_price", try_number(F.col("unit_price")))


def stage_orders(raw: DataFrame) -> DataFrame:
    return raw.withColumns({c: try_number(F.col(c)) for c in ("quantity", "total_amount")})


def load_staging(df: DataFrame, path: str) -> int:
    """Replace a staging table; returns its row count."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).count()


# Dimensions ------------------------------------------------------------------

def customer_rows(staged: DataFrame) -> DataFrame:
    """One row per customer with a key; a repeated key is settled by the column order."""
    return latest_per_key(staged.where(F.col("customer_id").isNotNull()), ["customer_id"], [])


def product_rows(staged: DataFrame) -> DataFrame:
    priced = staged.where(F.col("product_id").isNotNull()).withColumn(
        "unit_price", F.col("unit_price").cast(schemas.MONEY))
    return latest_per_key(priced, ["product_id"], [])


def upsert_customers(dim: DataFrame, staged: DataFrame, now: Column | None = None) -> DataFrame:
    return upsert(dim, customer_rows(staged), ["customer_id"], {"created_at": _now(now)}, one_pass=True)


def upsert_products(dim: DataFrame, staged: DataFrame, now: Column | None = None) -> DataFrame:
    return upsert(dim, product_rows(staged), ["product_id"], {"created_at": _now(now)}, one_pass=True)


def _now(now: Column | None) -> Column:
    return F.current_timestamp() if now is None else now


# Fact ------------------------------------------------------------------------

def clean_orders(staged: DataFrame, *also: str) -> DataFrame:
    """Typed columns, UTC time, and USD where the currency is blank; ``also`` names columns to carry along."""
    return staged.select(
        F.col("order_id").cast("string").alias("order_id"),
        as_timestamp(F.col("order_timestamp"), staged.schema["order_timestamp"].dataType).alias("ts_utc"),
        F.col("customer_id").cast("string").alias("customer_id"),
        F.col("product_id").cast("string").alias("product_id"),
        to_int_half_even(F.col("quantity")).alias("quantity"),
        F.col("total_amount").cast(schemas.MONEY).alias("total_amount"),
        blank_to(F.col("currency"), "USD").alias("currency"), "status", *also)


def is_valid() -> Column:
    return (F.col("order_id").isNotNull() & F.col("customer_id").isNotNull() & F.col("product_id").isNotNull()
            & (F.col("quantity") >= 0) & F.col("total_amount").isNotNull())


def valid_orders(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(is_valid())


def flag_orders(valid: DataFrame) -> DataFrame:
    return valid.withColumn("currency_mismatch_flag", mismatched_currency(F.col("currency")))


def dedup_orders(flagged: DataFrame) -> DataFrame:
    """The newest row of each order, a row without a time being the oldest."""
    return latest_per_key(flagged, ["order_id"], [F.col("ts_utc").desc_nulls_last()])


def fact_rows(staged: DataFrame) -> DataFrame:
    """Staging to one fact row per order."""
    facts = dedup_orders(flag_orders(valid_orders(clean_orders(staged))))
    return facts.select("order_id", F.col("ts_utc").alias("order_timestamp"), "customer_id", "product_id",
                        "quantity", "total_amount", "currency", "currency_mismatch_flag", "status")


def upsert_orders(fact: DataFrame, staged: DataFrame, now: Column | None = None) -> DataFrame:
    return upsert(fact, fact_rows(staged), ["order_id"], {"created_at": _now(now)}, one_pass=True)


# Checks ----------------------------------------------------------------------

def check_customers_present(dim: DataFrame) -> DataFrame:
    return count_check(dim, "dim_customers_nonzero", "count==0")


def check_null_keys(fact: DataFrame) -> DataFrame:
    missing = F.col("customer_id").isNull() | F.col("product_id").isNull()
    return count_check(fact, "fact_no_null_fks", "count>0", missing)


def check_fact_match(fact: DataFrame, staged: DataFrame, days: DataFrame, file_date: str | None = None) -> DataFrame:
    """Facts of each process day against the distinct valid orders of that day's file.

    ``file_date`` names the staging column with the day of the file; without it,
    staging holds one file, which counts for every day. An order in the file
    that belongs to another day, or has no time, makes a mismatch;
    ``stg_valid_same_day`` is an extra column that tells the two apart.
    """
    facts = fact.groupBy(F.to_date("order_timestamp").alias("process_date")).agg(F.count(F.lit(1)).alias("fact"))
    also = [file_date] if file_date else []
    newest = valid_orders(clean_orders(staged, *also)).groupBy("order_id", *also).agg(F.max("ts_utc").alias("ts_utc"))
    day, zero, one = F.to_date("ts_utc"), F.lit(0).cast("long"), F.lit(1)
    if file_date:
        valid = newest.groupBy(F.col(file_date).alias("process_date")).agg(
            F.count(one).alias("stg_valid"), F.count_if(day == F.col(file_date)).alias("stg_valid_same_day"))
        whole = F.coalesce("stg_valid", zero)
    else:
        valid = newest.groupBy(day.alias("process_date")).agg(F.count(one).alias("stg_valid_same_day"))
        whole = valid.agg(F.coalesce(F.sum("stg_valid_same_day"), zero)).scalar()
    return (days.join(facts, "process_date", "left").join(valid, "process_date", "left")
            .select("process_date", F.coalesce("fact", zero).alias("fact"), whole.alias("stg_valid"),
                    F.coalesce("stg_valid_same_day", zero).alias("stg_valid_same_day"))
            .withColumn("passed", F.col("fact") == F.col("stg_valid")))


def volume_branch(fact: DataFrame, threshold: int = MIN_ORDERS, days: DataFrame | None = None) -> DataFrame:
    """Facts per process day and the branch they lead to; a day of ``days`` without facts counts zero."""
    daily = fact.where(F.col("order_timestamp").isNotNull()).groupBy(
        F.to_date("order_timestamp").alias("process_date")).agg(F.count(F.lit(1)).alias("fact"))
    if days is not None:
        daily = days.join(daily, "process_date", "left").select("process_date", F.coalesce("fact", F.lit(0).cast("long")).alias("fact"))
    return low_volume(daily, "fact", threshold)


# One day ---------------------------------------------------------------------

def run_day(spark: SparkSession, base: str, store: str, run_date: date, threshold: int = MIN_ORDERS) -> DataFrame:
    """Load one day's files into the tables under ``store``; returns the check table.

    A merge rewrites only the partitions that hold a key of the batch. Every
    step replaces its output by key, so running a day again changes
    nothing, and a backfill is a loop over dates. Failing checks are returned
    and written as anomaly records; raising is left to the caller.
    """
    day = run_date - timedelta(days=1)
    files = {feed: landing_path(base, feed, run_date) for feed in ("customers", "products", "orders")}
    staged = {
        "customers": stage_customers(read_csv_text(spark, files["customers"], schemas.CUSTOMER_FILE)),
        "products": stage_products(read_csv_text(spark, files["products"], schemas.PRODUCT_FILE)),
        "orders": stage_orders(json_records(spark, files["orders"], schemas.ORDER_FILE)),
    }
    for name, df in staged.items():
        load_staging(df, f"{store}/stg_{name}")
    staged = {n: spark.read.parquet(f"{store}/stg_{n}") for n in staged}
    now = F.current_timestamp()
    customers = _merge(spark, f"{store}/dim_customers", schemas.DIM_CUSTOMERS, "country",
                       customer_rows(staged["customers"]), "customer_id", now)
    _merge(spark, f"{store}/dim_products", schemas.DIM_PRODUCTS, "category",
           product_rows(staged["products"]), "product_id", now)
    dated = fact_rows(staged["orders"]).withColumn("order_date", F.to_date("order_timestamp"))
    shape = T.StructType(schemas.FACT_ORDERS.fields + [T.StructField("order_date", T.DateType())])
    facts = _merge(spark, f"{store}/fact_orders", shape, "order_date", dated, "order_id", now)
    days = spark.range(1).select(F.lit(day).alias("process_date"))
    match = check_fact_match(facts, staged["orders"], days)
    mismatch = match.where(~F.col("passed")).select("process_date", "fact", "stg_valid")
    write_anomalies(anomaly_records(mismatch, "dq_mismatch", "process_date"), f"{store}/anomalies")
    volume = low_volume(match.select("process_date", "fact"), "fact", threshold).where("branch = 'warn_low_volume'")
    warned = volume.select("process_date", F.lit("LOW ORDER COUNT").alias("warning"))
    write_anomalies(anomaly_records(warned, "low_volume", "process_date"), f"{store}/anomalies")
    fact_check = match.select(
        F.lit("fact_matches_staging").alias("check_name"), F.col("fact").alias("value"),
        F.lit("fact!=stg_valid").alias("fail_condition"), "passed")
    return (check_customers_present(customers)
            .unionByName(check_null_keys(facts)).unionByName(fact_check))


def _merge(spark: SparkSession, root: str, schema: T.StructType, partition: str, batch: DataFrame,
           key: str, now: Column) -> DataFrame:
    stored = VersionedTable(spark, root, [partition])
    if not stored.exists():
        stored.create(spark.createDataFrame([], schema))
    stored.merge(batch, [key], {"created_at": now})
    return stored.read()
