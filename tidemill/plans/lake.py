"""A partitioned, versioned order table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import as_timestamp
from ..operators.versioned import VersionedTable

PARTITIONS = ("country", "order_date")
TIME_PATTERN = "dd-MM-yyyy HH:mm"


def typed_orders(raw: DataFrame) -> DataFrame:
    """Parse the day-first timestamp and derive the date; an impossible one becomes null."""
    dtype = raw.schema["order_timestamp"].dataType
    parsed = raw.withColumn("order_timestamp", as_timestamp(F.col("order_timestamp"), dtype, TIME_PATTERN))
    return parsed.withColumn("order_date", F.to_date("order_timestamp"))


def orders_table(spark: SparkSession, root: str) -> VersionedTable:
    return VersionedTable(spark, root, PARTITIONS)


def of_country(orders: DataFrame, country: str) -> DataFrame:
    return orders.where(F.col("country") == country)


def of_country_and_day(orders: DataFrame, country: str, day: str) -> DataFrame:
    return orders.where((F.col("country") == country) & (F.col("order_date") == F.lit(day).cast("date")))


def start_processing(country: str = "AU") -> tuple[Column, dict[str, Column], str]:
    """Predicate, new values and label of the status update for one country."""
    where = (F.col("status") == "CREATED") & (F.col("country") == country)
    return where, {"status": F.lit("PROCESSING")}, f"status = 'CREATED' AND country = '{country}'"


def cancel_large(amount: int = 900) -> tuple[Column, dict[str, Column], str]:
    return F.col("amount") > amount, {"status": F.lit("CANCELLED")}, f"amount > {amount}"


def delete_small(amount: int = 100) -> tuple[Column, str]:
    return F.col("amount") < amount, f"amount < {amount}"


def with_payment_columns(orders: DataFrame) -> DataFrame:
    """The evolved shape: a constant payment method and a coupon that is still unknown."""
    return orders.withColumns({"payment_method": F.lit("CARD"), "coupon_code": F.lit(None).cast("string")})


def describe(df: DataFrame) -> DataFrame:
    """Column names, types and positions as rows."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string")
