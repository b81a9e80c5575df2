"""Till sales: filters, statistics, cleaning and the small end-to-end job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import discount_percent, effective_price, exact_mean
from ..sources import read_csv, write_json

# What a missing promotion or customer becomes.
FILL = {"promo_code": "NONE", "customer_id": 0}


def subset(sales: DataFrame) -> DataFrame:
    return sales.select("transaction_id", "date", "total")


def in_date_range(sales: DataFrame, first: str, last: str) -> DataFrame:
    """Rows dated between two days, both included."""
    return sales.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def with_effective_price(sales: DataFrame) -> DataFrame:
    """Add the discount as a fraction and the total after it.

    The percentage is divided by 100 on every path, also in ``run``.
    """
    percent = discount_percent(F.col("promo_code"))
    return sales.withColumns({
        "discount": (percent / F.lit(100)).cast("decimal(5,4)"),
        "effective_price": effective_price(F.col("total"), percent),
    })


def high_value(sales: DataFrame, threshold: float = 10) -> DataFrame:
    return with_effective_price(sales).where(F.col("effective_price") >= threshold)


def revenue_by_store(sales: DataFrame) -> DataFrame:
    """Effective revenue per store; rows without a store are left out, an all-null store gives 0."""
    total = F.coalesce(F.sum("effective_price"), F.lit(0)).cast("decimal(38,4)")
    return (with_effective_price(sales).where(F.col("store_id").isNotNull())
            .groupBy("store_id").agg(total.alias("effective_price")))


def store_statistics(sales: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of the total per store."""
    return sales.where(F.col("store_id").isNotNull()).groupBy("store_id").agg(
        exact_mean(F.col("total")).alias("mean_total"),
        F.stddev_samp(F.col("total").cast("double")).alias("std_total"))


def average_basket(sales: DataFrame) -> DataFrame:
    return sales.agg(exact_mean(F.col("total")).alias("average_basket"))


def fill_missing(sales: DataFrame) -> DataFrame:
    return sales.fillna(FILL)


def deduplicate(sales: DataFrame) -> DataFrame:
    """Whole-row duplicates removed."""
    return sales.distinct()


def transform(sales: DataFrame) -> DataFrame:
    """Fill, type, deduplicate and price; the middle of ``run``."""
    typed = fill_missing(sales).withColumns({
        "date": F.col("date").cast("date"),
        "total": F.col("total").cast("decimal(12,2)"),
    })
    return with_effective_price(deduplicate(typed))


def run(spark, input_csv: str, output_json: str, schema=None) -> DataFrame:
    """CSV in, JSON out."""
    result = transform(read_csv(spark, input_csv, schema))
    write_json(result, output_json)
    return result
