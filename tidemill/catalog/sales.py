"""Till sales over lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import as_timestamp
from ..operators import describe_dates, describe_exact
from ..plans import sales as p
from ..sources import table


def till_sales(spark: SparkSession, d: str) -> DataFrame:
    """One sale per line; a third of the sales has no promotion, untaxed ones no customer."""
    li = table(spark, d, "lineitem")
    promo = F.when(F.col("l_returnflag") == "A", "DISC10").when(F.col("l_returnflag") == "R", "DISC5")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
        F.col("l_suppkey").alias("store_id"), F.concat(F.lit("Store "), F.col("l_suppkey")).alias("store_name"),
        F.to_date("l_shipdate").alias("date"), F.col("l_partkey").alias("product_id"),
        F.concat(F.lit("Product "), F.col("l_partkey")).alias("product_name"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("unit_price"),
        (F.col("l_extendedprice") * 1).cast("decimal(12,2)").alias("total"),
        F.when(F.col("l_tax") != 0, F.col("l_orderkey")).alias("customer_id"), promo.alias("promo_code"))


def delivered_twice(spark, d):
    """The whole feed and a second delivery of it."""
    feed = till_sales(spark, d)
    return feed.unionByName(feed)


PROFILED = ["transaction_id", "store_id", "product_id", "quantity", "total", "customer_id"]


def described(spark, d):
    stats = describe_exact(till_sales(spark, d), PROFILED)
    return stats.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


def described_dates(spark, d):
    """Dates of all sales, and times of the sales with a customer."""
    sales = till_sales(spark, d)
    return describe_dates(sales.select("date", F.when(F.col("customer_id").isNotNull(), F.col("date")).alias("customer_date")), ["date", "customer_date"])


def parsed_times(spark, d):
    """Both ways of reading a time: day-first pattern and default form, with unreadable values."""
    o = table(spark, d, "orders")
    day_first = F.when(F.col("o_orderpriority") == "5-LOW", "31-02-1999 10:00").otherwise(
        F.date_format("o_orderdate", "dd-MM-yyyy HH:mm"))
    default = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return o.select(
        "o_orderkey", F.to_date(as_timestamp(day_first, pattern="dd-MM-yyyy HH:mm")).alias("day_first"),
        F.to_date(as_timestamp(default)).alias("by_default"))


def store_stats(spark, d):
    return p.store_statistics(till_sales(spark, d)).withColumn("std_total", F.round("std_total", 4))


QUERIES = {
    "sales_subset": lambda s, d: p.subset(till_sales(s, d)),
    "sales_date_range": lambda s, d: p.in_date_range(till_sales(s, d), "1997-10-01", "1997-10-10"),
    "sales_effective_price": lambda s, d: p.with_effective_price(till_sales(s, d)),
    "sales_high_value": lambda s, d: p.high_value(till_sales(s, d), 10000),
    "sales_by_store": lambda s, d: p.revenue_by_store(till_sales(s, d)),
    "sales_store_stats": store_stats,
    "sales_basket": lambda s, d: p.average_basket(till_sales(s, d)),
    "sales_describe": described,
    "sales_describe_dates": described_dates,
    "sales_fillna": lambda s, d: p.fill_missing(till_sales(s, d)),
    "sales_dedup": lambda s, d: p.deduplicate(delivered_twice(s, d)),
    "etl_sales": lambda s, d: p.transform(delivered_twice(s, d)),
    "parse_timestamps": parsed_times,
}

_SALES = """WITH sales AS (
  SELECT l_orderkey * 10 + l_linenumber AS transaction_id, l_suppkey AS store_id, 'Store ' || l_suppkey AS store_name,
    CAST(l_shipdate AS DATE) AS date, l_partkey AS product_id, 'Product ' || l_partkey AS product_name,
    CAST(l_quantity AS INTEGER) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_price,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS total, CASE WHEN l_tax <> 0 THEN l_orderkey END AS customer_id,
    CASE l_returnflag WHEN 'A' THEN 'DISC10' WHEN 'R' THEN 'DISC5' END AS promo_code
  FROM lineitem),
priced AS (
  SELECT *, CAST(CASE promo_code WHEN 'DISC10' THEN 0.10 WHEN 'DISC5' THEN 0.05 ELSE 0 END AS DECIMAL(5,4)) AS discount,
    CAST(total * (1 - CASE promo_code WHEN 'DISC10' THEN 0.10 WHEN 'DISC5' THEN 0.05 ELSE 0.00 END) AS DECIMAL(18,6)) AS effective_price
  FROM sales)
"""
_FILLED = """SELECT * REPLACE (coalesce(promo_code, 'NONE') AS promo_code, coalesce(customer_id, 0) AS customer_id) FROM """


def _described(c: str) -> str:
    v = f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS std,
  min({v}) AS min, quantile_cont({v}, 0.25) AS p25, quantile_cont({v}, 0.5) AS p50, quantile_cont({v}, 0.75) AS p75,
  max({v}) AS max FROM sales"""


def _described_date(name: str, c: str) -> str:
    v, at = f"CAST(date_diff('day', DATE '1970-01-01', {c}) AS DOUBLE)", "make_timestamp(CAST(round({} * 86400) AS BIGINT) * 1000000)"
    quartiles = ", ".join(at.format(f"quantile_cont({v}, {q / 100})") + f" AS p{q}" for q in (25, 50, 75))
    return f"""SELECT '{name}' AS "column", count({c}) AS count, {at.format(f"avg({v})")} AS mean, {at.format(f"min({v})")} AS min, {quartiles},
  {at.format(f"max({v})")} AS max FROM sales"""


ORACLE = {
    "sales_describe_dates": _SALES + _described_date("date", "date") + " UNION ALL " + _described_date(
        "customer_date", "CASE WHEN customer_id IS NOT NULL THEN date END"),
    "sales_subset": _SALES + "SELECT transaction_id, date, total FROM sales",
    "sales_date_range": _SALES + "SELECT * FROM sales WHERE date >= DATE '1997-10-01' AND date <= DATE '1997-10-10'",
    "sales_effective_price": _SALES + "SELECT * FROM priced",
    "sales_high_value": _SALES + "SELECT * FROM priced WHERE effective_price >= 10000",
    "sales_by_store": _SALES + """SELECT store_id, CAST(sum(effective_price) AS DECIMAL(38,4)) AS effective_price
FROM priced GROUP BY store_id""",
    "sales_store_stats": _SALES + """SELECT store_id, CAST(sum(total) AS DOUBLE) / count(total) AS mean_total,
  round(stddev_samp(CAST(total AS DOUBLE)), 4) AS std_total FROM sales GROUP BY store_id""",
    "sales_basket": _SALES + "SELECT CAST(sum(total) AS DOUBLE) / count(total) AS average_basket FROM sales",
    "sales_describe": _SALES + " UNION ALL ".join(_described(c) for c in PROFILED),
    "sales_fillna": _SALES + _FILLED + "sales",
    "sales_dedup": _SALES + "SELECT DISTINCT * FROM sales",
    "etl_sales": _SALES + f"SELECT DISTINCT * FROM ({_FILLED} priced)",
    "parse_timestamps": """SELECT o_orderkey,
  CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) END AS day_first,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS by_default FROM orders""",
}
