"""The versioned order table over orders.

All queries read one table whose versions follow the same script: write, status
update, append with new columns, cancellation, deletion, clustering. It is
written once per session and input folder, in the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import VersionedTable
from ..plans import lake as p
from ..session import scratch_dir
from ..sources import table

WRITTEN, UPDATED, APPENDED, CANCELLED, DELETED, CLUSTERED = range(6)
PARTITIONS = ("country", "order_month")
_tables: dict[tuple[str, str], VersionedTable] = {}


def raw_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as text rows: five countries, some amounts and one status missing.

    The given tables hold about one order per country and day, so partitions go
    by month; a partition then holds rows worth a file.
    """
    o = table(spark, d, "orders")
    country = (F.when(F.col("o_orderpriority") == "1-URGENT", "US").when(F.col("o_orderpriority") == "2-HIGH", "UK")
               .when(F.col("o_orderpriority") == "3-MEDIUM", "AU").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "IN")
               .otherwise("DE"))
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        F.date_format("o_orderdate", "dd-MM-yyyy HH:mm").alias("order_timestamp"),
        F.col("o_custkey").alias("customer_id"), country.alias("country"),
        F.when(F.col("o_totalprice") < 490000, F.col("o_totalprice") / 500).alias("amount"),
        F.lit("USD").alias("currency"),
        F.when(F.col("o_orderstatus") == "O", "CREATED").when(F.col("o_orderstatus") == "F", "COMPLETED").alias("status"))


def typed_orders(spark, d):
    orders = p.typed_orders(raw_orders(spark, d))
    return orders.withColumns({"order_timestamp": F.col("order_timestamp").cast("timestamp_ntz"), "order_month": F.trunc("order_date", "month")})


_SCRIPT = {
    WRITTEN: lambda t, orders: t.create(orders),
    UPDATED: lambda t, orders: t.update(*p.start_processing("AU")),
    APPENDED: lambda t, orders: t.append(p.with_payment_columns(orders)),
    CANCELLED: lambda t, orders: t.update(*p.cancel_large(900)),
    DELETED: lambda t, orders: t.delete(*p.delete_small(100)),
    CLUSTERED: lambda t, orders: t.cluster("customer_id"),
}


def orders_at(spark: SparkSession, d: str, version: int) -> VersionedTable:
    """The table, brought up to at least the given version."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _tables:
        _tables[key] = VersionedTable(spark, scratch_dir(spark, "orders"), PARTITIONS)
        _SCRIPT[WRITTEN](_tables[key], typed_orders(spark, d))
    stored = _tables[key]
    for step in range(stored.latest_version() + 1, version + 1):
        _SCRIPT[step](stored, typed_orders(spark, d))
    return stored


def _version(number: int):
    return lambda s, d: orders_at(s, d, number).read(number)


def layout(spark, d):
    """Per country: rows, whether clustering left fewer files than the append, and whether files hold
    disjoint customer ranges."""
    stored = orders_at(spark, d, CLUSTERED)
    files = stored.read(CLUSTERED, with_files=True).groupBy(*PARTITIONS, "file_path").agg(
        F.min("customer_id").alias("lo"), F.max("customer_id").alias("hi"), F.count(F.lit(1)).alias("rows"))
    # In customer order a file may share only the boundary customer with those before it.
    earlier = Window.partitionBy(*PARTITIONS).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    after = files.withColumn("reached", F.max("hi").over(earlier)).groupBy("country").agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"), F.count_if(F.col("reached") > F.col("lo")).alias("crossing"))
    before = stored.detail(APPENDED).groupBy("country").agg(F.sum("files").alias("files_before"))
    return after.join(before, "country").select(
        "country", "rows", (F.col("files") < F.col("files_before")).alias("fewer_files"),
        (F.col("crossing") == 0).alias("disjoint_ranges"))


QUERIES = {
    "lake_partitioned": _version(WRITTEN),
    "lake_prune_one": lambda s, d: p.of_country(orders_at(s, d, WRITTEN).read(WRITTEN), "UK"),
    "lake_prune_two": lambda s, d: p.of_country_and_day(
        orders_at(s, d, WRITTEN).read(WRITTEN).where(F.col("order_month") == F.lit("1998-07-01").cast("date")), "AU", "1998-07-07"),
    "lake_partitions": lambda s, d: orders_at(s, d, WRITTEN).partitions(WRITTEN),
    "lake_update_status": _version(UPDATED),
    "lake_time_travel": lambda s, d: orders_at(s, d, CANCELLED).read(UPDATED),
    "lake_schema_evolution": _version(APPENDED),
    "lake_update_cancel": _version(CANCELLED),
    "lake_delete": _version(DELETED),
    "lake_layout": layout,
}

# SQL ---------------------------------------------------------------------------

_LAKE = """WITH base AS (
  SELECT o_orderkey AS order_id, o_orderdate::TIMESTAMP AS order_timestamp, o_custkey AS customer_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'US' WHEN '2-HIGH' THEN 'UK' WHEN '3-MEDIUM' THEN 'AU'
      WHEN '4-NOT SPECIFIED' THEN 'IN' ELSE 'DE' END AS country,
    CASE WHEN o_totalprice < 490000 THEN o_totalprice / 500 END AS amount, 'USD' AS currency,
    CASE o_orderstatus WHEN 'O' THEN 'CREATED' WHEN 'F' THEN 'COMPLETED' END AS status,
    CAST(o_orderdate AS DATE) AS order_date, CAST(date_trunc('month', o_orderdate) AS DATE) AS order_month
  FROM orders),
v1 AS (SELECT * REPLACE (CASE WHEN status = 'CREATED' AND country = 'AU' THEN 'PROCESSING' ELSE status END AS status) FROM base),
v2 AS (SELECT *, CAST(NULL AS VARCHAR) AS payment_method, CAST(NULL AS VARCHAR) AS coupon_code FROM v1
  UNION ALL SELECT *, 'CARD', NULL FROM base),
v3 AS (SELECT * REPLACE (CASE WHEN amount > 900 THEN 'CANCELLED' ELSE status END AS status) FROM v2),
v4 AS (SELECT * FROM v3 WHERE NOT coalesce(amount < 100, FALSE))
"""

ORACLE = {
    "lake_partitioned": _LAKE + "SELECT * FROM base",
    "lake_prune_one": _LAKE + "SELECT * FROM base WHERE country = 'UK'",
    "lake_prune_two": _LAKE + "SELECT * FROM base WHERE country = 'AU' AND order_date = DATE '1998-07-07'",
    "lake_partitions": _LAKE + "SELECT country, order_month, count(*) AS rows FROM base GROUP BY ALL",
    "lake_update_status": _LAKE + "SELECT * FROM v1",
    "lake_time_travel": _LAKE + "SELECT * FROM v1",
    "lake_schema_evolution": _LAKE + "SELECT * FROM v2",
    "lake_update_cancel": _LAKE + "SELECT * FROM v3",
    "lake_delete": _LAKE + "SELECT * FROM v4",
    "lake_layout": _LAKE + """SELECT country, count(*) AS rows, TRUE AS fewer_files, TRUE AS disjoint_ranges
FROM v4 GROUP BY country""",
}
