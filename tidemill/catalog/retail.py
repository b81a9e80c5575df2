"""Retail layers over lineitem (sales), part (products) and supplier/nation/region (stores)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import differing_rows, key_range
from ..plans import retail as r
from ..session import scratch_dir, stored
from ..sources import table

# A line is a change of the transaction named by its order and line number; the
# newest ship date wins, then the higher price. Some fields are blanked so that
# every rejection reason and null update occurs.
SEQUENCE = ["ingestion_timestamp", "total_amount"]


def _rate(column: str, value: float):
    return F.col(column) == value


def sales_feed(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")

    def without(cents: float, value):
        both = _rate("l_tax", cents) & _rate("l_discount", cents)
        return F.when(~both, value)

    names = {"AF": "USD", "AO": "INR", "NF": "EUR", "NO": "GBP", "RF": "JPY"}
    currency = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]),
                                F.concat("l_returnflag", "l_linestatus"))
    zero_price = _rate("l_tax", 0.07) & _rate("l_discount", 0.07)
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"),
        F.col("l_shipdate").alias("transaction_timestamp"),
        without(0.05, F.col("l_suppkey")).alias("store_id"),
        without(0.03, F.col("l_partkey")).alias("product_id"),
        without(0.02, F.col("l_quantity") - 1).alias("quantity"),
        F.when(zero_price, F.lit(0.0)).otherwise(without(0.01, F.col("l_extendedprice"))).alias("unit_price"),
        F.when(F.col("l_discount") > 0, F.col("l_discount") * 100).alias("discount"),
        F.col("l_extendedprice").alias("total_amount"),
        currency.alias("currency"),
        F.col("l_shipdate").alias("ingestion_timestamp"))


def product_feed(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("product_id"), F.upper("p_name").alias("product_name"),
        F.col("p_type").alias("category"), F.lower("p_brand").alias("brand"),
        F.when(F.col("p_size") == 1, F.lit(0.0)).otherwise(F.col("p_retailprice")).alias("unit_price"),
        F.lit("USD").alias("currency"), F.lit("2024-01-01").cast("date").alias("ingestion_timestamp"))


def store_feed(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(
        F.col("s_suppkey").alias("store_id"), F.upper("s_name").alias("store_name"),
        F.lower("n_name").alias("country"), F.lower("r_name").alias("region"),
        F.lit("2024-01-01").cast("date").alias("ingestion_timestamp"))


def staged(spark, d):
    return r.stage_sales(sales_feed(spark, d))


def silver_sales(spark, d):
    return r.current_sales(staged(spark, d), SEQUENCE)


# Ids are numbers in the given tables; trimming makes them text, so they are cast back for the joins.
def _number(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(key, F.col(key).cast("long"))


def silver_products(spark, d):
    return r.current_products(_number(r.stage_products(product_feed(spark, d)), "product_id"))


def silver_stores(spark, d):
    return r.current_stores(_number(r.stage_stores(store_feed(spark, d)), "store_id"))


def gold_daily_sales(spark, d):
    return r.daily_sales(silver_sales(spark, d), silver_stores(spark, d))


def gold_monthly_region(spark, d):
    return r.monthly_revenue(silver_sales(spark, d), silver_stores(spark, d))


def gold_product_perf(spark, d):
    return r.product_performance(silver_sales(spark, d), silver_products(spark, d))


STAGED_COLUMNS = [
    "transaction_id", "transaction_timestamp", "store_id", "product_id", "quantity", "unit_price", "discount",
    "total_amount", "currency", "calculated_total", "fx_rate_to_usd", "total_amount_usd",
]


def kept_sales(spark, d):
    """The current sales as a stored table, for checks that read it more than once."""
    columns = ["transaction_id", "transaction_timestamp", "store_id", "product_id", "quantity", "total_amount_usd"]
    return stored(silver_sales(spark, d).select(columns), "silver_sales")


def reconciled(spark, d):
    return r.reconcile_in_one_pass(silver_sales(spark, d), silver_stores(spark, d), scratch_dir(spark, "daily"))


def reconciled_products(spark, d):
    """Sums per product are written once and serve both sides."""
    sums = stored(r.added_up(silver_sales(spark, d), "product_id"), "per_product")
    return r.compare_products(sums, r.products_of_added_up(sums, silver_products(spark, d)))


def differing_days(spark, d):
    """The daily table against one that has a wrong revenue for a region on the thirteenth of each month, and lacks one row: found by digests."""
    daily = r.daily_sales(silver_sales(spark, d), silver_stores(spark, d))
    right = stored(daily.hint("rebalance", "sales_date"), "daily")
    wrong = F.when((F.dayofmonth("sales_date") == 13) & (F.col("region") == "ASIA"), F.col("total_revenue_usd") + 1).otherwise(F.col("total_revenue_usd"))
    lacks = (F.col("sales_date") == F.lit("1995-06-17").cast("date")) & (F.col("region") == "EUROPE")
    other = stored(right.where(~F.coalesce(lacks, F.lit(False))).withColumn("total_revenue_usd", wrong.cast("decimal(38,2)")), "other")
    return differing_rows(right, other, {"month": "trunc(sales_date, 'month')", "day": "sales_date", "range": key_range("region", 16)})


def layer_counts(spark, d):
    sales, products, stores = kept_sales(spark, d), silver_products(spark, d), silver_stores(spark, d)
    return r.layer_counts(
        {"bronze_sales_transactions": sales_feed(spark, d), "bronze_product_master": product_feed(spark, d),
         "bronze_store_region": store_feed(spark, d)},
        {"silver_sales_transactions": sales, "silver_product_master": products, "silver_store_region": stores},
        {"gold_daily_sales_summary": r.daily_sales(sales, stores),
         "gold_monthly_revenue_by_region": r.monthly_revenue(sales, stores),
         "gold_product_performance": r.product_performance(sales, products)})


QUERIES = {
    "gold_daily_sales": gold_daily_sales,
    "gold_monthly_region": gold_monthly_region,
    "gold_product_perf": gold_product_perf,
    "silver_sales": lambda s, d: staged(s, d).select(STAGED_COLUMNS),
    "silver_sales_clean": lambda s, d: r.current_sales(r.accepted(staged(s, d)), SEQUENCE).select(STAGED_COLUMNS),
    "silver_products": lambda s, d: r.stage_products(product_feed(s, d)).drop("ingestion_timestamp"),
    "silver_stores": lambda s, d: r.stage_stores(store_feed(s, d)).drop("ingestion_timestamp"),
    "scd1_sales": lambda s, d: silver_sales(s, d).select(STAGED_COLUMNS),
    "scd1_products": lambda s, d: r.current_products(r.stage_products(_two_deliveries(s, d))).drop("ingestion_timestamp"),
    "scd1_stores": lambda s, d: r.current_stores(r.stage_stores(_two_store_deliveries(s, d))).drop("ingestion_timestamp"),
    "sales_quarantine": lambda s, d: r.quarantine(staged(s, d)).select(*STAGED_COLUMNS, "rejection_reason"),
    "quarantine_counts": lambda s, d: r.rejection_counts(r.quarantine(staged(s, d))),
    "gold_digest_diff": differing_days,
    "gold_reconcile": reconciled,
    "gold_product_reconcile": reconciled_products,
    "orphan_sales": lambda s, d: r.orphan_sales(
        kept_sales(s, d), silver_stores(s, d), silver_products(s, d)),
    "layer_counts": layer_counts,
}


def _two_deliveries(spark, d):
    """Every product twice: the second delivery changes the price and lacks the brand."""
    first = product_feed(spark, d)
    second = first.withColumns({
        "unit_price": F.col("unit_price") + 10, "brand": F.lit(None).cast("string"),
        "ingestion_timestamp": F.lit("2024-01-02").cast("date")})
    return first.unionByName(second)


def _two_store_deliveries(spark, d):
    """Every store twice: the second delivery changes the name and lacks the region."""
    first = store_feed(spark, d)
    second = first.withColumns({
        "store_name": F.concat("store_name", F.lit(" ANNEX")), "region": F.lit(None).cast("string"),
        "ingestion_timestamp": F.lit("2024-01-02").cast("date")})
    return first.unionByName(second)


# SQL ---------------------------------------------------------------------------

STAGED_SQL = """
feed AS (
  SELECT l_orderkey || '-' || l_linenumber AS transaction_id, l_shipdate AS transaction_timestamp,
    CASE WHEN l_tax = 0.05 AND l_discount = 0.05 THEN NULL ELSE l_suppkey END AS store_id,
    CASE WHEN l_tax = 0.03 AND l_discount = 0.03 THEN NULL ELSE l_partkey END AS product_id,
    CASE WHEN l_tax = 0.02 AND l_discount = 0.02 THEN NULL ELSE CAST(l_quantity AS INTEGER) - 1 END AS quantity,
    CASE WHEN l_tax = 0.07 AND l_discount = 0.07 THEN CAST(0 AS DECIMAL(10,2))
         WHEN l_tax = 0.01 AND l_discount = 0.01 THEN NULL
         ELSE CAST(l_extendedprice AS DECIMAL(10,2)) END AS unit_price,
    CAST(l_discount * 100 AS DECIMAL(10,2)) AS discount,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS total_amount,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'USD' WHEN 'AO' THEN 'INR' WHEN 'NF' THEN 'EUR'
         WHEN 'NO' THEN 'GBP' WHEN 'RF' THEN 'JPY' END AS currency,
    l_shipdate AS ingestion_timestamp
  FROM lineitem),
priced AS (
  SELECT *, CAST(quantity * unit_price - discount AS DECIMAL(22,2)) AS calculated_total,
    CAST(CASE currency WHEN 'USD' THEN 1.0 WHEN 'INR' THEN 0.012 WHEN 'EUR' THEN 1.10 WHEN 'GBP' THEN 1.25 END
         AS DECIMAL(10,4)) AS fx_rate_to_usd
  FROM feed),
staged AS (
  SELECT *, CAST(round(calculated_total * fx_rate_to_usd, 2) AS DECIMAL(24,2)) AS total_amount_usd FROM priced)
"""

_REASON = """CASE WHEN quantity <= 0 THEN 'INVALID_QUANTITY' WHEN unit_price <= 0 THEN 'INVALID_UNIT_PRICE'
    WHEN fx_rate_to_usd IS NULL THEN 'UNSUPPORTED_CURRENCY' WHEN product_id IS NULL THEN 'INVALID_PRODUCT_ID'
    WHEN store_id IS NULL THEN 'INVALID_STORE_ID' END"""

_VALUE_COLUMNS = STAGED_COLUMNS[1:]


def _newest(source: str) -> str:
    picks = ",\n    ".join(
        f"arg_max({c}, row(ingestion_timestamp, total_amount, {c})) FILTER ({c} IS NOT NULL) AS {c}"
        for c in _VALUE_COLUMNS)
    return f"SELECT transaction_id,\n    {picks}\n  FROM {source} GROUP BY transaction_id"


SILVER_SQL = STAGED_SQL + ",\nsilver AS (" + _newest("staged") + ")"

_TITLE = "array_to_string(list_transform(string_split(lower({c}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"

_PRODUCTS = f"""SELECT CAST(p_partkey AS VARCHAR) AS product_id, {_TITLE.format(c='p_name')} AS product_name,
  {_TITLE.format(c='p_type')} AS category, {_TITLE.format(c='p_brand')} AS brand,
  CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price, 'USD' AS currency
FROM part WHERE p_size <> 1"""

_STORES = f"""SELECT CAST(s_suppkey AS VARCHAR) AS store_id, {_TITLE.format(c='s_name')} AS store_name,
  upper(n_name) AS country, upper(r_name) AS region
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

_DIMS = f""",
products AS (SELECT CAST(product_id AS BIGINT) AS product_id, product_name, category, brand FROM ({_PRODUCTS})),
stores AS (SELECT CAST(store_id AS BIGINT) AS store_id, region FROM ({_STORES}))"""

_DAILY = """SELECT CAST(transaction_timestamp AS DATE) AS sales_date, region,
  CAST(count(DISTINCT transaction_id) AS BIGINT) AS total_transactions, CAST(sum(quantity) AS BIGINT) AS total_quantity,
  CAST(sum(total_amount_usd) AS DECIMAL(38,2)) AS total_revenue_usd
FROM silver JOIN stores USING (store_id) GROUP BY ALL"""

_MONTHLY = """SELECT CAST(year(transaction_timestamp) AS INTEGER) AS year, CAST(month(transaction_timestamp) AS INTEGER) AS month,
  region, CAST(sum(total_amount_usd) AS DECIMAL(38,2)) AS monthly_revenue_usd,
  CAST(count(DISTINCT transaction_id) AS BIGINT) AS transactions_count
FROM silver JOIN stores USING (store_id) GROUP BY ALL"""

_PERFORMANCE = """SELECT product_id, product_name, category, brand, CAST(sum(quantity) AS BIGINT) AS total_units_sold,
  CAST(sum(total_amount_usd) AS DECIMAL(38,2)) AS total_revenue_usd,
  CAST(count(DISTINCT transaction_id) AS BIGINT) AS transactions_count
FROM silver JOIN products USING (product_id) GROUP BY ALL"""

_GOLD = f"WITH {SILVER_SQL}{_DIMS},\ndaily AS ({_DAILY}), monthly AS ({_MONTHLY}), performance AS ({_PERFORMANCE})\n"
_COLUMNS = ", ".join(STAGED_COLUMNS)

ORACLE = {
    "gold_daily_sales": _GOLD + "SELECT * FROM daily",
    "gold_monthly_region": _GOLD + "SELECT * FROM monthly",
    "gold_product_perf": _GOLD + "SELECT * FROM performance",
    "gold_digest_diff": _GOLD + """SELECT *, -1 AS sign FROM daily
  WHERE (day(sales_date) = 13 AND region = 'ASIA' AND total_revenue_usd IS NOT NULL) OR (sales_date = DATE '1995-06-17' AND region = 'EUROPE')
UNION ALL SELECT * REPLACE (CAST(total_revenue_usd + 1 AS DECIMAL(38,2)) AS total_revenue_usd), 1 FROM daily
  WHERE day(sales_date) = 13 AND region = 'ASIA' AND total_revenue_usd IS NOT NULL""",
    "silver_sales": f"WITH {STAGED_SQL} SELECT {_COLUMNS} FROM staged",
    "silver_sales_clean": f"WITH {STAGED_SQL}, ok AS (SELECT * FROM staged WHERE {_REASON} IS NULL) " + _newest("ok"),
    "silver_products": _PRODUCTS,
    "silver_stores": _STORES,
    "scd1_sales": f"WITH {SILVER_SQL} SELECT {_COLUMNS} FROM silver",
    "scd1_products": f"""SELECT CAST(p_partkey AS VARCHAR) AS product_id, {_TITLE.format(c='p_name')} AS product_name,
  {_TITLE.format(c='p_type')} AS category,
  CASE WHEN p_size <> 1 THEN {_TITLE.format(c='p_brand')} END AS brand,
  CAST(CASE WHEN p_size = 1 THEN 10 ELSE p_retailprice + 10 END AS DECIMAL(10,2)) AS unit_price, 'USD' AS currency
FROM part""",
    "scd1_stores": f"""SELECT CAST(s_suppkey AS VARCHAR) AS store_id,
  {_TITLE.format(c='s_name')} || ' Annex' AS store_name, upper(n_name) AS country, upper(r_name) AS region
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "sales_quarantine": f"""WITH {STAGED_SQL} SELECT {_COLUMNS}, {_REASON} AS rejection_reason FROM staged
WHERE {_REASON} IS NOT NULL""",
    "quarantine_counts": f"""WITH {STAGED_SQL} SELECT 'silver' AS layer, 'silver_sales_quarantine' AS table_name,
  'rejected_' || {_REASON} AS metric_type, count(*) AS metric_value FROM staged WHERE {_REASON} IS NOT NULL GROUP BY ALL""",
    "gold_reconcile": _GOLD + """, pairs AS (
  SELECT 'revenue_usd' AS measure, (SELECT CAST(sum(total_amount_usd) AS DECIMAL(38,2)) FROM silver) AS source_value,
    (SELECT CAST(sum(total_revenue_usd) AS DECIMAL(38,2)) FROM daily) AS derived_value
  UNION ALL SELECT 'transactions', (SELECT CAST(count(DISTINCT transaction_id) AS DECIMAL(38,2)) FROM silver),
    (SELECT CAST(sum(total_transactions) AS DECIMAL(38,2)) FROM daily))
SELECT *, CAST(coalesce(source_value, 0) - coalesce(derived_value, 0) AS DECIMAL(38,2)) AS delta FROM pairs""",
    "gold_product_reconcile": _GOLD + """, per AS (
  SELECT product_id, CAST(sum(total_amount_usd) AS DECIMAL(38,2)) AS source_value FROM silver GROUP BY product_id)
SELECT coalesce(per.product_id, performance.product_id) AS product_id, source_value,
  total_revenue_usd AS derived_value,
  CAST(coalesce(source_value, 0) - coalesce(total_revenue_usd, 0) AS DECIMAL(38,2)) AS delta
FROM per FULL JOIN performance ON per.product_id = performance.product_id""",
    "orphan_sales": _GOLD + """SELECT 'store_id' AS key_column, count(*) AS orphans,
  CAST(sum(total_amount_usd) AS DECIMAL(38,2)) AS revenue_usd
FROM silver WHERE NOT EXISTS (SELECT 1 FROM stores WHERE stores.store_id = silver.store_id)
UNION ALL SELECT 'product_id', count(*), CAST(sum(total_amount_usd) AS DECIMAL(38,2))
FROM silver WHERE NOT EXISTS (SELECT 1 FROM products WHERE products.product_id = silver.product_id)""",
    "layer_counts": _GOLD + """SELECT layer, table_name, 'record_count' AS metric_type, metric_value FROM (
  SELECT 'bronze' AS layer, 'bronze_sales_transactions' AS table_name, count(*) AS metric_value FROM feed
  UNION ALL SELECT 'bronze', 'bronze_product_master', count(*) FROM part
  UNION ALL SELECT 'bronze', 'bronze_store_region', count(*) FROM supplier
  UNION ALL SELECT 'silver', 'silver_sales_transactions', count(*) FROM silver
  UNION ALL SELECT 'silver', 'silver_product_master', count(*) FROM products
  UNION ALL SELECT 'silver', 'silver_store_region', count(*) FROM stores
  UNION ALL SELECT 'gold', 'gold_daily_sales_summary', count(*) FROM daily
  UNION ALL SELECT 'gold', 'gold_monthly_revenue_by_region', count(*) FROM monthly
  UNION ALL SELECT 'gold', 'gold_product_performance', count(*) FROM performance)""",
}
