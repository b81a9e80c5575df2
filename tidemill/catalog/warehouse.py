"""Warehouse load over customer/orders/nation, part and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import KeyedTable
from ..plans import warehouse as w
from ..session import scratch_dir, stored
from ..sources import process_dates, table

# The warehouse as of this day is the target; what happened from it on is the batch.
CUT = "1998-06-01"
LOADED, NOW = "1998-05-31", "1998-06-02"
#: Facts below which a day counts as low: at 0.01 about the mean, so that both branches occur.
FEW = 6


def _at(day: str):
    return F.lit(day).cast("date").cast("timestamp_ntz")


def customer_activity(spark: SparkSession, d: str) -> DataFrame:
    """Customers with country and the dates of their first and last order."""
    active = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"))
    customers = table(spark, d, "customer").join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return customers.join(active, "c_custkey", "left")


def customer_file(customers: DataFrame, domain: str = "example.com") -> DataFrame:
    """All-text rows; the machinery segment has no readable signup date."""
    signup = F.when(F.col("c_mktsegment") == "MACHINERY", "unknown").otherwise(
        F.date_format("first_order", "yyyy-MM-dd"))
    return customers.select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.substring_index("c_name", "#", 1).alias("first_name"), F.substring_index("c_name", "#", -1).alias("last_name"),
        F.concat(F.lower("c_name"), F.lit("@" + domain)).alias("email"), signup.alias("signup_date"),
        F.col("n_name").alias("country"))


def product_file(spark: SparkSession, d: str, rise: float = 0.0) -> DataFrame:
    """All-text products; the smallest size has no readable price."""
    p = table(spark, d, "part")
    price = F.when(F.col("p_size") == 1, "n/a").otherwise((F.col("p_retailprice") + rise).cast("string"))
    return p.select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("product_name"),
                    F.col("p_type").alias("category"), price.alias("unit_price"))


def order_file(spark: SparkSession, d: str, *also) -> DataFrame:
    """All-text order rows, several per order, with blank, odd and missing values."""
    li = table(spark, d, "lineitem")
    flags = F.concat("l_returnflag", "l_linestatus")
    quantity = (F.when(F.col("l_tax") == 0.08, "abc").when(F.col("l_discount") == 0.1, "-1")
                .otherwise((F.col("l_quantity") / 2).cast("string")))
    currency = (F.when(flags == "AF", "").when(flags == "AO", "usd").when(flags == "NF", "EUR")
                .when(flags == "RF", "USD").when(flags == "RO", "INR"))
    stamp = F.when(F.col("l_tax") == 0.04, "not a time").otherwise(
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return li.select(
        F.col("l_orderkey").cast("string").alias("order_id"), stamp.alias("order_timestamp"),
        F.when(F.col("l_tax") != 0.01, F.col("l_suppkey").cast("string")).alias("customer_id"),
        F.when(F.col("l_discount") != 0.01, F.col("l_partkey").cast("string")).alias("product_id"),
        quantity.alias("quantity"), F.col("l_extendedprice").cast("string").alias("total_amount"),
        currency.alias("currency"), F.col("l_linestatus").alias("status"), "l_shipdate", *also)


def staged_orders(spark, d):
    return w.stage_orders(order_file(spark, d).drop("l_shipdate"))


def _utc(df: DataFrame) -> DataFrame:
    """Instants as UTC wall-clock time, the type of the given tables."""
    return df.select(*[
        F.to_timestamp_ntz(F.date_format(f.name, "yyyy-MM-dd HH:mm:ss")).alias(f.name)
        if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema.fields])


def upserted_customers(spark, d):
    known = customer_activity(spark, d)
    before = known.where((F.col("first_order") < _at(CUT)) | F.col("first_order").isNull())
    after = known.where(F.col("last_order") >= _at(CUT))
    dim = w.stage_customers(customer_file(before)).withColumn("created_at", _at(LOADED))
    return w.upsert_customers(dim, w.stage_customers(customer_file(after, "example.org")), _at(NOW))


def upserted_products(spark, d):
    shipped = table(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("product_id")).agg(
        F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    late = shipped.where(F.col("first") >= _at("1995-03-01")).select("product_id")
    after = shipped.where(F.col("last") >= _at("1995-03-01")).select("product_id")
    old = w.product_rows(w.stage_products(product_file(spark, d).join(late, "product_id", "left_anti")))
    new = w.stage_products(product_file(spark, d, 1.0).join(after, "product_id", "left_semi"))
    return w.upsert_products(old.withColumn("created_at", _at(LOADED)), new, _at(NOW))


def upserted_orders(spark, d):
    rows = order_file(spark, d)
    before = w.stage_orders(rows.where(F.col("l_shipdate") < _at(CUT)).drop("l_shipdate"))
    after = w.stage_orders(rows.where(F.col("l_shipdate") >= _at(CUT)).drop("l_shipdate"))
    fact = stored(w.fact_rows(before).withColumn("created_at", _at(LOADED)), "fact_orders")
    return _utc(w.upsert_orders(fact, after, _at(NOW)))


def _keyed(name: str, key: str, before: DataFrame, batches: list[DataFrame]) -> DataFrame:
    """The target in buckets of its key, after the batches."""
    kept = KeyedTable(before.sparkSession, scratch_dir(before.sparkSession, name), [key], buckets=8)
    kept.replace(before)
    for batch in batches:
        kept.upsert(batch, {"created_at": _at(NOW)})
    return kept.read()


def keyed_customers(spark, d):
    known = customer_activity(spark, d)
    before = known.where((F.col("first_order") < _at(CUT)) | F.col("first_order").isNull())
    after = known.where(F.col("last_order") >= _at(CUT))
    return _keyed("dim_customers", "customer_id", w.customer_rows(w.stage_customers(customer_file(before))).withColumn("created_at", _at(LOADED)),
                  [w.customer_rows(w.stage_customers(customer_file(after, "example.org")))])


def keyed_products(spark, d):
    """The new prices come in two batches, of which the second repeats some of the first."""
    shipped = table(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("product_id")).agg(
        F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    late = shipped.where(F.col("first") >= _at("1995-03-01")).select("product_id")
    after = stored(shipped.where(F.col("last") >= _at("1995-03-01")).select("product_id"), "after")
    old = w.product_rows(w.stage_products(product_file(spark, d).join(late, "product_id", "left_anti")))
    new = w.product_rows(w.stage_products(product_file(spark, d, 1.0)))
    share = F.pmod(F.xxhash64("product_id"), F.lit(3))
    return _keyed("dim_products", "product_id", old.withColumn("created_at", _at(LOADED)),
                  [new.join(after.where(part), "product_id", "left_semi") for part in (share < 2, share > 0)])


def keyed_orders(spark, d):
    rows = order_file(spark, d)
    before, after = (w.fact_rows(w.stage_orders(rows.where(part).drop("l_shipdate"))) for part in (F.col("l_shipdate") < _at(CUT), F.col("l_shipdate") >= _at(CUT)))
    return _utc(_keyed("fact_orders", "order_id", before.withColumn("created_at", _at(LOADED)), [after]))


def fact(spark, d):
    return w.fact_rows(staged_orders(spark, d))


def fact_days(spark, d):
    """Every ship date is a process date."""
    return table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("process_date")).distinct()


def daily_files(spark, d):
    """Staged order lines, each an order of its own, with the day of their file: the ship date, a day later for the seventh lines."""
    line = F.col("l_linenumber")
    rows = order_file(spark, d, line)
    late = F.date_add(F.to_date("l_shipdate"), F.when(line == 7, 1).otherwise(0))
    return w.stage_orders(rows.select(F.concat_ws("-", "order_id", line).alias("order_id"),
                                      *[c for c in rows.columns if c not in ("order_id", "l_shipdate", "l_linenumber")], late.alias("file_date")))


QUERIES = {
    "landing_by_date": lambda s, d: process_dates(
        table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct(), F.col("day")),
    "stg_customers": lambda s, d: w.stage_customers(customer_file(customer_activity(s, d))),
    "stg_products": lambda s, d: w.stage_products(product_file(s, d)),
    "stg_orders": staged_orders,
    "upsert_customers": upserted_customers,
    "upsert_products": upserted_products,
    "upsert_keyed_customers": keyed_customers,
    "upsert_keyed_products": keyed_products,
    "upsert_keyed_orders": keyed_orders,
    "fact_clean": lambda s, d: _utc(w.clean_orders(staged_orders(s, d))),
    "fact_valid": lambda s, d: _utc(w.valid_orders(w.clean_orders(staged_orders(s, d)))),
    "fact_flagged": lambda s, d: _utc(w.flag_orders(w.valid_orders(w.clean_orders(staged_orders(s, d))))),
    "fact_dedup": lambda s, d: _utc(fact(s, d)),
    "upsert_fact_orders": upserted_orders,
    "dq_row_count": lambda s, d: w.check_customers_present(w.customer_rows(
        w.stage_customers(customer_file(customer_activity(s, d))))),
    "dq_null_fks": lambda s, d: w.check_null_keys(w.clean_orders(staged_orders(s, d))).unionByName(
        w.check_null_keys(fact(s, d)).withColumn("check_name", F.lit("fact_no_null_fks_loaded"))),
    "dq_fact_match": lambda s, d: w.check_fact_match(w.fact_rows(daily_files(s, d)), daily_files(s, d), fact_days(s, d), "file_date"),
    "low_volume_flag": lambda s, d: w.volume_branch(fact(s, d), FEW, fact_days(s, d)),
}


# SQL ---------------------------------------------------------------------------

_ACTIVITY = """
active AS (SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order FROM orders GROUP BY 1),
people AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, split_part(c_name, '#', 1) AS first_name,
    split_part(c_name, '#', 2) AS last_name, lower(c_name) AS login, n_name AS country, first_order, last_order,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(first_order AS DATE) END AS signup_date
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN active ON o_custkey = c_custkey)"""

_CLEAN = """
clean AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
    CASE WHEN l_tax <> 0.04 THEN l_shipdate END AS ts_utc,
    CASE WHEN l_tax <> 0.01 THEN CAST(l_suppkey AS VARCHAR) END AS customer_id,
    CASE WHEN l_discount <> 0.01 THEN CAST(l_partkey AS VARCHAR) END AS product_id,
    CASE WHEN l_tax = 0.08 THEN NULL WHEN l_discount = 0.1 THEN -1 ELSE CAST(l_quantity / 2 AS INTEGER) END AS quantity,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS total_amount,
    CASE l_returnflag || l_linestatus WHEN 'AO' THEN 'usd' WHEN 'NF' THEN 'EUR' WHEN 'RO' THEN 'INR' ELSE 'USD' END AS currency,
    l_linestatus AS status, l_shipdate
  FROM lineitem),
valid AS (SELECT * FROM clean WHERE order_id IS NOT NULL AND customer_id IS NOT NULL AND product_id IS NOT NULL
  AND quantity >= 0 AND total_amount IS NOT NULL),
flagged AS (SELECT *, upper(currency) <> 'USD' AS currency_mismatch_flag FROM valid)"""

_NEWEST = """SELECT order_id, ts_utc AS order_timestamp, customer_id, product_id, quantity, total_amount, currency,
    currency_mismatch_flag, status
  FROM {source} QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY ts_utc DESC NULLS LAST, customer_id DESC,
    product_id DESC, quantity DESC, total_amount DESC, currency DESC NULLS LAST, status DESC,
    currency_mismatch_flag DESC NULLS LAST) = 1"""

_FACT = f"WITH {_CLEAN}, fact AS ({_NEWEST.format(source='flagged')})"
_CLEAN_COLUMNS = "order_id, ts_utc, customer_id, product_id, quantity, total_amount, currency, status"

ORACLE = {
    "landing_by_date": """SELECT run_date, strftime(run_date - INTERVAL 1 DAY, '%Y%m%d') AS file_date,
  strftime(run_date - INTERVAL 1 DAY, '%Y-%m-%d') AS iso_date,
  'customers/customers_' || file_date || '.csv' AS customers_file, 'products/products_' || file_date || '.csv' AS products_file,
  'orders/orders_' || file_date || '.json' AS orders_file
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS run_date FROM orders)""",
    "stg_customers": f"""WITH {_ACTIVITY}
SELECT customer_id, first_name, last_name, login || '@example.com' AS email, signup_date, country FROM people""",
    "stg_products": """SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name, p_type AS category,
  CASE WHEN p_size <> 1 THEN p_retailprice END AS unit_price FROM part""",
    "stg_orders": """SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
  CASE WHEN l_tax = 0.04 THEN 'not a time' ELSE strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') END AS order_timestamp,
  CASE WHEN l_tax <> 0.01 THEN CAST(l_suppkey AS VARCHAR) END AS customer_id,
  CASE WHEN l_discount <> 0.01 THEN CAST(l_partkey AS VARCHAR) END AS product_id,
  CASE WHEN l_tax = 0.08 THEN NULL WHEN l_discount = 0.1 THEN -1 ELSE l_quantity / 2 END AS quantity,
  l_extendedprice AS total_amount,
  CASE l_returnflag || l_linestatus WHEN 'AF' THEN '' WHEN 'AO' THEN 'usd' WHEN 'NF' THEN 'EUR' WHEN 'RF' THEN 'USD'
    WHEN 'RO' THEN 'INR' END AS currency, l_linestatus AS status FROM lineitem""",
    "upsert_customers": f"""WITH {_ACTIVITY}
SELECT customer_id, first_name, last_name,
  login || CASE WHEN last_order >= TIMESTAMP '{CUT}' THEN '@example.org' ELSE '@example.com' END AS email, signup_date, country,
  CASE WHEN first_order < TIMESTAMP '{CUT}' OR first_order IS NULL THEN TIMESTAMP '{LOADED}' ELSE TIMESTAMP '{NOW}' END AS created_at
FROM people""",
    "upsert_products": f"""WITH shipped AS (
  SELECT l_partkey, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY 1)
SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name, p_type AS category,
  CASE WHEN p_size <> 1 THEN CAST(p_retailprice + CASE WHEN b >= TIMESTAMP '1995-03-01' THEN 1 ELSE 0 END AS DECIMAL(18,2)) END AS unit_price,
  CASE WHEN a < TIMESTAMP '1995-03-01' OR a IS NULL THEN TIMESTAMP '{LOADED}' ELSE TIMESTAMP '{NOW}' END AS created_at
FROM part LEFT JOIN shipped ON l_partkey = p_partkey""",
    "fact_clean": f"WITH {_CLEAN} SELECT {_CLEAN_COLUMNS} FROM clean",
    "fact_valid": f"WITH {_CLEAN} SELECT {_CLEAN_COLUMNS} FROM valid",
    "fact_flagged": f"WITH {_CLEAN} SELECT {_CLEAN_COLUMNS}, currency_mismatch_flag FROM flagged",
    "fact_dedup": _FACT + " SELECT * FROM fact",
    "upsert_fact_orders": f"""WITH {_CLEAN},
early AS (SELECT * FROM flagged WHERE l_shipdate < TIMESTAMP '{CUT}'),
late AS (SELECT * FROM flagged WHERE l_shipdate >= TIMESTAMP '{CUT}'),
old AS ({_NEWEST.format(source='early')}), new AS ({_NEWEST.format(source='late')})
SELECT new.*, CASE WHEN old.order_id IS NULL THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '{LOADED}' END AS created_at
FROM new LEFT JOIN old USING (order_id)
UNION ALL SELECT old.*, TIMESTAMP '{LOADED}' FROM old WHERE order_id NOT IN (SELECT order_id FROM new)""",
    "dq_row_count": """SELECT 'dim_customers_nonzero' AS check_name, count(*) AS value, 'count==0' AS fail_condition,
  count(*) <> 0 AS passed FROM customer""",
    "dq_null_fks": _FACT + """
SELECT 'fact_no_null_fks' AS check_name, count(*) AS value, 'count>0' AS fail_condition, count(*) = 0 AS passed
FROM clean WHERE customer_id IS NULL OR product_id IS NULL
UNION ALL SELECT 'fact_no_null_fks_loaded', count(*), 'count>0', count(*) = 0
FROM fact WHERE customer_id IS NULL OR product_id IS NULL""",
    "dq_fact_match": f"""WITH {_CLEAN.replace("l_linestatus AS status, l_shipdate", "l_linestatus AS status, l_shipdate, l_linenumber")},
filed AS (SELECT CAST(l_shipdate AS DATE) + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS process_date, order_id, l_linenumber,
  max(ts_utc) AS ts FROM valid GROUP BY ALL),
facts AS (SELECT CAST(ts AS DATE) AS process_date, count(*) AS n
  FROM (SELECT max(ts) AS ts FROM filed GROUP BY order_id, l_linenumber) GROUP BY 1),
files AS (SELECT process_date, count(*) AS n, count_if(CAST(ts AS DATE) = process_date) AS same FROM filed GROUP BY 1),
days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS process_date FROM lineitem)
SELECT process_date, coalesce(facts.n, 0) AS fact, coalesce(files.n, 0) AS stg_valid,
  coalesce(files.same, 0) AS stg_valid_same_day, coalesce(facts.n, 0) = coalesce(files.n, 0) AS passed
FROM days LEFT JOIN facts USING (process_date) LEFT JOIN files USING (process_date)""",
    "low_volume_flag": _FACT + f""", days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS process_date FROM lineitem),
daily AS (SELECT CAST(order_timestamp AS DATE) AS process_date, count(*) AS n FROM fact WHERE order_timestamp IS NOT NULL GROUP BY 1)
SELECT process_date, coalesce(n, 0) AS fact, CASE WHEN coalesce(n, 0) < {FEW} THEN 'warn_low_volume' ELSE 'normal_completion' END AS branch
FROM days LEFT JOIN daily USING (process_date)""",
}

# Tables kept in buckets of their key hold the same rows.
ORACLE.update({f"upsert_keyed_{name}": ORACLE[f"upsert_{other}"] for name, other in (("customers", "customers"), ("products", "products"), ("orders", "fact_orders"))})
