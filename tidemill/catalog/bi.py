"""Star schema over lineitem (facts), part, customer and supplier/nation/region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import bi as b
from ..sources import table


def facts(spark: SparkSession, d: str) -> DataFrame:
    """A sale per line: amount after discount, profit over four fifths of the list price."""
    li = table(spark, d, "lineitem")
    price, off = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)")
    return li.select(
        F.to_date("l_shipdate").alias("date"), F.col("l_partkey").alias("product_key"),
        F.col("l_suppkey").alias("region_key"), F.col("l_orderkey").alias("order_key"),
        (price * (1 - off)).cast("decimal(18,4)").alias("sales_amount"),
        (price * (F.lit("0.20").cast("decimal(3,2)") - off)).cast("decimal(18,4)").alias("profit"),
        F.col("l_quantity").cast("bigint").alias("quantity"))


def order_segments(spark, d):
    """Customer segment of each order, so that the facts are joined once, on the order."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("customer_key"))
    return orders.join(customers(spark, d), "customer_key", "left").select("order_key", "segment")


def products(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("product_key"), F.concat_ws(" ", "p_brand", "p_name").alias("product"),
        F.col("p_type").alias("category"))


def customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("customer_key"), F.col("c_mktsegment").alias("segment"))


def regions(spark, d):
    """Region of each selling point."""
    named = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "supplier").join(named, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("region_key"), F.col("r_name").alias("region"))


def targets(spark, d):
    """Five percent above the year before, per category; the first year has no target."""
    by_year = b.by_product_year(facts(spark, d)).join(products(spark, d).select("product_key", "category"), "product_key")
    years = by_year.groupBy("year", "category").agg(F.sum("total_sales").alias("sales"))
    raised = years.select((F.col("year") + 1).alias("year"), "category",
                          (F.col("sales") * F.lit("1.05").cast("decimal(3,2)")).cast("decimal(38,4)").alias("target"))
    return years.select("year", "category").join(raised, ["year", "category"], "left")


def _growth(spark, d):
    return b.yoy(facts(spark, d)).withColumn("yoy_growth", F.round("yoy_growth", 6))


def _status(spark, d):
    found = b.target_status(facts(spark, d), products(spark, d), targets(spark, d))
    return found.withColumn("attainment", F.round("attainment", 6))


QUERIES = {
    "bi_totals": lambda s, d: b.totals(facts(s, d)),
    "bi_star": lambda s, d: b.star(facts(s, d), products(s, d), order_segments(s, d), regions(s, d), "order_key"),
    "bi_filtered_sales": lambda s, d: b.filtered_sales(
        facts(s, d), products(s, d), regions(s, d), year=1998, region="ASIA", category="PROMO"),
    "bi_category_matrix": lambda s, d: b.category_matrix(facts(s, d), products(s, d)),
    "bi_sales_trend": lambda s, d: b.sales_trend(facts(s, d), regions(s, d)),
    "bi_sales_ytd": lambda s, d: b.sales_ytd(facts(s, d)),
    "bi_sales_ly": lambda s, d: b.sales_ly(facts(s, d)),
    "bi_yoy": _growth,
    "bi_top_products": lambda s, d: b.top_products(facts(s, d), products(s, d)),
    "bi_trend_fit": lambda s, d: b.trend_fit(facts(s, d)),
    "bi_target_status": _status,
}

_FACTS = """WITH facts AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_partkey AS product_key, l_suppkey AS region_key, l_orderkey AS order_key,
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS sales_amount,
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (0.20 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS profit,
    CAST(l_quantity AS BIGINT) AS quantity FROM lineitem),
products AS (SELECT p_partkey AS product_key, p_brand || ' ' || p_name AS product, p_type AS category FROM part),
regions AS (SELECT s_suppkey AS region_key, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
daily AS (SELECT date, CAST(sum(sales_amount) AS DECIMAL(38,4)) AS total_sales FROM facts GROUP BY date),
spine AS (SELECT CAST(unnest(generate_series(date_trunc('year', (SELECT min(date) FROM daily)),
  date_trunc('year', (SELECT max(date) FROM daily)) + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date),
monthly AS (SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
  CAST(sum(sales_amount) AS DECIMAL(38,4)) AS total_sales, sum(profit) AS total_profit FROM facts GROUP BY 1, 2),
yearly AS (SELECT CAST(year(date) AS INTEGER) AS year, category, CAST(sum(sales_amount) AS DECIMAL(38,4)) AS sales
  FROM facts JOIN products USING (product_key) GROUP BY 1, 2)
"""
_SUMS = """CAST(sum(sales_amount) AS DECIMAL(38,4)) AS total_sales, CAST(sum(profit) AS DECIMAL(38,4)) AS total_profit,
  CAST(sum(quantity) AS BIGINT) AS total_quantity"""
_YEAR = "CAST(year(date) AS INTEGER) AS year"

ORACLE = {
    "bi_totals": _FACTS + f"SELECT {_SUMS} FROM facts",
    "bi_star": _FACTS + f"""SELECT {_YEAR}, category, c_mktsegment AS segment, region, {_SUMS}
FROM facts JOIN orders ON o_orderkey = order_key LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN products USING (product_key) LEFT JOIN regions USING (region_key) GROUP BY ALL""",
    "bi_filtered_sales": _FACTS + f"""SELECT {_YEAR}, CAST(month(date) AS INTEGER) AS month, region, category, {_SUMS}
FROM facts JOIN products USING (product_key) JOIN regions USING (region_key)
WHERE year(date) = 1998 AND region = 'ASIA' AND category = 'PROMO' GROUP BY ALL""",
    "bi_category_matrix": _FACTS + f"""SELECT category, product, CAST(GROUPING(category, product) AS INTEGER) AS level, {_SUMS}
FROM facts LEFT JOIN products USING (product_key) GROUP BY ROLLUP (category, product)""",
    "bi_sales_trend": _FACTS + f"""SELECT {_YEAR}, CAST(month(date) AS INTEGER) AS month, region, {_SUMS}
FROM facts JOIN regions USING (region_key) GROUP BY ALL""",
    "bi_sales_ytd": _FACTS + """SELECT date, total_sales, CAST(sum(total_sales) OVER (PARTITION BY year(date) ORDER BY date
  ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,4)) AS sales_ytd FROM spine LEFT JOIN daily USING (date)""",
    "bi_sales_ly": _FACTS + """SELECT spine.date, daily.total_sales, ly.total_sales AS sales_ly FROM spine
LEFT JOIN daily ON daily.date = spine.date LEFT JOIN daily ly ON ly.date = CAST(spine.date - INTERVAL 12 MONTH AS DATE)""",
    "bi_yoy": _FACTS + """, months AS (
  SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month
  FROM (SELECT unnest(generate_series((SELECT min(year) FROM monthly), (SELECT max(year) FROM monthly))) AS y),
    (SELECT unnest(generate_series(1, 12)) AS m))
SELECT months.year, months.month, a.total_sales, b.total_sales AS sales_ly,
  round(CAST(coalesce(a.total_sales, 0) - b.total_sales AS DOUBLE) / nullif(CAST(b.total_sales AS DOUBLE), 0), 6) AS yoy_growth
FROM months LEFT JOIN monthly a ON a.year = months.year AND a.month = months.month
LEFT JOIN monthly b ON b.year = months.year - 1 AND b.month = months.month""",
    "bi_top_products": _FACTS + """, sold AS (
  SELECT category, product_key, product, CAST(sum(sales_amount) AS DECIMAL(38,4)) AS total_sales
  FROM facts JOIN products USING (product_key) GROUP BY ALL)
SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY total_sales DESC, product_key) AS INTEGER) AS place,
  product_key, product, total_sales FROM sold QUALIFY place <= 5""",
    "bi_trend_fit": _FACTS + """, points AS (SELECT CAST(year * 12 + month - 1 AS DOUBLE) AS x, CAST(total_sales AS DOUBLE) AS y,
  CAST(total_profit AS DOUBLE) AS p FROM monthly)
SELECT count(*) AS months, round(regr_slope(y, x), 2) AS sales_slope, round(regr_intercept(y, x), 0) AS sales_intercept,
  round(regr_slope(p, x), 2) AS profit_slope, round(regr_intercept(p, x), 0) AS profit_intercept FROM points""",
    "bi_target_status": _FACTS + """, judged AS (
  SELECT a.year, a.category, CAST(b.sales * 1.05 AS DECIMAL(38,4)) AS target, a.sales AS actual,
    CAST(a.sales AS DOUBLE) / nullif(CAST(CAST(b.sales * 1.05 AS DECIMAL(38,4)) AS DOUBLE), 0) AS met
  FROM yearly a LEFT JOIN yearly b ON b.year = a.year - 1 AND b.category = a.category)
SELECT year, category, target, actual, round(met, 6) AS attainment,
  CASE WHEN target IS NULL THEN 'NO_TARGET' WHEN met >= 1 THEN 'ON_TARGET' WHEN met >= 0.9 THEN 'NEAR' ELSE 'MISSED' END AS status
FROM judged""",
}
