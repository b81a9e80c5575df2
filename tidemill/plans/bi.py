"""Star-schema measures.

The facts are added up on the keys of the dimensions first, so that joins see
sums and a hot key shrinks on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import safe_divide
from ..operators.calendar import date_spine, growth, running_total_by_year, same_day_last_year

MEASURES = {"sales_amount": "total_sales", "profit": "total_profit", "quantity": "total_quantity"}
_TYPES = {"sales_amount": "decimal(38,4)", "profit": "decimal(38,4)", "quantity": "bigint"}


def measures() -> list[Column]:
    """Total sales, profit and quantity."""
    return [F.sum(c).cast(_TYPES[c]).alias(name) for c, name in MEASURES.items()]


def _again() -> list[Column]:
    return [F.sum(name).cast(_TYPES[c]).alias(name) for c, name in MEASURES.items()]


def totals(facts: DataFrame) -> DataFrame:
    return facts.agg(*measures())


def star(facts: DataFrame, products: DataFrame, customers: DataFrame, regions: DataFrame,
         customer_key: str = "customer_key") -> DataFrame:
    """The three measures by year, category, customer segment and region.

    The segment is joined to the facts, as customers are too many to add up on; with
    ``customer_key`` they may be keyed by another column, such as the order. The facts are
    then added up on the keys of the other dimensions, and only sums meet those.
    A key without a dimension row keeps its facts under a null attribute.
    """
    keyed = (facts.join(customers.select(customer_key, "segment"), customer_key, "left")
             .groupBy(F.year("date").alias("year"), "segment", "product_key", "region_key").agg(*measures()))
    return (keyed.join(products.select("product_key", "category"), "product_key", "left")
            .groupBy("year", "category", "segment", "region_key").agg(*_again())
            .join(regions.select("region_key", "region"), "region_key", "left")
            .groupBy("year", "category", "segment", "region").agg(*_again()))


def by_category(facts: DataFrame, products: DataFrame) -> DataFrame:
    per_product = facts.groupBy("product_key").agg(*measures())
    return per_product.join(products, "product_key", "left")


def category_matrix(facts: DataFrame, products: DataFrame) -> DataFrame:
    """Product totals (level 0), category subtotals (level 1) and the grand total (level 3)."""
    return by_category(facts, products).rollup("category", "product").agg(
        F.grouping_id().cast("int").alias("level"), *_again())


def filtered_sales(facts: DataFrame, products: DataFrame, regions: DataFrame, year: int | None = None,
                   region: str | None = None, category: str | None = None) -> DataFrame:
    """Monthly measures under the report filters; a filter left out does not restrict."""
    if year is not None:
        first, last = F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year), F.lit(12), F.lit(31))
        facts = facts.where(F.col("date").between(first, last))
    if region is not None:
        regions = regions.where(F.col("region") == region)
    if category is not None:
        products = products.where(F.col("category") == category)
    keyed = facts.groupBy(F.year("date").alias("year"), F.month("date").alias("month"), "product_key", "region_key").agg(*measures())
    return (keyed.join(products.select("product_key", "category"), "product_key")
            .groupBy("year", "month", "region_key", "category").agg(*_again())
            .join(regions.select("region_key", "region"), "region_key")
            .groupBy("year", "month", "region", "category").agg(*_again()))


def sales_trend(facts: DataFrame, regions: DataFrame) -> DataFrame:
    """Measures per month and region."""
    by_keys = facts.groupBy(F.year("date").alias("year"), F.month("date").alias("month"), "region_key").agg(*measures())
    return (by_keys.join(regions.select("region_key", "region"), "region_key")
            .groupBy("year", "month", "region").agg(*_again()))


# Calendar measures -----------------------------------------------------------

def daily_totals(facts: DataFrame) -> DataFrame:
    return facts.groupBy("date").agg(F.sum("sales_amount").cast(_TYPES["sales_amount"]).alias("total_sales"))


def sales_ytd(facts: DataFrame) -> DataFrame:
    """Sales and year-to-date sales on every calendar day."""
    daily = daily_totals(facts)
    return running_total_by_year(date_spine(daily), daily, "total_sales", "sales_ytd").select(
        "date", "total_sales", F.col("sales_ytd").cast("decimal(38,4)").alias("sales_ytd"))


def sales_ly(facts: DataFrame) -> DataFrame:
    """Sales and the sales of the same day last year, on every calendar day."""
    daily = daily_totals(facts)
    return same_day_last_year(date_spine(daily), daily, "total_sales", "sales_ly").select("date", "total_sales", "sales_ly")


def by_product_year(facts: DataFrame) -> DataFrame:
    return facts.groupBy(F.year("date").alias("year"), "product_key").agg(
        F.sum("sales_amount").cast(_TYPES["sales_amount"]).alias("total_sales"))


def yoy(facts: DataFrame) -> DataFrame:
    """Growth of each month over the same month last year."""
    monthly = facts.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.sum("sales_amount").cast(_TYPES["sales_amount"]).alias("total_sales"))
    spine = _month_spine(monthly)
    last = monthly.select((F.col("year") + 1).alias("year"), "month", F.col("total_sales").alias("sales_ly"))
    return (spine.join(monthly, ["year", "month"], "left").join(last, ["year", "month"], "left")
            .withColumn("yoy_growth", growth(F.col("total_sales"), F.col("sales_ly"))))


def _month_spine(monthly: DataFrame) -> DataFrame:
    years = monthly.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias("year"))
    return years.select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))


def trend_fit(facts: DataFrame) -> DataFrame:
    """Straight line through the monthly totals: month 0 is January of year 0."""
    monthly = facts.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.sum("sales_amount").cast("double").alias("y"), F.sum("profit").cast("double").alias("p"))
    x = (F.col("year") * 12 + F.col("month") - 1).cast("double")
    return monthly.agg(
        F.count(F.lit(1)).alias("months"),
        F.round(F.regr_slope("y", x), 2).alias("sales_slope"), F.round(F.regr_intercept("y", x), 0).alias("sales_intercept"),
        F.round(F.regr_slope("p", x), 2).alias("profit_slope"), F.round(F.regr_intercept("p", x), 0).alias("profit_intercept"))


def top_products(facts: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    """The n best-selling products of each category; equal sales are ordered by product."""
    ranked = Window.partitionBy("category").orderBy(F.col("total_sales").desc(), F.col("product_key"))
    return (by_category(facts, products).withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= n)
            .select("category", "place", "product_key", "product", "total_sales"))


def target_status(facts: DataFrame, products: DataFrame, targets: DataFrame) -> DataFrame:
    """Sales against target per year and category: attainment and a band.

    Bands are ours: from 100 % on target, from 90 % near, below that missed.
    """
    actual = (by_product_year(facts).join(products.select("product_key", "category"), "product_key")
              .groupBy("year", "category").agg(F.sum("total_sales").cast("decimal(38,4)").alias("actual")))
    met = safe_divide(F.col("actual"), F.col("target"))
    return targets.join(actual, ["year", "category"], "left").select(
        "year", "category", "target", F.coalesce("actual", F.lit(0)).cast("decimal(38,4)").alias("actual"),
    ).withColumn("attainment", met).withColumn(
        "status", F.when(F.col("target").isNull(), "NO_TARGET").when(met >= 1, "ON_TARGET").when(met >= 0.9, "NEAR").otherwise("MISSED"))
