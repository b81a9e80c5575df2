"""Retail layers: staged and current (silver) tables, quarantine, aggregates (gold), checks.

The staging functions are stateless and serve batch and streamed frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import as_timestamp, clean_name, fx_rate_to_usd, try_number
from ..operators.checks import metric_rows
from ..operators.reconcile import compare_per_key, compare_totals
from ..operators.rules import tag_rejections
from ..operators.scd1 import scd1
from ..operators.signed import signed_sums, total

SOURCE_SYSTEM = "us_retail_csv"  # fixed value stamped on every ingested row


def stamp_ingestion(feed: DataFrame) -> DataFrame:
    """Add when and from where a row came in."""
    return feed.withColumns({
        "ingestion_timestamp": F.current_timestamp(), "ingestion_date": F.current_date(),
        "source_system": F.lit(SOURCE_SYSTEM),
    })


# Staging ---------------------------------------------------------------------

def stage_sales(bronze: DataFrame) -> DataFrame:
    """Typed sales with the recalculated total and its USD value.

    A missing discount is 0 after the cast. The reported total is kept next to
    the recalculated one. A currency without a rate leaves the USD value null.
    """
    dtype = bronze.schema["transaction_timestamp"].dataType
    typed = bronze.withColumns({
        "transaction_timestamp": as_timestamp(F.col("transaction_timestamp"), dtype),
        "quantity": try_number(F.col("quantity"), "int"),
        "unit_price": try_number(F.col("unit_price"), "decimal(10,2)"),
        "discount": F.coalesce(try_number(F.col("discount"), "decimal(10,2)"), F.lit(0).cast("decimal(10,2)")),
        "total_amount": try_number(F.col("total_amount"), "decimal(12,2)"),
    })
    total = typed.withColumns({
        "calculated_total": (F.col("quantity") * F.col("unit_price") - F.col("discount")).cast("decimal(22,2)"),
        "fx_rate_to_usd": fx_rate_to_usd(F.col("currency")),
    })
    return total.withColumn(
        "total_amount_usd", F.round(F.col("calculated_total") * F.col("fx_rate_to_usd"), 2).cast("decimal(24,2)"))


def stage_products(bronze: DataFrame) -> DataFrame:
    """Cleaned products that have an id and a positive price."""
    names = {c: clean_name(F.col(c)) for c in ("product_name", "category", "brand")}
    return bronze.withColumns({
        "product_id": F.trim("product_id"), **names,
        "unit_price": try_number(F.col("unit_price"), "decimal(10,2)"),
    }).where(F.col("product_id").isNotNull() & (F.col("unit_price") > 0))


def stage_stores(bronze: DataFrame) -> DataFrame:
    """Cleaned stores that have an id."""
    return bronze.withColumns({
        "store_id": F.trim("store_id"), "store_name": clean_name(F.col("store_name")),
        "country": F.upper("country"), "region": F.upper("region"),
    }).where(F.col("store_id").isNotNull())


# Current rows ----------------------------------------------------------------

def current_sales(staged: DataFrame, sequence_by: Sequence[str] = ("ingestion_timestamp",)) -> DataFrame:
    return scd1(staged, ["transaction_id"], sequence_by, few=True)  # A transaction changes a few times.


def current_products(staged: DataFrame, sequence_by: Sequence[str] = ("ingestion_timestamp",)) -> DataFrame:
    return scd1(staged, ["product_id"], sequence_by)


def current_stores(staged: DataFrame, sequence_by: Sequence[str] = ("ingestion_timestamp",)) -> DataFrame:
    return scd1(staged, ["store_id"], sequence_by)


# Quarantine ------------------------------------------------------------------

def rejection_reasons() -> list[tuple[str, Column]]:
    """Reasons in order of priority; a null quantity or price is not a rejection."""
    return [
        ("INVALID_QUANTITY", F.col("quantity") <= 0),
        ("INVALID_UNIT_PRICE", F.col("unit_price") <= 0),
        ("UNSUPPORTED_CURRENCY", F.col("fx_rate_to_usd").isNull()),
        ("INVALID_PRODUCT_ID", F.col("product_id").isNull()),
        ("INVALID_STORE_ID", F.col("store_id").isNull()),
    ]


def quarantine(staged: DataFrame) -> DataFrame:
    """Staged sales with a rejection reason. They also stay in the current table."""
    return tag_rejections(staged, rejection_reasons()).where(F.col("rejection_reason").isNotNull())


def accepted(staged: DataFrame) -> DataFrame:
    """Staged sales without a rejection reason, for a current table free of them."""
    return tag_rejections(staged, rejection_reasons()).where(F.col("rejection_reason").isNull()).drop("rejection_reason")


def rejection_counts(quarantined: DataFrame) -> DataFrame:
    """Rows per reason in the log's shape."""
    return quarantined.groupBy("rejection_reason").agg(F.count(F.lit(1)).alias("metric_value")).select(
        F.lit("silver").alias("layer"), F.lit("silver_sales_quarantine").alias("table_name"),
        F.concat(F.lit("rejected_"), "rejection_reason").alias("metric_type"), "metric_value")


def orphan_sales(sales: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """Extra check: how many current sales and how much revenue name an unknown store or product.

    Sales are added up per id first; only those sums are matched.
    """
    def unknown(key: str, dim: DataFrame) -> DataFrame:
        per_id = sales.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("total_amount_usd").alias("usd"))
        return per_id.join(dim.select(key), key, "left_anti").agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("orphans"),
            F.sum("usd").cast("decimal(38,2)").alias("revenue_usd")).select(F.lit(key).alias("key_column"), "orphans", "revenue_usd")
    return unknown("store_id", stores).unionByName(unknown("product_id", products))


# Aggregates ------------------------------------------------------------------
#
# The current sales table holds a transaction once, so counting its ids equals
# counting distinct ids, and sales can be added up per store or product before
# the dimension is joined: the join sees one row per day and store, and a store
# with a third of all sales shrinks on the map side.

def added_up(sales: DataFrame, *by: str | Column) -> DataFrame:
    """Ids, units and USD of the sales per group."""
    return sales.groupBy(*by).agg(
        F.count("transaction_id").alias("n"), F.sum("quantity").alias("units"), F.sum("total_amount_usd").alias("usd"))


def _totals(**names: str) -> list[Column]:
    casts = {"n": "long", "units": "long", "usd": "decimal(38,2)"}
    return [F.sum(c).cast(casts[c]).alias(name) for c, name in names.items()]


def daily_sales(sales: DataFrame, stores: DataFrame) -> DataFrame:
    """Transactions, units and USD revenue per day and region; unknown stores fall out."""
    per_store = added_up(sales, F.to_date("transaction_timestamp").alias("sales_date"), "store_id")
    return (per_store.join(stores.select("store_id", "region"), "store_id")
            .groupBy("sales_date", "region")
            .agg(*_totals(n="total_transactions", units="total_quantity", usd="total_revenue_usd")))


def monthly_revenue(sales: DataFrame, stores: DataFrame) -> DataFrame:
    """USD revenue and transactions per year, month and region."""
    when = F.col("transaction_timestamp")
    per_store = added_up(sales, F.year(when).alias("year"), F.month(when).alias("month"), "store_id")
    return (per_store.join(stores.select("store_id", "region"), "store_id")
            .groupBy("year", "month", "region")
            .agg(*_totals(usd="monthly_revenue_usd", n="transactions_count")))


def product_performance(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Units, USD revenue and transactions per product; unknown products fall out."""
    return products_of_added_up(added_up(sales, "product_id"), products)


def products_of_added_up(per_product: DataFrame, products: DataFrame) -> DataFrame:
    return (per_product.join(products.select("product_id", "product_name", "category", "brand"), "product_id")
            .select("product_id", "product_name", "category", "brand",
                    F.col("units").alias("total_units_sold"), F.col("usd").cast("decimal(38,2)").alias("total_revenue_usd"),
                    F.col("n").alias("transactions_count")))


# The same tables from stored sums of signed changes.

#: What sales are added up by, and which measures are added.
SUMS = {
    "per_store": {"sales_date": "to_date(transaction_timestamp)", "store_id": "store_id"},
    "per_product": {"product_id": "product_id"},
}
SALES_MEASURES = {
    "n": ("if(transaction_id is null, null, 1)", "long"),
    "units": ("cast(quantity as long)", "long"),
    "usd": ("total_amount_usd", "decimal(38,2)"),
}


def touched_groups(changes: DataFrame, kind: str) -> DataFrame:
    """The groups of SUMS whose sums the signed sales change."""
    sums = signed_sums(changes, SUMS[kind], SALES_MEASURES)
    return sums.where(" or ".join(f"{c} <> 0" for c in sums.columns if c not in SUMS[kind])).select(*SUMS[kind])


def touched_ids(changes: DataFrame, key: str, *columns: str) -> DataFrame:
    """The keys of signed rows that differ in one of the columns."""
    return changes.groupBy(key, *columns).agg(F.sum("sign").alias("s")).where("s <> 0").select(key).distinct()


def daily_of_sums(per_store: DataFrame, stores: DataFrame) -> DataFrame:
    return (per_store.join(stores.select("store_id", "region"), "store_id").groupBy("sales_date", "region")
            .agg(F.sum("n").alias("total_transactions"), total("units").alias("total_quantity"), total("usd").cast("decimal(38,2)").alias("total_revenue_usd")))


def monthly_of_sums(per_store: DataFrame, stores: DataFrame) -> DataFrame:
    day = F.col("sales_date")
    return (per_store.join(stores.select("store_id", "region"), "store_id").groupBy(F.year(day).alias("year"), F.month(day).alias("month"), "region")
            .agg(total("usd").cast("decimal(38,2)").alias("monthly_revenue_usd"), F.sum("n").alias("transactions_count")))


def products_of_sums(per_product: DataFrame, products: DataFrame) -> DataFrame:
    def value(name: str) -> Column:
        return F.when(F.col(f"{name}_n") > 0, F.col(name))
    return per_product.join(products.select("product_id", "product_name", "category", "brand"), "product_id").select(
        "product_id", "product_name", "category", "brand", value("units").alias("total_units_sold"),
        value("usd").alias("total_revenue_usd"), F.col("n").alias("transactions_count"))


# Checks ----------------------------------------------------------------------

def reconcile(sales: DataFrame, daily: DataFrame) -> DataFrame:
    """Revenue and transactions of the current table against the daily table.

    The current table holds each transaction once, so its ids are counted, not gathered to be told apart. Deltas are
    reported rather than equality: sales of unknown stores are in the first and not in the second.
    """
    return compare_totals(sales, daily, {
        "revenue_usd": (F.sum("total_amount_usd"), F.sum("total_revenue_usd")),
        "transactions": (F.count("transaction_id"), F.sum("total_transactions")),
    })


def reconcile_in_one_pass(sales: DataFrame, stores: DataFrame, path: str) -> DataFrame:
    """Write the daily table and compare it with the totals of the current sales, which are seen in that same pass."""
    seen = Observation()
    observed = sales.observe(seen, F.sum("total_amount_usd").cast("decimal(38,2)").alias("usd"), F.count("transaction_id").alias("n"))
    daily_sales(observed, stores).write.mode("overwrite").parquet(path)
    totals = sales.sparkSession.createDataFrame([(seen.get["usd"], seen.get["n"])], "total_amount_usd decimal(38,2), n long")
    return compare_totals(totals, sales.sparkSession.read.parquet(path), {
        "revenue_usd": (F.sum("total_amount_usd"), F.sum("total_revenue_usd")),
        "transactions": (F.sum("n"), F.sum("total_transactions")),
    })


def reconcile_products(sales: DataFrame, performance: DataFrame) -> DataFrame:
    """Revenue per product of the current table against the product table."""
    return compare_products(added_up(sales, "product_id"), performance)


def compare_products(per_product: DataFrame, performance: DataFrame) -> DataFrame:
    return compare_per_key(per_product.withColumnRenamed("usd", "revenue"), performance.withColumnRenamed("total_revenue_usd", "revenue"),
                           "product_id", "revenue")


def layer_counts(bronze: dict[str, DataFrame], silver: dict[str, DataFrame], gold: dict[str, DataFrame]) -> DataFrame:
    """Row counts of all layers, ready to be stamped and appended to the log."""
    named = {"bronze": bronze, "silver": silver, "gold": gold}
    return metric_rows({(layer, t): df for layer, tables in named.items() for t, df in tables.items()})


def stamp_run(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.current_timestamp().alias("run_timestamp"), "layer", "table_name", "metric_type",
                          F.col("metric_value").cast("long").alias("metric_value"))
