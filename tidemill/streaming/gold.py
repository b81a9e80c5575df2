"""Silver and gold tables that follow the changes of their states.

Each table is partitioned so that a change touches few partitions: silver tables by a bucket of the key, daily and
monthly sales by their date, products by a bucket of their id. A run takes the signed changes of the states since a
table was last written, finds the partitions they touch, and replaces those alone. The gold tables come from stored sums
per day and store and per product, to which each version of the sales adds its signed rows; no unchanged sale is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.signed import added, signed_sums
from ..plans import retail as r
from ..session import stored
from ..sources import append_rows, replace_parts
from .retail import StreamedState

#: Partitions of the tables that have no date, and versions of sums that are kept apart before they are added up.
BUCKETS, APART = 64, 16


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


class Notes:
    """From which versions of its sources each table was last written.

    A table is noted once it is whole, so that one whose write broke off is written again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        try:
            rows = spark.read.schema("name string, source string, at timestamp").parquet(path)
            self.known = {row["name"]: row["source"] for row in rows.groupBy("name").agg(F.max_by("source", "at").alias("source")).collect()}  # One row per table.
        except AnalysisException as missing:  # the first run
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            self.known = {}

    def of(self, name: str) -> list[int] | None:
        return [int(v) for v in self.known[name].split(",")] if name in self.known else None

    def write(self, name: str, versions: list[int]) -> None:
        self.known[name] = ",".join(map(str, versions))
        row = self.spark.createDataFrame([(name, self.known[name])], "name string, source string")
        append_rows(row.coalesce(1).withColumn("at", F.current_timestamp()), self.path)


class Followed:
    """A partitioned table under ``store`` that is rewritten where its sources have changed."""

    def __init__(self, notes: Notes, store: str, name: str):
        self.notes, self.spark, self.path, self.name = notes, notes.spark, f"{store}/{name}", name

    def refresh(self, versions: list[int], rows: Callable[[DataFrame | None], DataFrame], touched: Callable[[list[int]], DataFrame], parts: list[str]) -> DataFrame:
        """Bring the table to ``versions``.

        ``rows`` gives the content of the partitions in a frame of partition values, or of all; ``touched`` the values that
        the changes above the given versions touch.
        """
        known = self.notes.of(self.name)
        whole = rows(None)
        if known is None or any(a > b for a, b in zip(known, versions, strict=True)):
            whole.hint("rebalance", *parts).write.mode("overwrite").partitionBy(*parts).parquet(self.path)
            self.notes.write(self.name, versions)
        elif known != versions:
            values = stored(touched(known).select(*parts).distinct(), "touched")
            if values.limit(1).count():
                replace_parts(stored(rows(values), "replaced"), values, self.path)
            self.notes.write(self.name, versions)
        return self.spark.read.schema(whole.schema).parquet(self.path)


def silver_table(notes: Notes, store: str, name: str, state: StreamedState) -> DataFrame:
    """The current rows of a state, by bucket of its key; only buckets with a changed key are written."""
    key = state.keys[0]

    def rows(values: DataFrame | None) -> DataFrame:
        here = None if values is None else bucket(key).isin([v["bucket"] for v in values.collect()])  # BUCKETS rows at most.
        return state.current(here).withColumn("bucket", bucket(key))

    table = Followed(notes, store, name)
    return table.refresh([state.version()], rows, lambda known: state.changes(*known).select(bucket(key).alias("bucket")), ["bucket"])


class SalesSums:
    """Sums of the current sales per day and store, and per product: a base, and the signed sums of each version since."""

    def __init__(self, notes: Notes, root: str, sales: StreamedState):
        self.notes, self.spark, self.root, self.sales = notes, notes.spark, root, sales

    def refresh(self) -> int:
        """Add the versions of the sales since the last time; the version."""
        now, known = self.sales.version(), self.notes.of("sums")
        if known is None or known[1] > now:
            everything = self.sales.current().withColumn("sign", F.lit(1))
            self._write(everything, f"base={now}")
            known = [now, now]
        for version in range(known[1] + 1, now + 1):
            self._write(self.sales.changes(version - 1, version), f"delta={version}")
        if now - known[0] > APART:
            for kind in r.SUMS:
                self._read(kind, known[0], now).write.mode("overwrite").parquet(f"{self.root}/{kind}/base={now}")
            known[0] = now
        if self.notes.of("sums") != [known[0], now]:
            self.notes.write("sums", [known[0], now])
        return now

    def of(self, kind: str) -> DataFrame:
        return self._read(kind, *self.notes.of("sums"))

    def _write(self, changes: DataFrame, part: str) -> None:
        for kind, by in r.SUMS.items():
            signed_sums(changes, by, r.SALES_MEASURES).write.mode("overwrite").parquet(f"{self.root}/{kind}/{part}")

    def _read(self, kind: str, base: int, now: int) -> DataFrame:
        paths = [f"{self.root}/{kind}/base={base}"] + [f"{self.root}/{kind}/delta={v}" for v in range(base + 1, now + 1)]
        return added(self.spark.read.parquet(*paths), list(r.SUMS[kind]))


def _within(df: DataFrame, values: DataFrame | None) -> DataFrame:
    if values is None:
        return df
    # A stand-in for null lets Spark hash the few values.
    same = [F.coalesce(df[c].cast("string"), F.lit("")) == F.coalesce(values[c].cast("string"), F.lit("")) for c in values.columns]
    return df.join(values, same, "left_semi")


def _days(sums: SalesSums, stores: StreamedState, known: list[int]) -> DataFrame:
    """Days with a changed sale, or with a sale of a store that has changed its region."""
    moved = r.touched_ids(stores.changes(known[1]), "store_id", "region")
    of_sales = r.touched_groups(sums.sales.changes(known[0]), "per_store").select("sales_date")
    return of_sales.union(sums.of("per_store").join(moved, "store_id", "left_semi").select("sales_date"))


def _months(df: DataFrame) -> DataFrame:
    return df.withColumns({"year": F.year("sales_date"), "month": F.month("sales_date")})


def daily_table(notes: Notes, store: str, sums: SalesSums, stores: StreamedState) -> DataFrame:
    """Sales per day and region; only days whose sales or stores have changed are written."""
    at, per_store, dim = sums.refresh(), sums.of("per_store"), stores.current()
    return Followed(notes, store, "gold/gold_daily_sales_summary").refresh(
        [at, stores.version()], lambda values: r.daily_of_sums(_within(per_store, values), dim),
        lambda known: _days(sums, stores, known), ["sales_date"])


def monthly_table(notes: Notes, store: str, sums: SalesSums, stores: StreamedState) -> DataFrame:
    """Sales per month and region; only months whose sales or stores have changed are written."""
    at, per_store, dim = sums.refresh(), _months(sums.of("per_store")), stores.current()
    return Followed(notes, store, "gold/gold_monthly_revenue_by_region").refresh(
        [at, stores.version()], lambda values: r.monthly_of_sums(_within(per_store, values), dim),
        lambda known: _months(_days(sums, stores, known)), ["year", "month"])


def product_table(notes: Notes, store: str, sums: SalesSums, products: StreamedState) -> DataFrame:
    """Sales per product; only buckets of products whose sales or names have changed are written."""
    at, per_product, dim = sums.refresh(), sums.of("per_product").withColumn("bucket", bucket("product_id")), products.current()

    def touched(known: list[int]) -> DataFrame:
        renamed = r.touched_ids(products.changes(known[1]), "product_id", "product_name", "category", "brand")
        return r.touched_groups(sums.sales.changes(known[0]), "per_product").union(renamed).select(bucket("product_id").alias("bucket"))

    return Followed(notes, store, "gold/gold_product_performance").refresh(
        [at, products.version()], lambda values: r.products_of_sums(_within(per_product, values), dim).withColumn("bucket", bucket("product_id")),
        touched, ["bucket"])


def gold_tables(notes: Notes, store: str, sums: SalesSums, stores: StreamedState, products: StreamedState) -> dict[str, DataFrame]:
    """The three gold tables, each brought up to date with its sums and its dimension."""
    return {"gold_daily_sales_summary": daily_table(notes, store, sums, stores),
            "gold_monthly_revenue_by_region": monthly_table(notes, store, sums, stores),
            "gold_product_performance": product_table(notes, store, sums, products)}
