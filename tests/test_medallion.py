from tidemill import schemas
from tidemill.streaming import medallion

SALES = """t1,2025-01-05 10:00:00,S1,P1,2,10.00,,20.00,USD
t2,2025-01-05 11:00:00,S1,P1,0,10.00,,0.00,USD
t3,2025-01-06 11:00:00,S9,P1,1,10.00,1.00,9.00,EUR
"""


def deliver(folder, name, schema, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(",".join(schema.names) + "\n" + text)


def test_run_is_incremental_and_repeatable(spark, tmp_path, rows):
    landing, store = tmp_path / "landing", str(tmp_path / "store")
    deliver(landing / "sales", "1.csv", schemas.SALES_FEED, SALES)
    deliver(landing / "products", "1.csv", schemas.PRODUCT_FEED, "P1,galaxy TAB,tablets,ACME,735,USD\n")
    deliver(landing / "stores", "1.csv", schemas.STORE_FEED, "S1,main,LA,CA,usa,west\n")

    def daily():
        got = spark.read.parquet(f"{store}/gold/gold_daily_sales_summary").collect()
        return sorted((str(g.sales_date), g.region, g.total_transactions, g.total_quantity, float(g.total_revenue_usd)) for g in got)

    metrics = {(m.table_name, m.metric_type): m.metric_value for m in medallion.run(spark, str(landing), store).collect()}
    assert daily() == [("2025-01-05", "WEST", 2, 2, 20.0)]
    assert metrics["bronze_sales_transactions", "record_count"] == metrics["silver_sales_transactions", "record_count"] == 3
    assert metrics["silver_sales_quarantine", "rejected_INVALID_QUANTITY"] == 1

    def files():
        return {f for layer in ("bronze", "silver", "gold", "state", "built") for f in (tmp_path / "store" / layer).rglob("*.parquet")}

    before = files()
    medallion.run(spark, str(landing), store)
    assert files() == before and daily() == [("2025-01-05", "WEST", 2, 2, 20.0)]
    assert spark.read.parquet(f"{store}/bronze/bronze_sales_transactions").count() == 3
    assert spark.read.parquet(f"{store}/silver/silver_sales_quarantine").count() == 1

    # A correction without quantity keeps the old one; a late store makes its sale appear.
    deliver(landing / "sales", "2.csv", schemas.SALES_FEED, "t1,2025-01-05 10:00:00,S1,P1,,30.00,,60.00,USD\n")
    deliver(landing / "stores", "2.csv", schemas.STORE_FEED, "S9,far,NY,NY,usa,east\n")
    medallion.run(spark, str(landing), store)
    silver = {s.transaction_id: s for s in spark.read.parquet(f"{store}/silver/silver_sales_transactions").collect()}
    assert (silver["t1"].quantity, float(silver["t1"].unit_price)) == (2, 30.0)
    assert daily() == [("2025-01-05", "WEST", 2, 2, 20.0), ("2025-01-06", "EAST", 1, 1, 9.9)]
    log = spark.read.schema(schemas.QUALITY_LOG).parquet(f"{store}/pipeline_data_quality_log")
    assert log.where("table_name = 'gold_product_performance'").count() == 3


def test_feeds_without_files(spark, tmp_path):
    landing, store = tmp_path / "landing", str(tmp_path / "store")
    deliver(landing / "sales", "1.csv", schemas.SALES_FEED, SALES)
    (landing / "products").mkdir()
    (landing / "stores").mkdir()
    metrics = {(m.table_name, m.metric_type): m.metric_value for m in medallion.run(spark, str(landing), store).collect()}
    assert metrics["silver_sales_transactions", "record_count"] == 3 and metrics["silver_product_master", "record_count"] == 0
    deliver(landing / "stores", "1.csv", schemas.STORE_FEED, "S1,main,LA,CA,usa,west\n")
    medallion.run(spark, str(landing), store)
    assert spark.read.parquet(f"{store}/gold/gold_daily_sales_summary").count() == 1


def test_only_changed_tables_are_written(spark, tmp_path):
    landing, store = tmp_path / "landing", str(tmp_path / "store")
    deliver(landing / "sales", "1.csv", schemas.SALES_FEED, SALES)
    deliver(landing / "products", "1.csv", schemas.PRODUCT_FEED, "P1,galaxy TAB,tablets,ACME,735,USD\n")
    deliver(landing / "stores", "1.csv", schemas.STORE_FEED, "S1,main,LA,CA,usa,west\n")
    medallion.run(spark, str(landing), store)

    def files(table):
        return set((tmp_path / "store" / table).rglob("part-*"))

    tables = ("silver/silver_sales_transactions", "silver/silver_store_region", "gold/gold_daily_sales_summary", "gold/gold_product_performance")
    before = [files(t) for t in tables]
    deliver(landing / "stores", "2.csv", schemas.STORE_FEED, "S9,far,NY,NY,usa,east\n")
    medallion.run(spark, str(landing), store)
    assert [files(t) == b for t, b in zip(tables, before)] == [True, False, False, True]

    # A write that broke off left nothing in the notes; the table comes back with the next run.
    notes = spark.read.parquet(f"{store}/built").where("name <> 'gold/gold_product_performance'").collect()
    spark.createDataFrame(notes).write.mode("overwrite").parquet(f"{store}/built")
    spark.createDataFrame([(1,)], "broken int").limit(0).write.mode("overwrite").parquet(f"{store}/gold/gold_product_performance")
    medallion.run(spark, str(landing), store)
    assert spark.read.parquet(f"{store}/gold/gold_product_performance").count() == 1
