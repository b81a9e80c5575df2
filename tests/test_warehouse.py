import json
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from tidemill import schemas
from tidemill.operators import VersionedTable
from tidemill.plans import warehouse as w


def order(oid, ts="2025-12-07T09:00:00Z", customer="C1", product="P1", quantity="2", total="9.99", currency="USD", status="DONE"):
    return (oid, ts, customer, product, quantity, total, currency, status)


def staged(spark, *orders):
    return w.stage_orders(spark.createDataFrame(list(orders), schemas.ORDER_FILE))


def test_cleaning(spark):
    df = staged(spark, order("1", currency=""), order("2", currency="usd", quantity="2.5"), order("3", currency="EUR", quantity="abc"),
                order("4", ts="whenever", quantity="3.5"), order("5", total="n/a"), order("6", currency=None))
    clean = {r.order_id: r for r in w.clean_orders(df).collect()}
    assert [clean[i].quantity for i in "123456"] == [2, 2, None, 4, 2, 2]
    assert clean["1"].currency == clean["6"].currency == "USD"
    assert clean["4"].ts_utc is None and clean["1"].ts_utc == datetime(2025, 12, 7, 9)
    flagged = {r.order_id: r.currency_mismatch_flag for r in w.flag_orders(w.valid_orders(w.clean_orders(df))).collect()}
    assert flagged == {"1": False, "2": False, "4": False, "6": False}
    assert {r.order_id: r.currency_mismatch_flag for r in w.flag_orders(w.clean_orders(df)).collect()}["3"] is True


def test_invalid_rows_fall_out(spark):
    df = staged(spark, order(None), order("1", customer=None), order("2", product=None), order("3", quantity="-1"),
                order("4", total=None), order("5", quantity="0"))
    assert [r.order_id for r in w.fact_rows(df).collect()] == ["5"]


def test_dedup_prefers_a_time_over_none(spark):
    df = staged(spark, order("1", ts=None, status="A"), order("1", ts="2025-12-06T00:00:00Z", status="B"),
                order("1", ts="2025-12-07T00:00:00Z", status="C"), order("1", ts="2025-12-07T00:00:00Z", status="D"))
    assert [r.status for r in w.fact_rows(df).collect()] == ["D"]


def test_dimension_upserts(spark, rows):
    columns = schemas.DIM_CUSTOMERS
    t0, t1 = datetime(2025, 1, 1), datetime(2025, 2, 1)
    dim = spark.createDataFrame([("C1", "A", "B", "old", date(2024, 1, 1), "UK", t0), ("C2", "K", "K", "keep", None, "UK", t0)], columns)
    batch = w.stage_customers(spark.createDataFrame([
        ("C1", "A", "B", "new", "not a date", "UK"), ("C3", "N", "N", "a", "2025-01-05", "IN"), ("C3", "N", "N", "b", "2025-01-05", "IN"),
        (None, "x", "x", "x", None, None)], schemas.CUSTOMER_FILE))
    got = {r.customer_id: r for r in w.upsert_customers(dim, batch, F.lit(t1)).collect()}
    assert sorted(got) == ["C1", "C2", "C3"]
    assert (got["C1"].email, got["C1"].signup_date, got["C1"].created_at) == ("new", None, t0)
    assert (got["C2"].email, got["C3"].email, got["C3"].created_at) == ("keep", "b", t1)
    products = w.upsert_products(spark.createDataFrame([], schemas.DIM_PRODUCTS), w.stage_products(
        spark.createDataFrame([("P1", "Pen", "Office", "2.50"), ("P2", "Ink", "Office", "?")], schemas.PRODUCT_FILE)), F.lit(t1))
    assert rows(products, "product_id", "unit_price", "created_at") == [("P1", Decimal("2.50"), t1), ("P2", None, t1)]


def test_late_row_is_a_mismatch(spark):
    df = staged(spark, order("1"), order("2"), order("3", ts="2025-12-06T23:00:00Z"))
    day = spark.createDataFrame([(date(2025, 12, 7),)], "process_date date")
    r = w.check_fact_match(w.fact_rows(df), df, day).first()
    assert (r.fact, r.stg_valid, r.stg_valid_same_day, r.passed) == (2, 3, 2, False)
    r = w.check_fact_match(w.fact_rows(df.limit(0)), df.limit(0), day).first()
    assert (r.fact, r.stg_valid, r.passed) == (0, 0, True)


def test_day_predicate_is_pushed_down(spark, tmp_path):
    spark.createDataFrame([(datetime(2025, 12, 7, 9),)], "order_timestamp timestamp").write.parquet(str(tmp_path / "f"))
    facts = spark.read.parquet(str(tmp_path / "f")).where(F.to_date("order_timestamp") == F.lit(date(2025, 12, 7)))
    assert "GreaterThanOrEqual(order_timestamp" in facts._jdf.queryExecution().executedPlan().toString()


def test_volume_branch(spark, rows):
    facts = w.fact_rows(staged(spark, order("1"), order("2"), order("3", ts="2025-12-06T10:00:00Z"), order("4", ts="?")))
    assert rows(w.volume_branch(facts, 2)) == [
        (date(2025, 12, 6), 1, "warn_low_volume"), (date(2025, 12, 7), 2, "normal_completion")]


def land(base, day, customers, products, orders):
    for feed, ext, text in (("customers", "csv", customers), ("products", "csv", products), ("orders", "json", orders)):
        folder = base / "landing" / feed
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{feed}_{day}.{ext}").write_text(text)


def test_run_day_is_idempotent_and_backfills(spark, tmp_path):
    base, store = tmp_path, str(tmp_path / "store")
    head_c = "customer_id,first_name,last_name,email,signup_date,country\n"
    head_p = "product_id,product_name,category,unit_price\n"
    names = schemas.ORDER_FILE.names
    def as_json(orders):
        return json.dumps([dict(zip(names, o)) for o in orders], indent=2)
    land(base, "20251206", head_c + "C1,A,B,a@x,2024-01-01,UK\n", head_p + "P1,Pen,Office,2.50\n",
         as_json([order("1", ts="2025-12-06T09:00:00Z"), order("2", ts="2025-12-06T10:00:00Z")]))
    land(base, "20251207", head_c + "C1,A,B,new@x,2024-01-01,UK\nC2,C,D,c@x,2024-01-02,IN\n", head_p + "P1,Pen,Office,3.00\n",
         as_json([order("2", ts="2025-12-07T08:00:00Z", status="MOVED"), order("3"), order("4", ts="2025-12-05T08:00:00Z")]))
    for run in (date(2025, 12, 7), date(2025, 12, 8), date(2025, 12, 8)):
        checks = {r.check_name: r for r in w.run_day(spark, str(base), store, run, threshold=3).collect()}
    assert (checks["fact_matches_staging"].value, checks["fact_matches_staging"].passed) == (2, False)
    assert checks["dim_customers_nonzero"].passed and checks["fact_no_null_fks"].passed
    facts = VersionedTable(spark, f"{store}/fact_orders", ["order_date"]).read()
    assert {r.order_id: (r.status, r.order_date) for r in facts.collect()} == {
        "1": ("DONE", date(2025, 12, 6)), "2": ("MOVED", date(2025, 12, 7)), "3": ("DONE", date(2025, 12, 7)), "4": ("DONE", date(2025, 12, 5))}
    assert facts.count() == 4
    dim = {r.customer_id: r.email for r in VersionedTable(spark, f"{store}/dim_customers", ["country"]).read().collect()}
    assert dim == {"C1": "new@x", "C2": "c@x"}
    anomalies = spark.read.json(f"{store}/anomalies")
    found = {(r.kind, str(r.date)): (r.fact, r.stg_valid, r.warning) for r in anomalies.collect()}
    assert found == {("dq_mismatch", "2025-12-07"): (2, 3, None), ("low_volume", "2025-12-06"): (None, None, "LOW ORDER COUNT"),
                     ("low_volume", "2025-12-07"): (None, None, "LOW ORDER COUNT")}


def test_days_without_facts_and_files_of_several_days(spark, rows):
    files = staged(spark, order("1"), order("2", ts="2025-12-06T23:00:00Z"), order("3", ts="2025-12-06T10:00:00Z")).withColumn(
        "file_date", F.when(F.col("order_id") == "3", F.lit(date(2025, 12, 6))).otherwise(F.lit(date(2025, 12, 7))))
    days = spark.createDataFrame([(date(2025, 12, n),) for n in (5, 6, 7)], "process_date date")
    facts = w.fact_rows(files)
    assert rows(w.volume_branch(facts, 1, days).select("process_date", "fact", "branch")) == [
        (date(2025, 12, 5), 0, "warn_low_volume"), (date(2025, 12, 6), 2, "normal_completion"), (date(2025, 12, 7), 1, "normal_completion")]
    assert rows(w.check_fact_match(facts, files, days, "file_date")) == [
        (date(2025, 12, 5), 0, 0, 0, True), (date(2025, 12, 6), 2, 1, 1, False), (date(2025, 12, 7), 1, 2, 1, False)]
