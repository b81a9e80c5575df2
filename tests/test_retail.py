from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill import schemas
from tidemill.plans import retail as r

FEED = T.StructType(schemas.SALES_FEED.fields + [T.StructField("ingestion_timestamp", T.IntegerType())])


def sale(tid, seq=1, ts="2025-01-05 10:00:00", store="S1", product="P1", quantity="2", price="10.00", discount=None,
         total="20.00", currency="USD"):
    return (tid, ts, store, product, quantity, price, discount, total, currency, seq)


SALES = [
    sale("ok", discount="2.50"), sale("inr", currency="INR"), sale("jpy", currency="JPY"), sale("none", currency=None),
    sale("q0", quantity="0", price="0"), sale("neg", quantity="-1"), sale("qnull", quantity=None), sale("text", quantity="abc"),
    sale("p0", price="0"), sale("pnull", price=None), sale("noproduct", product=None), sale("nostore", store=None),
    sale("badtime", ts="?"), sale("unknown", store="S9", product="P9"),
    sale("twice", 1, quantity="5"), sale("twice", 2, quantity=None, store="S2"),
]


@pytest.fixture
def staged(spark):
    return r.stage_sales(spark.createDataFrame(SALES, FEED))


@pytest.fixture
def dims(spark):
    stores = r.current_stores(r.stage_stores(spark.createDataFrame(
        [(" S1 ", "main STREET", "a", "b", "usa", "west", 1), ("S2", "x", "a", "b", "usa", "east", 1), (None, "x", "", "", "", "", 1)],
        T.StructType(schemas.STORE_FEED.fields + [T.StructField("ingestion_timestamp", T.IntegerType())]))))
    products = r.current_products(r.stage_products(spark.createDataFrame(
        [("P1 ", "galaxy TAB s9", "electronics", "ACME", "735", "USD", 1), ("P0", "free", "x", "x", "0", "USD", 1),
         ("P2", "odd", "x", "x", None, "USD", 1)],
        T.StructType(schemas.PRODUCT_FEED.fields + [T.StructField("ingestion_timestamp", T.IntegerType())]))))
    return stores, products


def test_staging(staged):
    got = {(s.transaction_id, s.ingestion_timestamp): s for s in staged.collect()}
    ok, inr = got["ok", 1], got["inr", 1]
    assert (ok.discount, ok.calculated_total, ok.total_amount, ok.total_amount_usd) == (
        Decimal("2.50"), Decimal("17.50"), Decimal("20.00"), Decimal("17.50"))
    assert (inr.discount, inr.total_amount_usd) == (Decimal("0.00"), Decimal("0.24"))
    assert got["jpy", 1].total_amount_usd is None and got["text", 1].quantity is None and got["badtime", 1].transaction_timestamp is None


def test_quarantine_priority_and_escape(staged):
    got = {q.transaction_id: q.rejection_reason for q in r.quarantine(staged).collect()}
    assert got == {"q0": "INVALID_QUANTITY", "neg": "INVALID_QUANTITY", "p0": "INVALID_UNIT_PRICE", "jpy": "UNSUPPORTED_CURRENCY",
                   "none": "UNSUPPORTED_CURRENCY", "noproduct": "INVALID_PRODUCT_ID", "nostore": "INVALID_STORE_ID"}
    assert r.quarantine(staged).count() + r.accepted(staged).count() == staged.count()
    assert {m.metric_type: m.metric_value for m in r.rejection_counts(r.quarantine(staged)).collect()}["rejected_INVALID_QUANTITY"] == 2


def test_current_sales_ignores_null_updates(staged):
    current = {s.transaction_id: s for s in r.current_sales(staged).collect()}
    assert len(current) == 15
    assert (current["twice"].quantity, current["twice"].store_id) == (5, "S2")


def test_dimensions(dims, rows):
    stores, products = dims
    assert rows(stores, "store_id", "store_name", "country", "region") == [("S1", "Main Street", "USA", "WEST"), ("S2", "X", "USA", "EAST")]
    assert rows(products, "product_id", "product_name", "brand") == [("P1", "Galaxy Tab S9", "Acme")]


def test_aggregates_equal_the_plain_join(staged, dims, rows):
    stores, products = dims
    sales = r.current_sales(staged)
    plain = sales.join(stores, "store_id").groupBy(F.to_date("transaction_timestamp").alias("sales_date"), "region").agg(
        F.count_distinct("transaction_id"), F.sum("quantity"), F.sum("total_amount_usd"))
    assert [tuple(map(str, x)) for x in rows(r.daily_sales(sales, stores))] == [tuple(map(str, x)) for x in rows(plain)]
    plain = sales.join(stores, "store_id").groupBy(F.year("transaction_timestamp"), F.month("transaction_timestamp"), "region").agg(
        F.sum("total_amount_usd"), F.count_distinct("transaction_id"))
    assert [tuple(map(str, x)) for x in rows(r.monthly_revenue(sales, stores))] == [tuple(map(str, x)) for x in rows(plain)]
    perf = r.product_performance(sales, products).collect()
    assert [(p.product_id, p.transactions_count) for p in perf] == [("P1", 13)]


def test_reconciliation_reports_unknown_stores(staged, dims):
    stores, products = dims
    sales = r.current_sales(staged)
    delta = {m.measure: m.delta for m in r.reconcile(sales, r.daily_sales(sales, stores)).collect()}
    # One sale names an unknown store, one none at all.
    assert delta["transactions"] == 2 and delta["revenue_usd"] == 40
    known = sales.where("store_id IN ('S1', 'S2')")
    assert {m.delta for m in r.reconcile(known, r.daily_sales(known, stores)).collect()} == {0}
    per = {m.product_id: m.delta for m in r.reconcile_products(sales, r.product_performance(sales, products)).collect()}
    assert per["P1"] == 0 and per["P9"] == 20 and per[None] == 20
    orphans = {o.key_column: o.orphans for o in r.orphan_sales(sales, stores, products).collect()}
    assert orphans == {"store_id": 2, "product_id": 2}


def test_daily_sales_adds_up_before_the_join(staged, dims):
    plan = r.daily_sales(r.current_sales(staged), dims[0])._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner")
    assert plan.index("Aggregate [", join) > join  # an aggregate below the join
    assert "Cartesian" not in plan


def test_layer_counts_and_log(staged, dims, spark, tmp_path):
    metrics = r.layer_counts({"b": staged}, {"s": dims[0]}, {"g": dims[1].limit(0)})
    assert {(m.layer, m.table_name): m.metric_value for m in metrics.collect()} == {("bronze", "b"): 16, ("silver", "s"): 2, ("gold", "g"): 0}
    from tidemill.sources import append_rows
    for _ in range(2):
        append_rows(r.stamp_run(metrics), str(tmp_path / "log"))
    log = spark.read.schema(schemas.QUALITY_LOG).parquet(str(tmp_path / "log"))
    assert log.count() == 6 and log.where("run_timestamp IS NULL").count() == 0
