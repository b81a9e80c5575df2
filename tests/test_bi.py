from datetime import date
from decimal import Decimal

import pytest

from tidemill.plans import bi as b

FACT = "date date, product_key int, customer_key int, region_key int, sales_amount decimal(18,4), profit decimal(18,4), quantity bigint"


@pytest.fixture
def star(spark):
    def fact(day, product, region, amount, customer=1):
        return (day, product, customer, region, Decimal(amount), Decimal(amount) / 10, 1)
    facts = spark.createDataFrame([
        fact(date(1999, 1, 5), 1, 1, 100), fact(date(1999, 1, 6), 2, 1, 50), fact(date(1999, 3, 1), 3, 2, 0),
        fact(date(2000, 1, 5), 1, 1, 150), fact(date(2000, 2, 29), 1, 2, 30, 2), fact(date(2000, 3, 1), 9, 9, 5, 9)], FACT)
    products = spark.createDataFrame([(1, "p1", "A"), (2, "p2", "A"), (3, "p3", "B")], "product_key int, product string, category string")
    customers = spark.createDataFrame([(1, "HOME"), (2, "WORK")], "customer_key int, segment string")
    regions = spark.createDataFrame([(1, "ASIA"), (2, "EUROPE")], "region_key int, region string")
    return facts, products, customers, regions


def test_star_keeps_facts_without_a_dimension_row(star):
    facts, products, customers, regions = star
    got = {(r.year, r.category, r.segment, r.region): float(r.total_sales) for r in b.star(facts, products, customers, regions).collect()}
    assert got == {(1999, "A", "HOME", "ASIA"): 150, (1999, "B", "HOME", "EUROPE"): 0, (2000, "A", "HOME", "ASIA"): 150,
                   (2000, "A", "WORK", "EUROPE"): 30, (2000, None, None, None): 5}
    assert float(b.totals(facts).first().total_sales) == 335


def test_filters(star):
    facts, products, _, regions = star
    assert b.filtered_sales(facts, products, regions).count() == 4
    one = b.filtered_sales(facts, products, regions, year=1999, region="ASIA", category="A").collect()
    assert [(r.year, r.month, float(r.total_sales)) for r in one] == [(1999, 1, 150)]


def test_matrix_levels(star):
    got = {(r.category, r["product"], r.level): float(r.total_sales) for r in b.category_matrix(star[0], star[1]).collect()}
    assert got[None, None, 3] == 335 and got["A", None, 1] == 330 and got["A", "p1", 0] == 280


def test_year_to_date_and_last_year(star):
    ytd = {r.date: r.sales_ytd for r in b.sales_ytd(star[0]).collect()}
    assert ytd[date(1999, 12, 31)] == 150 and ytd[date(2000, 1, 4)] is None and ytd[date(2000, 12, 31)] == 185
    ly = {r.date: r.sales_ly for r in b.sales_ly(star[0]).collect()}
    assert ly[date(2000, 1, 5)] == 100 and ly[date(2000, 1, 7)] is None


def test_growth(star):
    got = {(r.year, r.month): r.yoy_growth for r in b.yoy(star[0]).collect()}
    assert got[2000, 1] == 0.0 and got[2000, 2] is None  # no February the year before
    assert got[2000, 3] is None  # last year's March was zero
    assert got[1999, 1] is None and len(got) == 24
    missing = {(r.year, r.month): r.yoy_growth for r in b.yoy(star[0].where("not (year(date) = 2000 and month(date) = 1)")).collect()}
    assert missing[2000, 1] == -1.0


def test_top_products_and_trend(star):
    got = [(r.category, r.place, r.product_key) for r in b.top_products(star[0], star[1], 1).orderBy("category").collect()]
    assert got == [(None, 1, 9), ("A", 1, 1), ("B", 1, 3)]
    assert b.trend_fit(star[0]).first().months == 5


def test_target_status(star, spark):
    targets = spark.createDataFrame(
        [(1999, "A", Decimal(150)), (2000, "A", Decimal(195)), (2000, "B", Decimal(1)), (1999, "B", None)],
        "year int, category string, target decimal(38,4)")
    got = {(r.year, r.category): r.status for r in b.target_status(star[0], star[1], targets).collect()}
    assert got == {(1999, "A"): "ON_TARGET", (2000, "A"): "NEAR", (2000, "B"): "MISSED", (1999, "B"): "NO_TARGET"}
