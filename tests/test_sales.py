from datetime import date
from decimal import Decimal

import pytest

from tidemill import schemas
from tidemill.plans import sales as p
from tidemill.sources import frame_from_columns

D = Decimal


@pytest.fixture
def till(spark):
    return frame_from_columns(spark, {
        "transaction_id": [1, 2, 3, 4, 5, 5], "store_id": [1, 2, 3, 1, None, None],
        "store_name": ["North", "South", "East", "North", None, None],
        "date": [date(2025, 10, 1), date(2025, 10, 10), date(2025, 10, 11), date(2025, 9, 30), date(2025, 10, 5), date(2025, 10, 5)],
        "product_id": [1, 2, 3, 4, 5, 5], "product_name": ["a", "b", "c", "d", "e", "e"], "quantity": [4, 2, 6, 6, 4, 4],
        "unit_price": [D("2.50"), D("8"), D("1.20"), None, D("3.5"), D("3.5")],
        "total": [D("10.00"), D("16.00"), D("7.20"), None, D("10.50"), D("10.50")],
        "customer_id": [1, None, 3, 4, 5, 5], "promo_code": ["DISC10", None, "DISC10", None, "DISC5", "DISC5"],
    }, schemas.TILL_SALES)


def test_date_range_is_inclusive(till, rows):
    got = p.in_date_range(till, "2025-10-01", "2025-10-10")
    assert [r[0] for r in rows(got, "transaction_id")] == [1, 2, 5, 5]


def test_effective_price_divides_the_percentage(till):
    got = {r.transaction_id: r.effective_price for r in p.with_effective_price(till).collect()}
    assert got == {1: D("9.000000"), 2: D("16.000000"), 3: D("6.480000"), 4: None, 5: D("9.975000")}
    assert [r.transaction_id for r in p.high_value(till).collect()] == [2]


def test_store_revenue_null_sum_is_zero_and_null_store_is_left_out(till):
    got = {r.store_id: float(r.effective_price) for r in p.revenue_by_store(till.where("transaction_id <> 1")).collect()}
    assert got == {1: 0.0, 2: 16.0, 3: 6.48}


def test_statistics(till):
    stats = {r.store_id: (r.mean_total, r.std_total) for r in p.store_statistics(till).collect()}
    assert stats[2] == (16.0, None) and stats[1][0] == 10.0
    assert p.average_basket(till).first()[0] == pytest.approx((10 + 16 + 7.2 + 21) / 5)
    assert p.subset(till).columns == ["transaction_id", "date", "total"]


def test_transform(till):
    got = {r.transaction_id: r for r in p.transform(till).collect()}
    assert len(got) == 5 and p.transform(till).count() == 5
    assert (got[2].promo_code, got[2].customer_id) == ("NONE", 0)


def test_csv_to_json(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(",".join(schemas.TILL_SALES.names) + "\n" + "1,1,N,2025-10-01,5,Pen,2,3.50,7.00,,DISC10\n" * 2)
    p.run(spark, str(path), str(tmp_path / "out"), schemas.TILL_SALES)
    got = spark.read.json(str(tmp_path / "out")).collect()
    assert [(r.customer_id, r.promo_code, r.effective_price, r.date) for r in got] == [(0, "DISC10", 6.3, "2025-10-01")]
    inferred = p.run(spark, str(path), str(tmp_path / "out2"))
    assert inferred.count() == 1
