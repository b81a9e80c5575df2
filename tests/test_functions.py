from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from tidemill import functions as fn


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_discount_percent_and_effective_price(spark, rows):
    df = spark.createDataFrame([("DISC10",), ("DISC5",), ("OTHER",), (None,)], "promo string")
    priced = df.select("promo", fn.discount_percent(F.col("promo")).alias("p"),
                       fn.effective_price(F.lit("200.00").cast("decimal(12,2)"), fn.discount_percent(F.col("promo"))).alias("e"))
    assert {r.promo: (r.p, float(r.e)) for r in priced.collect()} == {
        "DISC10": (10, 180.0), "DISC5": (5, 190.0), "OTHER": (0, 200.0), None: (0, 200.0)}


def test_rates_are_decimal_and_unknown_is_null(spark):
    got = [r[0] for r in spark.createDataFrame([("USD",), ("INR",), ("EUR",), ("GBP",), ("JPY",), (None,)], "c string")
           .select(fn.fx_rate_to_usd(F.col("c"))).collect()]
    assert got == [Decimal("1.0000"), Decimal("0.0120"), Decimal("1.1000"), Decimal("1.2500"), None, None]


def test_half_even_rounding_and_bad_numbers(spark):
    df = spark.createDataFrame([("2.5",), ("3.5",), ("-0.5",), ("abc",), (None,), ("1e20",)], "t string")
    got = [r[0] for r in df.select(fn.to_int_half_even(fn.try_number(F.col("t")))).collect()]
    assert got == [2, 4, 0, None, None, None]


def test_round_goes_through_decimal(spark):
    assert one(spark, fn.round_decimal(F.lit(1.005), 2)) == (Decimal("1.01"),)


def test_safe_divide(spark):
    assert one(spark, fn.safe_divide(F.lit(1), F.lit(0)), fn.safe_divide(F.lit(1), F.lit(4))) == (None, 0.25)


def test_exact_mean_skips_nulls_and_empty_is_null(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (None,)], "v double")
    assert df.agg(fn.exact_mean(F.col("v"))).first()[0] == 0.3 / 2
    assert df.where("v > 9").agg(fn.exact_mean(F.col("v"))).first()[0] is None


def test_text(spark):
    assert one(spark, fn.clean_name(F.lit("iPHONE 14 pro")), fn.blank_to(F.lit(""), "USD"),
               fn.blank_to(F.lit(None).cast("string"), "USD"), fn.mismatched_currency(F.lit("usd")),
               fn.mismatched_currency(F.lit("EUR"))) == ("Iphone 14 Pro", "USD", "USD", False, True)


def test_times(spark):
    got = one(spark, fn.as_timestamp(F.lit("28-11-2025 09:30"), pattern="dd-MM-yyyy HH:mm").cast("string"),
              fn.as_timestamp(F.lit("31-02-2025 09:30"), pattern="dd-MM-yyyy HH:mm"),
              fn.as_timestamp(F.lit("2025-12-07T09:15:00Z")).cast("string"), fn.as_timestamp(F.lit("soon")),
              fn.as_date(F.lit("2024-12-30")), fn.as_date(F.lit("30/12")), fn.process_date(F.lit("2025-03-01").cast("date")))
    assert got == ("2025-11-28 09:30:00", None, "2025-12-07 09:15:00", None, date(2024, 12, 30), None, date(2025, 2, 28))


def test_typed_times_pass_unchanged(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 5),)], "t timestamp")
    assert df.select(fn.as_timestamp(F.col("t"), df.schema["t"].dataType)).first()[0] == datetime(2024, 1, 1, 5)
