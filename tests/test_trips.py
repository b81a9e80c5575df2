from datetime import datetime

from tidemill.plans import trips as t

TRIPS = "tpep_pickup_datetime timestamp_ntz, pickup_zip int, dropoff_zip int, fare_amount decimal(10,2), trip_distance decimal(10,2)"


def frame(spark, data):
    from decimal import Decimal
    return spark.createDataFrame(
        [(a, b, c, Decimal(str(d)), None if e is None else Decimal(str(e))) for a, b, c, d, e in data], TRIPS)


def test_rules_and_flags(spark, rows):
    monday = datetime(2024, 1, 1, 0, 0)
    trips = frame(spark, [
        (monday, 1, 1, 60, 9), (monday, 1, 2, 60, 4.99), (monday, 1, 2, 60, 5), (monday, 1, 1, 50, 1),
        (datetime(2024, 1, 7, 23), 1, 2, 51, 1), (monday, 1, 1, 99, 0), (monday, 1, 1, 99, None)])
    valid = t.valid_trips(trips)
    assert valid.count() == 5
    assert rows(t.rule_counts(trips)) == [("valid_distance", 5, 2)]
    assert rows(t.violations_left(trips)) == [(0,)]
    flagged = t.flagged_rides(valid)
    assert [(float(f), float(d)) for f, d in rows(flagged, "fare_amount", "trip_distance")] == [(51, 1), (60, 4.99), (60, 9)]
    assert {r.week for r in flagged.collect()} == {monday}


def test_week_without_statistics_stays(spark):
    a, b = datetime(2024, 1, 2), datetime(2024, 1, 9)
    trips = frame(spark, [(a, 1, 1, 60, 1), (b, 1, 1, 70, 1), (a, 1, 1, 80, 1), (a, 1, 1, 55, 1)])
    weekly = t.weekly_stats(trips.where("tpep_pickup_datetime < '2024-01-08'"))
    top = t.top_rides_with_week(t.flagged_rides(trips), weekly).collect()
    assert [float(r.fare_amount) for r in top] == [80, 70, 60]
    assert [r.week for r in top] == [datetime(2024, 1, 1), None, datetime(2024, 1, 1)]
    assert float(top[0].avg_amount) == 65.0 and top[1].avg_amount is None


def test_ties_at_the_cut_off_are_settled(spark):
    day = datetime(2024, 1, 2)
    data = [(day, z, z, 60, d) for z in (3, 1, 2) for d in (1, 2)]
    for order in (data, data[::-1]):
        top = t.top_flagged(t.flagged_rides(frame(spark, order)), 3).collect()
        assert [(float(r.trip_distance), r.zip) for r in top] == [(2, 1), (2, 2), (2, 3)]


def test_top_is_not_a_full_sort(spark):
    plan = t.top_flagged(t.flagged_rides(frame(spark, [])), 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
