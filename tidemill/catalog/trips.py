"""Trips over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import trips as t
from ..session import scratch_dir
from ..sources import table


def as_trips(events: DataFrame) -> DataFrame:
    """An event as a trip: its value is the fare and, in whole units, the drop-off zip; its user is the pickup
    zip and the number in its properties the distance."""
    return events.select(
        F.col("ts").alias("tpep_pickup_datetime"), F.col("user_id").alias("pickup_zip"),
        F.floor("value").alias("dropoff_zip"), F.col("value").cast("decimal(10,2)").alias("fare_amount"),
        F.get_json_object("props", "$.k").cast("decimal(10,2)").alias("trip_distance"))


def all_trips(spark: SparkSession, d: str) -> DataFrame:
    return as_trips(table(spark, d, "events"))


def valid(spark, d):
    return t.valid_trips(all_trips(spark, d))


def observed(spark, d):
    """Valid trips written, and what the rule kept and dropped as seen in that write beside the rows that are there."""
    path = scratch_dir(spark, "valid-trips")
    counts = t.write_valid(all_trips(spark, d), path)
    return counts.crossJoin(spark.read.parquet(path).agg(F.count("*").alias("written")))  # One row a side.


QUERIES = {
    "taxi_observed": observed,
    "taxi_bronze": valid,
    "taxi_expectation": lambda s, d: t.rule_counts(all_trips(s, d)),
    "taxi_violations_left": lambda s, d: t.violations_left(all_trips(s, d)),
    "taxi_flagged": lambda s, d: t.flagged_rides(valid(s, d)),
    "taxi_weekly": lambda s, d: t.weekly_stats(valid(s, d)),
    "taxi_top_n": lambda s, d: t.top_rides_with_week(t.flagged_rides(valid(s, d)), t.weekly_stats(valid(s, d))),
    "taxi_top20": lambda s, d: t.top_flagged(t.flagged_rides(valid(s, d)), 20),
}

TRIPS_SQL = """WITH trips AS (
  SELECT ts AS tpep_pickup_datetime, user_id AS pickup_zip, CAST(floor(value) AS BIGINT) AS dropoff_zip,
    CAST(value AS DECIMAL(10,2)) AS fare_amount, CAST(json_extract_string(props, '$.k') AS DECIMAL(10,2)) AS trip_distance
  FROM events),
bronze AS (SELECT * FROM trips WHERE trip_distance > 0),
flagged AS (SELECT date_trunc('week', tpep_pickup_datetime) AS week, pickup_zip AS zip, fare_amount, trip_distance FROM bronze
  WHERE (pickup_zip = dropoff_zip AND fare_amount > 50) OR (trip_distance < 5 AND fare_amount > 50)),
weekly AS (SELECT date_trunc('week', tpep_pickup_datetime) AS week, CAST(sum(fare_amount) AS DOUBLE) / count(fare_amount) AS avg_amount,
  CAST(sum(trip_distance) AS DOUBLE) / count(trip_distance) AS avg_distance, count(*) AS total_rides FROM bronze GROUP BY 1)
"""

ORACLE = {
    "taxi_bronze": TRIPS_SQL + "SELECT * FROM bronze",
    "taxi_expectation": TRIPS_SQL + """SELECT 'valid_distance' AS rule, count(*) FILTER (trip_distance > 0) AS kept,
  count(*) FILTER (trip_distance IS NULL OR trip_distance <= 0) AS dropped FROM trips""",
    "taxi_observed": TRIPS_SQL + """SELECT 'valid_distance' AS rule, count(*) FILTER (trip_distance > 0) AS kept,
  count(*) FILTER (trip_distance IS NULL OR trip_distance <= 0) AS dropped, (SELECT count(*) FROM bronze) AS written FROM trips""",
    "taxi_violations_left": TRIPS_SQL + "SELECT count(*) AS dropped_rows FROM bronze WHERE trip_distance <= 0",
    "taxi_flagged": TRIPS_SQL + "SELECT * FROM flagged",
    "taxi_weekly": TRIPS_SQL + "SELECT * FROM weekly ORDER BY week",
    "taxi_top_n": TRIPS_SQL + """SELECT weekly.week, CAST(round(CAST(avg_amount AS DECIMAL(28,8)), 2) AS DECIMAL(23,2)) AS avg_amount,
  CAST(round(CAST(avg_distance AS DECIMAL(28,8)), 3) AS DECIMAL(24,3)) AS avg_distance, fare_amount, trip_distance, zip
FROM flagged LEFT JOIN weekly ON weekly.week = flagged.week
ORDER BY fare_amount DESC, trip_distance DESC, zip, flagged.week LIMIT 3""",
    "taxi_top20": TRIPS_SQL + "SELECT * FROM flagged ORDER BY fare_amount DESC, trip_distance DESC, zip, week LIMIT 20",
}
