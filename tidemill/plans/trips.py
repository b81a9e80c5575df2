"""Taxi trips: distance rule, flagged rides, weekly statistics, top rides.

The filters and projections work on batch and streamed frames alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact_mean, round_decimal
from ..operators.rules import drop_violations, observe_rules, observed_counts, rule_metrics

def rules() -> dict[str, Column]:
    return {"valid_distance": F.col("trip_distance") > 0.0}


def valid_trips(trips: DataFrame) -> DataFrame:
    """Trips with a positive distance; a missing distance is dropped too."""
    return drop_violations(trips, rules())


def rule_counts(trips: DataFrame) -> DataFrame:
    """Kept and dropped rows of each rule."""
    return rule_metrics(trips, rules())


def write_valid(trips: DataFrame, path: str) -> DataFrame:
    """Write the valid trips; the kept and dropped rows of each rule, counted in that write."""
    valid, seen = observe_rules(trips, rules())
    valid.write.mode("overwrite").parquet(path)
    return observed_counts(trips.sparkSession, seen, rules())


def violations_left(trips: DataFrame) -> DataFrame:
    """Rows of the valid trips that break the rule: always 0."""
    return valid_trips(trips).agg(F.count_if(F.col("trip_distance") <= 0).alias("dropped_rows"))


def _week(trips: DataFrame) -> Column:
    """Monday of the pickup's week, in the type of the pickup time."""
    pickup = "tpep_pickup_datetime"
    return F.date_trunc("week", pickup).cast(trips.schema[pickup].dataType).alias("week")


def flagged_rides(trips: DataFrame) -> DataFrame:
    """Dear rides within one zip or over a short distance."""
    dear = F.col("fare_amount") > 50
    same_zip = F.col("pickup_zip") == F.col("dropoff_zip")
    return trips.where((same_zip & dear) | ((F.col("trip_distance") < 5) & dear)).select(
        _week(trips), F.col("pickup_zip").alias("zip"), "fare_amount", "trip_distance")


def weekly_stats(trips: DataFrame) -> DataFrame:
    """Average fare and distance per week, oldest first; ``total_rides`` is an extra column."""
    return trips.groupBy(_week(trips)).agg(
        exact_mean(F.col("fare_amount")).alias("avg_amount"),
        exact_mean(F.col("trip_distance")).alias("avg_distance"),
        F.count(F.lit(1)).alias("total_rides"),
    ).orderBy("week")


def top_flagged(flagged: DataFrame, n: int) -> DataFrame:
    """The n dearest rides; equal fares are ordered by the remaining columns."""
    return flagged.orderBy(
        F.col("fare_amount").desc(), F.col("trip_distance").desc(), F.col("zip"), F.col("week")).limit(n)


def top_rides_with_week(flagged: DataFrame, weekly: DataFrame, n: int = 3) -> DataFrame:
    """The n dearest rides with their week's averages.

    A week occurs once in the weekly table, so the left join neither drops nor
    repeats a ride and the top n can be taken before it: n rows are joined
    instead of every flagged ride.
    """
    stats = weekly.select(
        F.col("week").alias("stats_week"), round_decimal(F.col("avg_amount"), 2).alias("avg_amount"),
        round_decimal(F.col("avg_distance"), 3).alias("avg_distance"))
    return (top_flagged(flagged, n).join(stats, F.col("week") == F.col("stats_week"), "left")
            .select(F.col("stats_week").alias("week"), "avg_amount", "avg_distance",
                    "fare_amount", "trip_distance", "zip")
            .orderBy(F.col("fare_amount").desc()))
