"""Calendar measures over daily totals.

The facts are first added up per day, so everything here works on at most a few
hundred rows per year, whatever the size of the fact table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def date_spine(days: DataFrame, day: str = "date") -> DataFrame:
    """Every calendar day from 1 January of the first year to 31 December of the last."""
    bounds = days.agg(F.trunc(F.min(day), "year").alias("lo"), F.trunc(F.max(day), "year").alias("hi"))
    last = F.date_sub(F.add_months("hi", 12), 1)
    return bounds.select(F.explode(F.sequence("lo", last)).alias(day))


def running_total_by_year(spine: DataFrame, daily: DataFrame, value: str, out: str, day: str = "date") -> DataFrame:
    """Year-to-date total on every day of the spine, also on days without rows."""
    w = Window.partitionBy(F.year(day)).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(daily, day, "left").withColumn(out, F.sum(value).over(w))


def same_day_last_year(spine: DataFrame, daily: DataFrame, value: str, out: str, day: str = "date") -> DataFrame:
    """Each day's value and the value twelve months earlier; 29 February reads 28 February."""
    earlier = daily.select(F.col(day).alias("_earlier"), F.col(value).alias(out))
    return (spine.join(daily, day, "left")
            .withColumn("_earlier", F.add_months(day, -12))
            .join(earlier, "_earlier", "left").drop("_earlier"))


def growth(current: Column, previous: Column) -> Column:
    """(current - previous) / previous; a missing current is 0, a missing or zero previous gives null."""
    return F.try_divide(
        (F.coalesce(current, F.lit(0)) - previous).cast("double"), previous.cast("double"))
