"""Quality checks and metric rows as DataFrames; raising is left to the caller."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two conditions under which a count fails, and the branch names.
FAIL_CONDITIONS = ("count==0", "count>0")
LOW_BRANCH, NORMAL_BRANCH = "warn_low_volume", "normal_completion"


def count_check(df: DataFrame, name: str, fail_condition: str, where: Column | None = None) -> DataFrame:
    """One row: check name, count, condition and whether the check passed."""
    if fail_condition not in FAIL_CONDITIONS:
        raise ValueError(f"unknown fail condition: {fail_condition}")
    counted = df.agg((F.count(F.lit(1)) if where is None else F.count_if(where)).alias("value"))
    passed = F.col("value") != 0 if fail_condition == "count==0" else F.col("value") == 0
    return counted.select(
        F.lit(name).alias("check_name"), "value",
        F.lit(fail_condition).alias("fail_condition"), passed.alias("passed"),
    )


def low_volume(counts: DataFrame, count_col: str, threshold: int) -> DataFrame:
    """Name the branch each count leads to."""
    branch = F.when(F.col(count_col) < threshold, LOW_BRANCH).otherwise(NORMAL_BRANCH)
    return counts.withColumn("branch", branch)


def anomaly_records(df: DataFrame, kind: str, date_col: str) -> DataFrame:
    """Shape failing rows for the anomaly sink, which is partitioned by kind and date."""
    return df.select(F.lit(kind).alias("kind"), F.col(date_col).cast("string").alias("date"),
                     *[c for c in df.columns if c != date_col])


def metric_rows(tables: dict[tuple[str, str], DataFrame], metric: str = "record_count") -> DataFrame:
    """Row count of every (layer, table) as one DataFrame in the log's shape, without the stamp."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("metric_value")).select(
            F.lit(layer).alias("layer"), F.lit(table).alias("table_name"),
            F.lit(metric).alias("metric_type"), "metric_value")
        for (layer, table), df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
