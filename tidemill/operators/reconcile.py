"""Compare a layer with the aggregates derived from it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare_totals(source: DataFrame, derived: DataFrame, measures: Mapping[str, tuple[Column, Column]],
                   dtype: str = "decimal(38,2)") -> DataFrame:
    """Rows (measure, source_value, derived_value, delta), one per measure.

    A measure names the aggregate over the source and the one over the derived
    table. Each side is read once, and one row per side moves.
    """
    def side(df: DataFrame, which: int, column: str) -> DataFrame:
        totals = df.agg(*[pair[which].cast(dtype).alias(name) for name, pair in measures.items()])
        rows = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias(column)) for n in measures])).alias("r")
        return totals.select(rows).select("r.*")

    both = side(source, 0, "source_value").unionByName(
        side(derived, 1, "derived_value"), allowMissingColumns=True).groupBy("measure").agg(
        F.max("source_value").alias("source_value"), F.max("derived_value").alias("derived_value"))
    return both.withColumn("delta", _difference(dtype))


def _difference(dtype: str) -> Column:
    zero = F.lit(0)
    return (F.coalesce("source_value", zero) - F.coalesce("derived_value", zero)).cast(dtype)


def compare_per_key(source: DataFrame, derived: DataFrame, key: str, value: str,
                    dtype: str = "decimal(38,2)") -> DataFrame:
    """Per key both values and their difference; keys found on one side only are kept.

    Both inputs are already one row per key, tagged and added up in a single
    aggregation instead of joined.
    """
    def side(df: DataFrame, column: str) -> DataFrame:
        return df.select(key, F.col(value).cast(dtype).alias(column))

    tagged = side(source, "source_value").unionByName(side(derived, "derived_value"), allowMissingColumns=True)
    both = tagged.groupBy(key).agg(F.sum("source_value").cast(dtype).alias("source_value"),
                                   F.sum("derived_value").cast(dtype).alias("derived_value"))
    return both.withColumn("delta", _difference(dtype))
