"""Gapless row numbers over a distributed total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

_AT = "__tidemill_at"


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its row's place (from 0) in ``order`` as column ``name``, written to the shared folder.

    Rows are range-partitioned and sorted where they are; only one count per partition is added up, so
    neither a task nor the driver sees all rows. Rows that tie in ``order`` are numbered in any order; they
    are spread over partitions by a salt, so a value with a third of the rows does not land in one task.
    An input column called ``name`` is replaced.
    """
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(4096))
    keyed = df.drop(name).withColumn("__tidemill_salt", salt)
    order = [*order, F.col("__tidemill_salt")]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("__tidemill_salt")
    placed = stored(placed.withColumn(_AT, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(_AT, 33)
    counts = placed.groupBy(part.alias("__tidemill_part")).agg(F.count("*").alias("__tidemill_rows"))
    before = Window.orderBy("__tidemill_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__tidemill_part", F.coalesce(F.sum("__tidemill_rows").over(before), F.lit(0)).alias("__tidemill_before"))
    # One row per shuffle partition: a bound the data cannot exceed.
    joined = placed.withColumn("__tidemill_part", part).join(F.broadcast(offsets), "__tidemill_part")
    inside = F.col(_AT).bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(name, F.col("__tidemill_before") + inside).drop("__tidemill_part", "__tidemill_before", _AT)
