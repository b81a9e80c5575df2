"""Signed changes of keyed tables, and sums that follow them.

A changed key gives its old row with sign -1 and its new row with sign +1. Sums of signed rows add up: the sums of a
table after a change are those before it plus the sums of its changes, in any grouping, and no other row is read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signed_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows with ``sign`` -1, new ones with +1; a row that is in both is no change."""
    both = old.withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1)))
    # At most one old and one new row of a key meet here.
    return both.groupBy(*old.columns).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")


def of_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key is in ``keys``; a null key is a key."""
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(keys[c]) for c in keys.columns])
    return df.join(keys, same, "left_semi")


def signed_sums(changes: DataFrame, by: Mapping[str, str], measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Per group: ``rows``, and of each measure the sum and, as ``{name}_n``, how many values are not null.

    Groups and measures are SQL expressions; a measure also has the type of its sum.
    """
    sign = F.col("sign")
    sums = [F.sum(sign).cast("long").alias("rows")]
    for name, (expression, kind) in measures.items():
        value = F.expr(expression)
        known = F.when(value.isNotNull(), sign).otherwise(0)
        sums += [F.coalesce(F.sum(sign * value), F.lit(0)).cast(kind).alias(name), F.sum(known).cast("long").alias(f"{name}_n")]
    return changes.groupBy(*[F.expr(expression).alias(name) for name, expression in by.items()]).agg(*sums)


def added(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums of sums; groups without rows are gone."""
    total = sums.groupBy(*by).agg(*[F.sum(c).cast(sums.schema[c].dataType).alias(c) for c in sums.columns if c not in by])
    return total.where("rows <> 0")


def total(name: str) -> Column:
    """The sum of a measure over groups, null where no value is there."""
    return F.when(F.sum(f"{name}_n") > 0, F.sum(name))
