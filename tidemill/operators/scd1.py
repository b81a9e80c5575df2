"""Type-1 state per key that ignores null updates.

Each column keeps its own newest non-null value. Two states merge by taking, for each column, the larger
``struct(order, value)``, where the order of a change row is its sequence and a tie. The tie belongs to the whole row, so
among rows of equal sequence one row goes before the others in all its columns. That merge is associative, commutative and
idempotent: it accepts batches in any order, and replaying a batch changes nothing.

A state row holds the values as plain columns, the newest order of them all in ``AT``, and in ``OWN`` the order of each
column that is older than that; most rows need none. Wide structs exist only inside the aggregation, so sorts and stored
rows carry the order once and not once per column.

By default the merge combines before the shuffle, so a hot key shrinks to one row per task. With ``few``, for keys that have
few rows each, rows are shuffled as they are, which moves less; a key with very many rows is then one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AT, OWN = "_at", "_own"


def fold_changes(df: DataFrame, keys: Sequence[str], sequence_by: Sequence[str],
                 columns: Sequence[str] | None = None, tie: Column | None = None, few: bool = False) -> DataFrame:
    """One state row per key from raw change rows; ``tie`` orders rows of equal sequence, by default a hash of the row."""
    columns = columns or [c for c in df.columns if c not in keys]
    return _compact(_newest(_ordered(df, keys, sequence_by, columns, tie), keys, columns, few), keys, columns)


def merge_changes(states: DataFrame, keys: Sequence[str], few: bool = False) -> DataFrame:
    """Merge any number of state rows per key into one."""
    columns = _values(states, keys)
    return _compact(_newest(states, keys, columns, few), keys, columns)


def current_rows(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Plain rows from merged state."""
    return states.select(*keys, *_values(states, keys))


def scd1(df: DataFrame, keys: Sequence[str], sequence_by: Sequence[str],
         columns: Sequence[str] | None = None, tie: Column | None = None, few: bool = False) -> DataFrame:
    """Batch form: the current row of every key."""
    columns = columns or [c for c in df.columns if c not in keys]
    newest = _newest(_ordered(df, keys, sequence_by, columns, tie), keys, columns, few)
    return newest.select(*keys, *[F.col(f"{c}.value").alias(c) for c in columns])


def _values(states: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in states.columns if c not in (*keys, AT, OWN)]


def _ordered(df: DataFrame, keys: Sequence[str], sequence_by: Sequence[str], columns: Sequence[str], tie: Column | None) -> DataFrame:
    """Change rows with their order."""
    tie = F.xxhash64(*df.columns) if tie is None else tie
    return df.select(*keys, *columns, F.struct(*[F.col(s).alias(f"s{i}") for i, s in enumerate(sequence_by)], tie.alias("tie")).alias(AT))


def _stamped(column: str, own: bool) -> Column:
    order = F.coalesce(F.col(f"{OWN}.{column}"), F.col(AT)) if own else F.col(AT)
    return F.when(F.col(column).isNotNull(), F.struct(order.alias("order"), F.col(column).alias("value")))


def _newest(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], few: bool) -> DataFrame:
    """Per key and column ``struct(order, value)`` of the newest value. The structs are made after the sort of the aggregation."""
    rows = rows.repartition(*keys) if few else rows
    return rows.groupBy(*keys).agg(*[F.max(_stamped(c, OWN in rows.columns)).alias(c) for c in columns])


def _compact(newest: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    orders = [F.col(f"{c}.order") for c in columns]
    at = newest.withColumn(AT, F.greatest(*orders) if len(orders) > 1 else orders[0])
    older = [F.when(order < F.col(AT), order).alias(c) for c, order in zip(columns, orders, strict=True)]
    own = F.when(F.coalesce(*older).isNotNull(), F.struct(*older))
    return at.select(*keys, *[F.col(f"{c}.value").alias(c) for c in columns], AT, own.alias(OWN))
