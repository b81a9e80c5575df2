"""Order rows along a space-filling curve, so that files have narrow ranges in several columns at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ordered(df: DataFrame, column: str) -> Column:
    """A number that rises with the column; text counts by its first six bytes, which a double holds exactly."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double")


def _rank(key: Column, bounds: np.ndarray) -> Column:
    def rank(values: pa.Array) -> pa.Array:
        number = np.nan_to_num(values.to_numpy(zero_copy_only=False), nan=-np.inf)
        return pa.array(np.searchsorted(bounds, number, "left").astype(np.int64))
    return F.arrow_udf(rank, "bigint")(key)


def curve(df: DataFrame, columns: Sequence[str], bits: int = 8) -> Column:
    """Where on the curve a row is: the bits of its columns' ranks, interleaved.

    A column's rank is which of 2^``bits`` parts of about equally many rows it falls into, so the curve follows the data however they
    are spread. One pass finds the bounds of the parts, a few hundred numbers per column; nulls are in the first part.
    """
    parts = 1 << bits
    at = [i / parts for i in range(1, parts)]
    keys = {c: _ordered(df, c) for c in columns}
    found = df.agg(*[F.percentile_approx(key, at, 10 * parts).alias(c) for c, key in keys.items()]).first()
    place = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        ranked = _rank(keys[c], np.array(found[c] or []))
        for bit in range(bits):
            place = place + F.shiftleft(F.shiftright(ranked, bit).bitwiseAND(F.lit(1).cast("long")), bit * len(columns) + i)
    return place
