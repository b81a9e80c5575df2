"""Timestamps, dates and the process date."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_timestamp(c: Column, dtype: T.DataType | None = None, pattern: str | None = None) -> Column:
    """Timestamp from text, null where it cannot be parsed; typed times pass unchanged."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c
    return F.try_to_timestamp(c, F.lit(pattern)) if pattern else F.try_to_timestamp(c)


def as_date(c: Column) -> Column:
    """Date from text, null where it cannot be parsed."""
    return c.try_cast("date")


def process_date(run_date: Column) -> Column:
    """The day whose files a run handles: the day before the run."""
    return F.date_sub(run_date, 1)
