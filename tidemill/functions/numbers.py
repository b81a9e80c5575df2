"""Number parsing, rounding and aggregates that do not depend on row order."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def try_number(c: Column, dtype: str = "double") -> Column:
    """Parse a number; text that is not one becomes null."""
    return c.try_cast(dtype)


def to_int_half_even(c: Column) -> Column:
    """Integer nearest to a double, ties to the even neighbour."""
    return F.bround(c).try_cast("int")


def round_decimal(c: Column, digits: int) -> Column:
    """Round half up on the decimal value, so 1.005 does not depend on its double form."""
    return F.round(c.cast("decimal(28,8)"), digits)


def exact_mean(c: Column, dtype: str = "decimal(18,4)") -> Column:
    """Mean from an exact decimal sum: the same bits however the rows are partitioned."""
    return F.try_divide(F.sum(c.cast(dtype)).cast("double"), F.count(c).cast("double"))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))
