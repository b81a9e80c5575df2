"""Text cleaning."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_name(c: Column) -> Column:
    """First letter of each word upper case, the rest lower case."""
    return F.initcap(c)


def blank_to(c: Column, default: str) -> Column:
    """Replace an empty or missing value by a default."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def mismatched_currency(c: Column, expected: str = "USD") -> Column:
    """True where the currency, whatever its case, is not the expected one."""
    return F.upper(c) != expected
