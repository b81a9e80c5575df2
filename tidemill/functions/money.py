"""Prices, promotions and currency rates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Promotion code -> percent off, currency -> rate to USD.
PROMO_PERCENT = {"DISC10": 10, "DISC5": 5}
USD_RATES = {"USD": "1.0", "INR": "0.012", "EUR": "1.10", "GBP": "1.25"}

_RATE_TYPE = "decimal(10,4)"


def _lookup(key: Column, table: dict, dtype: str) -> Column:
    """Value of a fixed table; a map names the key once, so pushing a filter down does not copy it per entry."""
    entries = [part for name, value in table.items() for part in (F.lit(name), F.lit(value).cast(dtype))]
    return F.try_element_at(F.create_map(*entries), key)


def discount_percent(promo: Column) -> Column:
    """Percent off for a promotion code; unknown and missing codes give 0."""
    return F.coalesce(_lookup(promo, PROMO_PERCENT, "int"), F.lit(0))


def effective_price(total: Column, percent: Column) -> Column:
    """Total after a percentage discount (10 means ten percent off)."""
    return total * (F.lit(1) - percent.cast("decimal(5,2)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(5,4)")


def fx_rate_to_usd(currency: Column) -> Column:
    """Decimal rate to USD; null for a currency without a rate."""
    return _lookup(currency, USD_RATES, _RATE_TYPE)
