"""Column expressions, all evaluated inside the JVM."""

from .money import discount_percent, effective_price, fx_rate_to_usd
from .numbers import exact_mean, round_decimal, safe_divide, to_int_half_even, try_number
from .text import blank_to, clean_name, mismatched_currency
from .times import as_date, as_timestamp, process_date

__all__ = [
    "as_date", "as_timestamp", "blank_to", "clean_name", "discount_percent",
    "effective_price", "exact_mean", "fx_rate_to_usd", "mismatched_currency",
    "process_date", "round_decimal", "safe_divide", "to_int_half_even", "try_number",
]
