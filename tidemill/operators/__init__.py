"""DataFrame-to-DataFrame operators."""

from .calendar import date_spine, running_total_by_year, same_day_last_year
from .checks import anomaly_records, count_check, low_volume, metric_rows
from .digests import differing_parts, differing_rows, digests, key_range
from .keyed import KeyedTable
from .latest import latest_per_key
from .layout import curve
from .profile import describe_dates, describe_exact
from .reconcile import compare_per_key, compare_totals
from .rules import drop_violations, observe_rules, observed_counts, rule_metrics, tag_rejections
from .scd1 import current_rows, fold_changes, merge_changes, scd1
from .signed import added, of_keys, signed_changes, signed_sums, total
from .upsert import upsert
from .versioned import VersionedTable

__all__ = [
    "KeyedTable", "VersionedTable", "added", "anomaly_records", "compare_per_key", "compare_totals", "count_check",
    "current_rows", "curve", "date_spine", "describe_dates", "describe_exact", "differing_parts", "differing_rows", "digests", "drop_violations", "fold_changes",
    "key_range", "latest_per_key", "low_volume", "merge_changes", "metric_rows", "observe_rules", "observed_counts", "of_keys", "rule_metrics",
    "running_total_by_year", "same_day_last_year", "scd1", "signed_changes", "signed_sums", "tag_rejections", "total", "upsert",
]
