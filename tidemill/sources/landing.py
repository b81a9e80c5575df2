"""Daily landing files: ``<base>/landing/<feed>/<feed>_<YYYYMMDD>.<ext>``."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import process_date

# Feed -> file extension.
FEEDS = {"customers": "csv", "products": "csv", "orders": "json"}


def landing_path(base: str, feed: str, run_date: date) -> str:
    """The file a run of ``run_date`` reads: the one of the day before."""
    day = run_date - timedelta(days=1)
    return f"{base}/landing/{feed}/{feed}_{day:%Y%m%d}.{FEEDS[feed]}"


def process_dates(runs: DataFrame, run_date: Column) -> DataFrame:
    """Run date, process date in both spellings, and the file name of each feed."""
    day = process_date(run_date)
    compact = F.date_format(day, "yyyyMMdd")
    return runs.select(
        run_date.alias("run_date"), compact.alias("file_date"), F.date_format(day, "yyyy-MM-dd").alias("iso_date"),
        *[F.concat(F.lit(f"{feed}/{feed}_"), compact, F.lit(f".{ext}")).alias(f"{feed}_file")
          for feed, ext in FEEDS.items()])
