"""Latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """Keep one row per key: the first under ``newest_first``.

    All remaining columns follow as descending tie-breaks, so equal sequence
    values still give one reproducible answer. The ``row_number() = 1`` filter
    becomes a group limit before the shuffle: each map task sends at most one
    row per key, which is what keeps a very frequent key harmless.
    """
    ties = [F.col(c).desc_nulls_last() for c in df.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*newest_first, *ties)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
