"""Trips as append-only streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.rules import observe_rules, observed_counts
from ..plans.trips import flagged_rides, rules, valid_trips
from ..sources import write_stream


def append_valid(trips: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the trips that keep the distance rule."""
    return write_stream(valid_trips(trips), checkpoint, path)


def append_valid_counted(trips: DataFrame, path: str, counts: str, checkpoint: str) -> StreamingQuery:
    """Append the trips that keep the distance rule, and what the rule kept and dropped, from one pass over each micro-batch.

    Both lie in a folder per micro-batch, ``batch=N``; one that is repeated replaces its own.
    """
    def store(batch: DataFrame, number: int) -> None:
        valid, seen = observe_rules(batch, rules())
        valid.write.mode("overwrite").parquet(f"{path}/batch={number}")
        observed_counts(batch.sparkSession, seen, rules()).coalesce(1).write.mode("overwrite").parquet(f"{counts}/batch={number}")
    return write_stream(trips, checkpoint, each_batch=store)


def append_flagged(valid: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the flagged rides of a stream of valid trips."""
    return write_stream(flagged_rides(valid), checkpoint, path)
