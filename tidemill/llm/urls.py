"""URL filter: dated list entries become validity intervals, and captures meet those active when fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days in one time bucket of the join.
BUCKET = 32


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user and port; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(found != "", found)


def segment_of(url: Column) -> Column:
    """First path segment of a URL; null if empty."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)
    return F.when(found != "", found)


def intervals(events: DataFrame) -> DataFrame:
    """(key, action, start, stop) from dated list entries (key, day, action): each holds until the key's next one.

    ``action`` is block, allow or remove; a removal ends what was there and starts nothing. Of several entries of a
    key on one day the last in alphabetical order holds. ``stop`` is exclusive, and null while the entry stands.
    Entries with a null key, day or action are no entries.
    """
    daily = events.dropna(subset=["key", "day", "action"]).groupBy("key", "day").agg(F.max("action").alias("action"))
    following = F.lead("day").over(Window.partitionBy("key").orderBy("day"))
    return daily.select("key", "action", F.col("day").alias("start"), following.alias("stop")).where("action <> 'remove'")


def keys_of(url: Column) -> Column:
    """List keys that speak of a URL, the most specific first: host and first segment, host, then each parent domain."""
    labels = F.split(host_of(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    whole = F.when(segment_of(url).isNotNull(), F.array(F.concat(host_of(url), F.lit("/"), segment_of(url)))).otherwise(F.array().cast("array<string>"))
    return F.when(host_of(url).isNotNull(), F.concat(whole, suffixes))


def evaluate(captures: DataFrame, events: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """``captures`` with ``n_active``, ``entry``, ``action`` and ``kept``.

    A capture meets all list entries for its URL that are active on its day; the most specific decides, and a
    capture without any is kept. A null or malformed URL, or a null day, meets none. Equal captures get equal
    verdicts; empty tables stay empty; input columns with the new names are replaced.

    Every distinct pair of URL and day is judged once. The as-of join is an equi-join on key and time bucket, with
    the interval as a further condition, so a busy key is cut by time and by Spark's skew handling.
    """
    rows = captures.drop("n_active", "entry", "action", "kept")
    pairs = rows.select(F.col(url).alias("__tidemill_url"), F.col(day).alias("__tidemill_day")).distinct()
    asked = pairs.dropna().select("*", F.posexplode(keys_of(F.col("__tidemill_url"))).alias("rank", "key"))
    asked = asked.withColumn("bucket", F.floor(F.datediff("__tidemill_day", F.lit("1970-01-01")) / BUCKET))
    span = pairs.agg(F.max("__tidemill_day").alias("last"))
    active = intervals(events).crossJoin(F.broadcast(span))  # One row.
    stop = F.least(F.coalesce(F.date_sub("stop", 1), F.col("last")), F.col("last"))
    active = active.where(F.col("start") <= stop).withColumn("bucket", F.explode(F.sequence(
        F.floor(F.datediff("start", F.lit("1970-01-01")) / BUCKET), F.floor(F.datediff(stop, F.lit("1970-01-01")) / BUCKET))))
    met = asked.join(active.drop("last"), ["key", "bucket"]).where(
        (F.col("start") <= F.col("__tidemill_day")) & (F.col("stop").isNull() | (F.col("__tidemill_day") < F.col("stop"))))
    verdicts = met.groupBy("__tidemill_url", "__tidemill_day").agg(
        F.count("*").alias("n_active"), F.min_by("key", "rank").alias("entry"), F.min_by("action", "rank").alias("action"))
    joined = rows.join(verdicts, (F.col(url) == F.col("__tidemill_url")) & (F.col(day) == F.col("__tidemill_day")), "left")
    return joined.drop("__tidemill_url", "__tidemill_day").withColumns({
        "n_active": F.coalesce("n_active", F.lit(0)).cast("long"), "kept": F.coalesce(F.col("action") != "block", F.lit(True))})
