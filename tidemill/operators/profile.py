"""Exact descriptive statistics of numeric, date and time columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

PERCENTS = (0.25, 0.5, 0.75)
#: Parts into which a round cuts each range that holds a wanted rank.
PARTS = 1024
_LARGEST, _SMALLEST = 1.7e308, 5e-324


def _part(v: Column, low: float, high: float) -> Column:
    """The part of low..high that holds ``v``, rising with ``v``; the ends are in different parts."""
    a, b = max(low, -_LARGEST) / 2, min(high, _LARGEST) / 2
    place = (v / 2 - a) / max(b - a, _SMALLEST) * PARTS
    inner = F.floor(F.least(F.greatest(place, F.lit(0.0)), F.lit(PARTS - 1.0))).cast("int")
    return F.when(v >= high, PARTS - 1).when(v <= low, 0).otherwise(inner)


def _ranked(df: DataFrame, values: dict[str, Column], wanted: dict[tuple[str, int], tuple[float, float]]) -> dict[tuple[str, int], float]:
    """The value at each (column, rank), ranks from 1, within the (least, largest) value of its column.

    Every round counts the rows in PARTS equal parts of each range in question, and goes on with the part that holds the
    rank, from its least to its largest value, until these are one. A task and the driver see a count per part and
    range at most, whatever the size of the data; the filter on the ranges reaches the files.
    """
    found, below = {}, dict.fromkeys(wanted, 0)
    while wanted:
        found |= {t: low for t, (low, high) in wanted.items() if low == high}
        wanted = {t: r for t, r in wanted.items() if t not in found}
        if not wanted:
            break
        ranges = sorted({(c, *r) for (c, _), r in wanted.items()})
        inside = [values[c].between(low, high) for c, low, high in ranges]
        hits = F.explode(F.array_compact(F.array(*[
            F.when(hit, F.struct(F.lit(i).alias("range"), _part(values[c], low, high).alias("part"), values[c].alias("value")))
            for i, (hit, (c, low, high)) in enumerate(zip(inside, ranges))]))).alias("h")
        counts = (df.where(reduce(lambda a, b: a | b, inside)).select(hits).groupBy("h.range", "h.part")
                  .agg(F.count(F.lit(1)).alias("n"), F.min("h.value").alias("low"), F.max("h.value").alias("high")))
        parts: list[list] = [[] for _ in ranges]
        for row in sorted(counts.collect()):  # PARTS rows per range at most.
            parts[row["range"]].append(row)
        for (c, rank), range_ in wanted.items():
            for row in parts[ranges.index((c, *range_))]:
                if below[c, rank] + row["n"] >= rank:
                    wanted[c, rank] = (row["low"], row["high"])
                    break
                below[c, rank] += row["n"]
    return found


def describe_exact(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column, one row each.

    Quartiles are exact and interpolated, yet no task holds a column and no sketch grows with the number of tasks.
    Nulls and NaN are not counted; a column without values has only nulls beside its count. The columns are written
    to the shared folder once, as each round reads them.
    """
    df = stored(df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]), "profiled")
    v = {c: F.col(c) for c in columns}
    moments = df.agg(*[
        F.struct(F.count(v[c]).alias("count"), F.avg(v[c]).alias("mean"), F.stddev_samp(v[c]).alias("std"),
                 F.min(v[c]).alias("min"), F.max(v[c]).alias("max")).alias(c)
        for c in columns
    ]).first()
    places = {(c, p): (moments[c]["count"] - 1) * p + 1 for c in columns if moments[c]["count"] for p in PERCENTS}
    wanted = {(c, rank): (moments[c]["min"], moments[c]["max"]) for (c, _), h in places.items() for rank in (math.floor(h), math.ceil(h))}
    at = _ranked(df, v, wanted)

    def quartile(c: str, p: float) -> float | None:
        if (c, p) not in places:
            return None
        h = places[c, p]
        a, b = at[c, math.floor(h)], at[c, math.ceil(h)]
        return a if a == b else a + (b - a) * (h - math.floor(h))

    names = [f"p{int(p * 100)}" for p in PERCENTS]
    rows = [(c, *moments[c][:4], *[quartile(c, p) for p in PERCENTS], moments[c]["max"]) for c in columns]
    shape = ", ".join(f"{x} double" for x in ("mean", "std", "min", *names, "max"))
    return df.sparkSession.createDataFrame(rows, f"column string, count bigint, {shape}")


def describe_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, min, quartiles and max per date or time column, one row each, as times without a zone.

    Quartiles of dates are exact, those of times to the microsecond; means are rounded to the second. Dates count from midnight.
    """
    kinds = {c: df.schema[c].dataType.typeName() for c in columns}
    micros = {"date": F.unix_date, "timestamp": F.unix_micros, "timestamp_ntz": lambda c: F.unix_micros(F.col(c).cast("timestamp"))}
    stats = describe_exact(df.select(*[micros[kinds[c]](c).alias(c) for c in columns]), columns)
    unit = F.when(F.col("column").isin([c for c in columns if kinds[c] == "date"]), F.lit(86_400_000_000.0)).otherwise(F.lit(1.0))

    def time(c: str, to: float = 1.0) -> Column:
        return F.timestamp_micros((F.round(F.col(c) * unit / to) * to).cast("long")).cast("timestamp_ntz").alias(c)

    names = [f"p{int(p * 100)}" for p in PERCENTS]
    return stats.select("column", "count", time("mean", 1e6), *[time(c) for c in ("min", *names, "max")])
