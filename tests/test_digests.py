"""Comparison of tables by digests."""

import random
import sys
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.operators import differing_parts, differing_rows, digests, key_range
from tidemill.plans import retail as r

LEVELS = {"month": "trunc(day, 'month')", "day": "day", "range": key_range("k", 4)}


def table(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice([None, *(date(2025, 1, 1) + timedelta(days=i) for i in range(60))]), rng.choice([None, f"k{i}"]), rng.choice([None, 1, 2])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "day date, k string, v int")


@pytest.mark.parametrize("seed", range(4))
def test_planted_differences_are_named(spark, rows, seed):
    rng, left = random.Random(seed), table(seed)
    right, want = list(left), []
    for at in sorted(rng.sample(range(len(left)), 5), reverse=True):
        kind = rng.randrange(3)
        if kind == 0:  # gone
            want.append((*right.pop(at), -1))
        elif kind == 1:  # another value
            old = right[at]
            right[at] = (*old[:2], 99)
            want += [(*old, -1), (*right[at], 1)]
        else:  # twice
            right.append(right[at])
            want.append((*right[at], 1))
    rng.shuffle(right)
    got = differing_rows(frame(spark, left).repartition(3), frame(spark, right), LEVELS)
    total = {}
    for *row, sign in want:
        total[tuple(row)] = total.get(tuple(row), 0) + sign
    assert rows(got) == sorted(((*k, s) for k, s in total.items() if s), key=lambda t: tuple((v is None, str(v)) for v in t))


def test_equal_tables(spark):
    left = table(9)
    right = random.Random(1).sample(left, len(left))
    assert differing_rows(frame(spark, left), frame(spark, right).repartition(5), LEVELS).count() == 0
    assert differing_rows(frame(spark, []), frame(spark, []), LEVELS).count() == 0


def test_only_differing_parts_are_looked_into(spark, tmp_path, monkeypatch):
    """Below the first level each side is reduced to the parts that differ before it is hashed again."""
    module = sys.modules["tidemill.operators.digests"]
    left = table(3)
    day = next(r for r in left if r[0] is not None)
    right = [(*x[:2], 50) if x is day else x for x in left]
    seen, hash_parts = [], module.digests

    def counted(df, levels, sign=1):
        seen.append((len(levels), df.count()))
        return hash_parts(df, levels, sign)
    monkeypatch.setattr(module, "digests", counted)
    parts = differing_parts(frame(spark, left), frame(spark, right), LEVELS)
    assert {(p["day"], p["month"]) for p in parts.collect()} == {(day[0], day[0].replace(day=1))}
    of_month = sum(x[0] is not None and x[0].replace(day=1) == day[0].replace(day=1) for x in left)
    of_day = sum(x[0] == day[0] for x in left)
    assert seen == [(1, 300)] * 2 + [(2, of_month)] * 2 + [(3, of_day)] * 2


def test_digests_add_up(spark, rows):
    left = table(5)
    halves = [digests(frame(spark, part), {"day": "day"}) for part in (left[:100], left[100:])]
    whole = digests(frame(spark, left), {"day": "day"})
    both = halves[0].union(halves[1]).groupBy("day").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.bit_xor("mix").alias("mix"))
    assert rows(both) == rows(whole)


def test_totals_are_seen_in_the_pass_that_writes(spark, tmp_path, rows):
    sales = spark.sql("""SELECT cast(id as string) AS transaction_id, timestamp '2025-01-01 00:00:00' + make_dt_interval(id % 3) AS transaction_timestamp,
        cast(id % 4 as string) AS store_id, cast(1 as int) AS quantity, cast(id as decimal(24,2)) AS total_amount_usd FROM range(50)""")
    stores = spark.createDataFrame([("0", "A"), ("1", "B"), ("2", "A")], "store_id string, region string")
    got = r.reconcile_in_one_pass(sales, stores, str(tmp_path / "daily"))
    assert rows(got) == rows(r.reconcile(sales, r.daily_sales(sales, stores)))
    assert spark.read.parquet(str(tmp_path / "daily")).count() == 6
