"""Upserts into bucketed tables: results, plans and files."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import KeyedTable, upsert

SHAPE = "k string, a int, b string, created_at int"


def batch(rng, n, keys):
    rows = {f"k{rng.randrange(keys)}": (rng.choice([None, rng.randrange(9)]), rng.choice([None, "x", "y"])) for _ in range(n)}
    return [(k, *v) for k, v in rows.items()]


def test_upserts_equal_plain_ones(spark, tmp_path, rows):
    rng, table = random.Random(1), KeyedTable(spark, str(tmp_path / "t"), ["k"], 5)
    assert table.version() == 0
    with pytest.raises(ValueError):
        table.read()
    want = spark.createDataFrame([(*r, 0) for r in batch(rng, 30, 50)], SHAPE)
    table.replace(want)
    for turn in range(1, 5):
        news = spark.createDataFrame(batch(rng, 12, 60), "k string, a int, b string")
        want = spark.createDataFrame(upsert(want, news, ["k"], {"created_at": F.lit(turn)}).collect(), SHAPE)
        assert table.upsert(news, {"created_at": F.lit(turn)}) == turn + 1
        assert rows(table.read()) == rows(want)
    # Another handle, as of another session, finds the same rows and the same buckets.
    for version in range(1, 6):
        spark.sql(f"DROP TABLE {table._name(version)}")
    again = KeyedTable(spark, str(tmp_path / "t"), ["k"])
    assert rows(again.read()) == rows(want)
    assert again.upsert(spark.createDataFrame([("k0", 1, "z")], "k string, a int, b string")) == 6
    assert len(list((tmp_path / "t" / "version=6").glob("part-*"))) == 5  # one file a bucket


def test_two_columns_as_key_and_other_bucket_numbers(spark, tmp_path, rows):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k", "j"], 3)
    table.replace(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, j int, v string"))
    table.upsert(spark.createDataFrame([("a", 2, "z"), ("b", 1, None)], "k string, j int, v string"))
    assert rows(table.read()) == [("a", 1, "x"), ("a", 2, "z"), ("b", 1, None)]


@pytest.mark.parametrize("buckets", [3, 16])
def test_only_the_batch_is_shuffled(spark, tmp_path, buckets):
    """Broadcasts off: one exchange, and it is above the batch; with fewer buckets than shuffle partitions, and with more."""
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets)
    table.replace(spark.range(1000).selectExpr("cast(id as string) as k", "id as v"))
    before = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        news = spark.range(500, 1500).selectExpr("cast(id as string) as k", "-id as v")
        plan = upsert(table.read(), news, ["k"], one_pass=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    lines = plan.splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange" in line]
    scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    assert len(exchanges) == 1 and exchanges[0] > scan and "Range (500, 1500" in "".join(lines[exchanges[0]:])


def test_a_version_that_broke_off_is_written_again(spark, tmp_path, rows, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 2)
    table.replace(spark.createDataFrame([("a", 1)], "k string, v int"))
    news = spark.createDataFrame([("b", 2)], "k string, v int")
    monkeypatch.setattr(spark, "createDataFrame", lambda *a: (_ for _ in ()).throw(RuntimeError("lost before the log")))
    with pytest.raises(RuntimeError):
        table.upsert(news)
    monkeypatch.undo()
    assert rows(table.read()) == [("a", 1)] and table.version() == 1
    assert table.upsert(news) == 2
    assert rows(table.read()) == [("a", 1), ("b", 2)]
