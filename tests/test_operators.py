import random
import statistics
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill import operators as op

CHANGES = "k string, seq int, a int, b string"


def changes():
    rng = random.Random(5)
    out = [("hot", i, rng.choice([None, i]), rng.choice([None, f"v{i}"])) for i in range(200)]
    out += [(f"k{rng.randrange(30)}", i, rng.choice([None, rng.randrange(9)]), rng.choice([None, "x", "y"])) for i in range(200)]
    out += [("empty", 1, None, None), ("tie", 1, 3, "p"), ("tie", 1, 5, None), (None, 1, 7, "n")]
    return out


def newest_non_null(data):
    state = {}
    for k, seq, a, b in data:
        kept = state.setdefault(k, [None, None])
        for i, v in enumerate((a, b)):
            if v is not None and (kept[i] is None or (seq, v) > kept[i]):
                kept[i] = (seq, v)
    return sorted(((k, *[c and c[1] for c in cols]) for k, cols in state.items()), key=str)


def test_scd1_against_plain_python(spark):
    df = spark.createDataFrame(changes(), CHANGES).repartition(4)
    got = op.scd1(df, ["k"], ["seq"], ["a", "b"])
    assert sorted((tuple(r) for r in got.collect()), key=str) == newest_non_null(changes())


def test_scd1_merge_ignores_order_split_and_repetition(spark):
    data = changes()
    whole = op.fold_changes(spark.createDataFrame(data, CHANGES), ["k"], ["seq"])
    parts = [op.fold_changes(spark.createDataFrame(data[i::3], CHANGES), ["k"], ["seq"]) for i in range(3)]
    again = parts[2].unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[0])
    a, b = (op.current_rows(df, ["k"]) for df in (whole, op.merge_changes(again, ["k"])))
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_scd1_hot_key_is_reduced_before_the_shuffle(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").alias("seq"), F.col("id").alias("a")).repartition(4)
    got = op.scd1(df, ["k"], ["seq"], ["a"])
    assert got.where("k = 'hot'").first()["a"] == 19998
    assert got.count() == 13334
    assert "partial_max" in got._jdf.queryExecution().executedPlan().toString()


def test_scd1_sorts_plain_columns_and_stores_the_order_once(spark):
    """Structs of order and value are made in the aggregation, after its sort."""
    df = spark.createDataFrame(changes(), CHANGES).repartition(4)
    assert "partial_max(CASE WHEN" in op.scd1(df, ["k"], ["seq"])._jdf.queryExecution().executedPlan().toString()
    state = op.fold_changes(df, ["k"], ["seq"])
    assert [f.name for f in state.schema if f.dataType.typeName() == "struct"] == ["_at", "_own"]


def test_scd1_of_few_changes_moves_rows_once_and_as_they_are(spark):
    df = spark.createDataFrame(changes(), CHANGES).repartition(4)
    got = op.scd1(df, ["k"], ["seq"], ["a", "b"], few=True)
    assert sorted((tuple(r) for r in got.collect()), key=str) == newest_non_null(changes())
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.index("partial_max") < plan.index("Exchange hashpartitioning(k")


def test_latest_per_key_ties_and_nulls(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", None, "z"), ("b", None, "q")], "k string, ts int, v string")
    got = op.latest_per_key(df, ["k"], [F.col("ts").desc_nulls_last()])
    assert rows(got) == [("a", 1, "y"), ("b", None, "q")]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_upsert(spark, rows):
    target = spark.createDataFrame([(1, "old", "t0"), (2, "keep", "t0")], "id int, v string, created_at string")
    batch = spark.createDataFrame([(1, None), (3, "new")], "id int, v string")
    once = op.upsert(target, batch, ["id"], {"created_at": F.lit("t1")})
    assert rows(once) == [(1, None, "t0"), (2, "keep", "t0"), (3, "new", "t1")]
    twice = op.upsert(once, batch, ["id"], {"created_at": F.lit("t2")})
    assert rows(twice) == rows(once)
    assert rows(op.upsert(target, batch.limit(0), ["id"])) == rows(target)


def test_upsert_leaves_the_target_unshuffled_for_a_small_batch(spark, tmp_path):
    spark.range(1000).withColumn("v", F.lit("a")).write.parquet(str(tmp_path / "t"))
    spark.range(5).withColumn("v", F.lit("b")).write.parquet(str(tmp_path / "b"))
    target, batch = (spark.read.parquet(str(tmp_path / n)) for n in "tb")
    plan = op.upsert(target, batch, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_upsert_in_one_pass_moves_each_side_once(spark, tmp_path, rows):
    spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit("old").alias("at")).write.parquet(str(tmp_path / "t"))
    target = spark.read.parquet(str(tmp_path / "t"))
    batch = spark.range(40, 60).select(F.col("id").alias("k"), F.when(F.col("id") != 41, -F.col("id")).alias("v"))
    insert = {"at": F.lit("new")}
    want = rows(op.upsert(target, batch, ["k"], insert))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = op.upsert(target, batch, ["k"], insert, one_pass=True)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert rows(got) == want and (41, None, "old") in want and (59, -59, "new") in want
        assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_scd1_ties_keep_rows_whole(spark):
    data = [("k", 1, 2, "10.00", "a"), ("k", 1, 1, "30.00", "b"), ("k", 0, 9, "99.00", "z")]
    df = spark.createDataFrame(data, "k string, seq int, q int, p string, n string")
    columns = ["q", "p", "n"]
    first = {tuple(r) for r in op.scd1(df, ["k"], ["seq"], columns).collect()}
    again = {tuple(r) for r in op.scd1(df.orderBy("q"), ["k"], ["seq"], columns).collect()}
    assert first == again and first <= {("k", 2, "10.00", "a"), ("k", 1, "30.00", "b")}
    assert op.scd1(df, ["k"], ["seq"], columns, F.col("q")).first()["p"] == "10.00"


def test_rules_count_null_as_violation(spark, rows):
    df = spark.createDataFrame([(1.0,), (0.0,), (None,), (-1.0,)], "d double")
    rules = {"positive": F.col("d") > 0, "present": F.col("d").isNotNull()}
    assert rows(op.rule_metrics(df, rules)) == [("positive", 1, 3), ("present", 3, 1)]
    assert rows(op.drop_violations(df, rules)) == [(1.0,)]


def test_count_check(spark, rows):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert rows(op.count_check(df, "n", "count==0")) == [("n", 2, "count==0", True)]
    assert rows(op.count_check(df.limit(0), "n", "count==0")) == [("n", 0, "count==0", False)]
    assert rows(op.count_check(df, "m", "count>0", F.col("a").isNull())) == [("m", 1, "count>0", False)]
    with pytest.raises(ValueError):
        op.count_check(df, "x", "count==7")


def test_reconcile_reports_deltas(spark, rows):
    src = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    drv = spark.createDataFrame([("a", 1), ("c", 5)], "k string, v int")
    totals = op.compare_totals(src, drv, {"v": (F.sum("v"), F.sum("v"))})
    assert [(m, int(s), int(d), int(x)) for m, s, d, x in rows(totals)] == [("v", 3, 6, -3)]
    per_key = {r.k: int(r.delta) for r in op.compare_per_key(src, drv, "k", "v").collect()}
    assert per_key == {"a": 0, "b": 2, "c": -5}


def test_describe_matches_python(spark):
    rng = random.Random(3)
    data = [(rng.randrange(50) if i % 7 else None, round(rng.lognormvariate(3, 2), 2), 5, None) for i in range(4001)]
    df = spark.createDataFrame(data, "a int, b double, c int, d double").repartition(3)
    got = {r["column"]: r for r in op.describe_exact(df, ["a", "b", "c", "d"]).collect()}
    for i, name in enumerate("abc"):
        values = [r[i] for r in data if r[i] is not None]
        quartiles = statistics.quantiles(values, n=4, method="inclusive")
        assert got[name]["count"] == len(values)
        assert [got[name][p] for p in ("p25", "p50", "p75")] == pytest.approx(quartiles)
        assert (got[name]["min"], got[name]["max"]) == (min(values), max(values))
        assert got[name]["std"] == pytest.approx(statistics.stdev(values))
    assert (got["d"]["count"], got["d"]["p50"], got["d"]["mean"]) == (0, None, None)


@pytest.mark.parametrize("values", [[4], [4, 1], [4, 1, 9], [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [2] * 9 + [100]])
def test_describe_small_columns(spark, values):
    row = op.describe_exact(spark.createDataFrame([(v,) for v in values], "a int"), ["a"]).first()
    want = statistics.quantiles(values, n=4, method="inclusive") if len(values) > 1 else values * 3
    assert [row.p25, row.p50, row.p75] == pytest.approx(want)


def test_describe_dates(spark):
    times = [datetime(2025, 1, 1, 0, 0, 0, 1), datetime(2025, 1, 1, 12), datetime(1999, 12, 31, 23, 59, 59), None, datetime(2031, 5, 5)]
    days = [date(2025, 1, 1), date(2025, 1, 2), None, date(1960, 2, 29), date(2025, 1, 2)]
    df = spark.createDataFrame(list(zip(times, days, [None] * 5)), "t timestamp_ntz, d date, none date")
    got = {r["column"]: r for r in op.describe_dates(df, ["t", "d", "none"]).collect()}
    for name, values in (("t", times), ("d", [d and datetime(d.year, d.month, d.day) for d in days])):
        seconds = [(v - datetime(1970, 1, 1)) / timedelta(microseconds=1) for v in values if v]
        want = [datetime(1970, 1, 1) + timedelta(microseconds=round(q)) for q in statistics.quantiles(seconds, n=4, method="inclusive")]
        assert all(abs(got[name][p] - w) <= timedelta(microseconds=1) for p, w in zip(("p25", "p50", "p75"), want))
        assert (got[name]["count"], got[name]["min"], got[name]["max"]) == (4, min(v for v in values if v), max(v for v in values if v))
        assert abs((got[name]["mean"] - datetime(1970, 1, 1)).total_seconds() - statistics.mean(seconds) / 1e6) <= 0.5
    assert tuple(got["none"])[1:] == (0, None, None, None, None, None, None)


def test_calendar(spark):
    daily = spark.createDataFrame(
        [(date(1999, 2, 28), 5), (date(2000, 2, 28), 1), (date(2000, 2, 29), 2), (date(2000, 3, 1), 4)], "date date, v int")
    spine = op.date_spine(daily)
    assert spine.count() == 365 + 366
    ytd = {r.date: r.ytd for r in op.running_total_by_year(spine, daily, "v", "ytd").collect()}
    assert ytd[date(1999, 1, 1)] is None and ytd[date(1999, 12, 31)] == 5
    assert ytd[date(2000, 2, 29)] == 3 and ytd[date(2000, 12, 31)] == 7
    ly = {r.date: r.ly for r in op.same_day_last_year(spine, daily, "v", "ly").collect()}
    assert ly[date(2000, 2, 28)] == ly[date(2000, 2, 29)] == 5
    assert ly[date(2000, 3, 1)] is None and len(ly) == 731
