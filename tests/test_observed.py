"""Counts taken in the pass that writes, and keyed state that a watermark keeps small."""

import datetime

from pyspark.sql import functions as F

from tidemill.operators import observe_rules, observed_counts, rule_metrics
from tidemill.plans import trips as t
from tidemill.sources import file_stream, write_stream
from tidemill.streaming import retail, trips

TRIPS = "SELECT cast(id as double) as fare_amount, if(id % 7 = 0, null, cast(id % 5 as double)) as trip_distance FROM range({}, {})"


def test_counts_come_from_the_write_alone(spark, tmp_path, rows):
    spark.sql(TRIPS.format(0, 500)).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    rules = {**t.rules(), "dear": F.col("fare_amount") > 100}
    valid, seen = observe_rules(df, rules)
    plan = valid._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan
    spark.sparkContext.setJobGroup("counted", "one write")
    try:
        valid.write.parquet(str(tmp_path / "out"))
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
        seen.get
        assert before == len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) == 1
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    got = observed_counts(spark, seen, rules)
    assert rows(got) == rows(rule_metrics(df, rules))
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.where("trip_distance > 0 and fare_amount > 100").count()


def test_counts_of_an_empty_table(spark, tmp_path):
    empty = spark.sql(TRIPS.format(0, 0))
    assert t.write_valid(empty, str(tmp_path / "out")).collect() == [("valid_distance", 0, 0)]


def test_counts_of_each_micro_batch(spark, tmp_path, monkeypatch):
    def run():
        shape = spark.sql(TRIPS.format(0, 0)).schema
        trips.append_valid_counted(file_stream(spark, str(tmp_path / "in"), shape, "parquet"), str(tmp_path / "out"), str(tmp_path / "counts"), str(tmp_path / "cp"))

    def found():
        return sorted((r["batch"], r["kept"], r["dropped"]) for r in spark.read.parquet(str(tmp_path / "counts")).collect())
    spark.sql(TRIPS.format(0, 70)).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    spark.sql(TRIPS.format(70, 90)).write.mode("append").parquet(str(tmp_path / "in"))
    # A micro-batch that broke off after its rows were written is counted and written once.
    count = trips.observed_counts

    def lost(*_):
        raise RuntimeError("lost before the counts")
    monkeypatch.setattr(trips, "observed_counts", lost)
    try:
        run()
        raise AssertionError("the run should have failed")
    except Exception as error:
        assert "lost before the counts" in str(error)
    monkeypatch.setattr(trips, "observed_counts", count)
    run()
    kept = [spark.sql(TRIPS.format(a, b)).where("trip_distance > 0").count() for a, b in ((0, 70), (70, 90))]
    assert found() == [(0, kept[0], 70 - kept[0]), (1, kept[1], 20 - kept[1])]
    assert spark.read.parquet(str(tmp_path / "out")).count() == sum(kept)


def test_state_stays_small(spark, tmp_path):
    """Days are delivered one by one with the day before repeated: state holds some days, not all that came."""
    start, sizes = datetime.datetime(2025, 1, 1), []
    for day in range(8):
        stamp = "timestamp '{}' + make_dt_interval(0, 0, id % 1440)".format(start + datetime.timedelta(days=day))
        fresh = f"SELECT {day} * 10000 + id AS id, {stamp} AS ts FROM range(1440)"
        again = f" UNION ALL SELECT id - 10000, ts - INTERVAL 1 DAY FROM ({fresh}) WHERE hour(ts) >= 12" if day else ""
        late = " UNION ALL SELECT -1, timestamp '2024-12-01 00:00:00'" if day else ""
        spark.sql(fresh + again + late).write.mode("append").parquet(str(tmp_path / "in"))
        shape = "id long, ts timestamp"
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        query = write_stream(retail.drop_replayed(stream, ["id"], "ts", "1 day"), str(tmp_path / "cp"), str(tmp_path / "out"))
        sizes.append(query.lastProgress.stateOperators[0].numRowsTotal)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("id").distinct().count() == 8 * 1440
    assert max(sizes) <= 3 * 1440 and max(sizes[4:]) <= max(sizes[:4])
