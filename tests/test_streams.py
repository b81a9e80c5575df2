import random

import pytest

from tidemill import schemas
from tidemill.operators import scd1
from tidemill.plans import retail as r
from tidemill.sources import file_stream, write_stream
from tidemill.streaming import ingest, retail, trips

CHANGES = "k string, seq int, a int, b string"


def land(df, path, files):
    df.repartition(files).write.mode("append").parquet(path)


def test_ingestion_picks_up_each_file_once(spark, tmp_path):
    landing, bronze, checkpoint = (str(tmp_path / n) for n in ("in", "bronze", "cp"))
    names = schemas.STORE_FEED.names
    def deliver(i):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"s{i}.csv").write_text(",".join(names) + f"\n00{i},Shop,,CA,USA,West\n")
    for i in (1, 2):
        deliver(i)
    ingest.ingest(spark, landing, bronze, checkpoint, schemas.STORE_FEED)
    ingest.ingest(spark, landing, bronze, checkpoint, schemas.STORE_FEED)
    assert spark.read.parquet(bronze).count() == 2
    deliver(3)
    ingest.ingest(spark, landing, bronze, checkpoint, schemas.STORE_FEED)
    got = spark.read.parquet(bronze)
    assert sorted(x.store_id for x in got.collect()) == ["001", "002", "003"]
    row = got.first()
    assert row.source_system == "us_retail_csv" and row.city is None
    assert row.ingestion_timestamp is not None and row.ingestion_date is not None
    assert any(p.name.startswith("ingestion_date=") for p in (tmp_path / "bronze").iterdir())


def test_three_feeds(spark, tmp_path):
    for feed, schema in (("sales", schemas.SALES_FEED), ("products", schemas.PRODUCT_FEED), ("stores", schemas.STORE_FEED)):
        (tmp_path / "in" / feed).mkdir(parents=True)
        (tmp_path / "in" / feed / "a.csv").write_text(",".join(schema.names) + "\n" + ",".join("1" for _ in schema.names) + "\n")
    ingest.ingest_all(spark, str(tmp_path / "in"), str(tmp_path / "bronze"), str(tmp_path / "cp"))
    for name in ingest.FEEDS:
        assert spark.read.parquet(str(tmp_path / "bronze" / name)).count() == 1


@pytest.mark.parametrize("files", [1, 5])
def test_streamed_state_equals_batch(spark, tmp_path, files, rows):
    rng = random.Random(files)
    data = [(f"k{rng.randrange(20)}", i, rng.choice([None, i]), rng.choice([None, "x", "y"])) for i in range(300)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, CHANGES)
    land(df, str(tmp_path / "in"), files)
    state = retail.StreamedState(spark, str(tmp_path / "state"), ["k"], ["seq"])
    def run():
        state.absorb(file_stream(spark, str(tmp_path / "in"), df.schema, "parquet", files_per_batch=2), str(tmp_path / "cp"))
    run()
    want = rows(scd1(df, ["k"], ["seq"]))
    assert rows(state.current()) == want
    run()
    assert rows(state.current()) == want
    state.compact()
    assert rows(state.current()) == want
    more = spark.createDataFrame([("k1", 999, 999, None), ("late", -5, 1, "z"), ("k2", -7, -7, "older")], CHANGES)
    land(more, str(tmp_path / "in"), 1)
    run()
    want = rows(scd1(df.unionByName(more), ["k"], ["seq"]))
    assert rows(state.current()) == want
    state.compact()
    assert rows(state.current()) == want


def test_replayed_batch_changes_nothing(spark, tmp_path, rows):
    df = spark.createDataFrame([("k", 1, 1, "x"), ("k", 2, None, "y")], CHANGES)
    land(df, str(tmp_path / "in"), 1)
    state = retail.StreamedState(spark, str(tmp_path / "state"), ["k"], ["seq"])
    for checkpoint in ("cp1", "cp2"):  # a lost checkpoint replays everything
        state.absorb(file_stream(spark, str(tmp_path / "in"), df.schema, "parquet"), str(tmp_path / checkpoint))
    assert rows(state.current()) == [("k", 2, 1, "y")]


def test_redelivery_within_the_watermark(spark, tmp_path):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2025-01-01 00:00:00'), (1, TIMESTAMP '2025-01-01 00:05:00'), "
                   "(2, TIMESTAMP '2025-01-01 00:00:00') AS t(id, ingestion_timestamp)")
    land(df, str(tmp_path / "in"), 1)
    deduped = retail.drop_replayed(file_stream(spark, str(tmp_path / "in"), df.schema, "parquet"), ["id"])
    write_stream(deduped, str(tmp_path / "cp"), str(tmp_path / "out"))
    assert sorted(x.id for x in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_streamed_quarantine_equals_batch(spark, tmp_path, rows):
    feed = spark.createDataFrame([("t1", "2025-01-01", "S", "P", q, "1", None, "1", c)
                                  for q, c in (("0", "USD"), ("1", "JPY"), ("1", "USD"), ("2", "EUR"))], schemas.SALES_FEED)
    land(feed, str(tmp_path / "in"), 2)
    staged = r.stage_sales(file_stream(spark, str(tmp_path / "in"), feed.schema, "parquet"))
    for _ in range(2):
        retail.append_quarantine(staged, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(r.quarantine(r.stage_sales(feed)))


def test_trip_streams_chain(spark, tmp_path):
    df = spark.sql("SELECT TIMESTAMP '2024-01-02 00:00:00' AS tpep_pickup_datetime, 1 AS pickup_zip, 1 AS dropoff_zip, "
                   "CAST(id * 10 AS DOUBLE) AS fare_amount, CAST(id AS DOUBLE) AS trip_distance FROM range(10)")
    land(df, str(tmp_path / "in"), 2)
    trips.append_valid(file_stream(spark, str(tmp_path / "in"), df.schema, "parquet"), str(tmp_path / "valid"), str(tmp_path / "cp1"))
    assert spark.read.parquet(str(tmp_path / "valid")).count() == 9
    valid = file_stream(spark, str(tmp_path / "valid"), df.schema, "parquet")
    trips.append_flagged(valid, str(tmp_path / "flagged"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "flagged")).count() == 4


def test_two_checkpoints_keep_both_feeds(spark, tmp_path, rows):
    state = retail.StreamedState(spark, str(tmp_path / "state"), ["k"], ["seq"], spark.createDataFrame([], CHANGES).schema)
    assert state.current().count() == 0
    for name in ("a", "b"):
        df = spark.createDataFrame([(name, 1, 1, name)], CHANGES)
        land(df, str(tmp_path / name), 1)
        state.absorb(file_stream(spark, str(tmp_path / name), df.schema, "parquet"), str(tmp_path / f"checkpoint-{name}"))
    assert rows(state.current()) == [("a", 1, 1, "a"), ("b", 1, 1, "b")]
    state.compact()
    assert state.current().count() == 2
