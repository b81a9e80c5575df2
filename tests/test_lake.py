from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemill.operators import VersionedTable
from tidemill.plans import lake as p

ORDERS = "order_id int, customer_id int, country string, order_date date, amount double, status string"
D1, D2 = date(2024, 8, 23), date(2024, 8, 24)
DATA = [
    (1, 9, "AU", D1, 50.0, "CREATED"), (2, 8, "AU", D2, None, None), (3, 7, "UK", D1, 950.0, "CREATED"),
    (4, 6, "UK", D2, 100.0, "DONE"), (5, 5, None, D1, 20.0, "CREATED"), (6, 4, "AU", D1, 901.0, "CREATED"),
]


@pytest.fixture
def table(spark, tmp_path):
    t = p.orders_table(spark, str(tmp_path / "orders"))
    t.create(spark.createDataFrame(DATA, ORDERS))
    return t


def states(df):
    return {r.order_id: r.status for r in df.collect()}


def test_write_and_partitions(table, rows):
    assert rows(table.read()) == rows(table.read(0))
    assert table.read().count() == 6
    assert {(r.country, r.order_date): r.rows for r in table.partitions().collect()} == {
        ("AU", D1): 2, ("AU", D2): 1, ("UK", D1): 1, ("UK", D2): 1, (None, D1): 1}
    assert table.detail().agg(F.sum("files"), F.sum("rows")).first()[1] == 6


def test_update_rewrites_only_matching_partitions(table, spark):
    table.update(*p.start_processing("AU"))
    assert states(table.read()) == {1: "PROCESSING", 2: None, 3: "CREATED", 4: "DONE", 5: "CREATED", 6: "PROCESSING"}
    assert states(table.read(0))[1] == "CREATED"
    written = spark.read.parquet(f"{table.root}/data/write=1")
    assert {(r.country, r.order_date) for r in written.collect()} == {("AU", D1)}


def test_update_of_a_null_partition(table):
    table.update(F.col("order_id") == 5, {"status": F.lit("X")}, "order_id = 5")
    assert states(table.read())[5] == "X" and table.read().count() == 6


def test_delete_keeps_nulls_and_may_empty_a_partition(table, spark):
    table.delete(*p.delete_small(101))
    assert sorted(states(table.read())) == [2, 3, 6]
    assert {r.country for r in table.partitions().collect()} == {"AU", "UK"}
    table.delete(F.col("amount") > 900, "amount > 900")
    assert sorted(states(table.read())) == [2]
    table.delete(F.lit(True), "all")
    assert table.read().count() == 0 and table.latest_version() == 3
    table.append(spark.createDataFrame(DATA[:1], ORDERS))
    assert table.read().count() == 1 and table.read(1).count() == 3


def test_script_and_history(table, spark):
    orders = spark.createDataFrame(DATA, ORDERS)
    table.update(*p.start_processing("AU"))
    table.append(p.with_payment_columns(orders))
    table.update(*p.cancel_large())
    table.delete(*p.delete_small())
    final = table.read()
    assert final.columns[-2:] == ["payment_method", "coupon_code"]
    assert final.count() == 8
    assert final.where("status = 'CANCELLED'").count() == 4
    assert final.where("payment_method = 'CARD'").count() == 4 and final.where("coupon_code IS NOT NULL").count() == 0
    assert table.read(1).columns == table.read(0).columns == ORDERS.replace(",", "").split()[::2]
    history = table.history().orderBy("version").collect()
    assert [(r.operation, r.rows_before, r.rows_after) for r in history] == [
        ("WRITE", None, 6), ("UPDATE", 6, 6), ("APPEND", 6, 12), ("UPDATE", 12, 12), ("DELETE", 12, 8)]
    with pytest.raises(ValueError):
        table.read(77)


def test_compact_and_cluster_keep_the_rows(table, spark, rows):
    for _ in range(3):
        table.append(spark.createDataFrame(DATA, ORDERS))
    before, files = rows(table.read()), table.detail().agg(F.sum("files")).first()[0]
    table.compact()
    assert rows(table.read()) == before
    assert table.detail().agg(F.sum("files")).first()[0] < files
    table.cluster("customer_id")
    assert rows(table.read()) == before
    assert rows(table.read(0)) == rows(spark.createDataFrame(DATA, ORDERS))


def test_cluster_splits_copies_of_one_customer(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["country"])
    t.create(spark.range(4000).select(
        F.lit("AU").alias("country"), F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("customer_id")))
    # Merging of small shuffle partitions would hide how the rows were ranged.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    t.cluster("customer_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    per_file = t.read(with_files=True).groupBy("file_path").count().collect()
    assert t.read().count() == 4000 and t.read().where("customer_id = 7").count() == 3000
    assert max(r["count"] for r in per_file) < 2000


def test_merge(table, spark):
    batch = spark.createDataFrame([(3, 1, "UK", D2, 1.0, "MOVED"), (7, 1, "IN", D1, 1.0, "NEW")], ORDERS)
    for _ in range(2):
        table.merge(batch, ["order_id"])
    got = {r.order_id: (r.country, r.order_date, r.status) for r in table.read().collect()}
    assert got[3] == ("UK", D2, "MOVED") and got[7] == ("IN", D1, "NEW") and len(got) == 7
    assert table.read().count() == 7


def test_filters_prune_partitions(table):
    plan = p.of_country_and_day(table.read(), "AU", "2024-08-23")._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):]
    assert "country" in filters.split("PushedFilters")[0] and "order_date" in filters.split("PushedFilters")[0]


def test_rewrites_prune_by_the_touched_partitions(table):
    table.update(*p.start_processing("AU"))
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_typed_orders_and_describe(spark, rows):
    raw = spark.createDataFrame([("28-11-2025 09:30",), ("31-11-2025 09:30",)], "order_timestamp string")
    got = p.typed_orders(raw)
    assert [(r.order_timestamp, r.order_date) for r in got.collect()] == [
        (datetime(2025, 11, 28, 9, 30), date(2025, 11, 28)), (None, None)]
    assert rows(p.describe(got)) == [(0, "order_timestamp", "timestamp"), (1, "order_date", "date")]


def test_missing_table(spark, tmp_path):
    assert not VersionedTable(spark, str(tmp_path / "none"), ["a"]).exists()


def test_create_again_keeps_old_versions(spark, tmp_path, rows):
    table = VersionedTable(spark, str(tmp_path / "t"), ["p"])
    table.create(spark.createDataFrame([(1, "a"), (2, "b")], "x int, p string"))
    table.append(spark.createDataFrame([(3, "a")], "x int, p string"))
    assert table.create(spark.createDataFrame([(9, "c")], "x int, p string")) == 2
    assert rows(table.read()) == [(9, "c")]
    assert rows(table.read(0)) == [(1, "a"), (2, "b")] and table.read(1).count() == 3


@pytest.mark.parametrize("second", ["uniform", "skewed", "text", "date"])
def test_filters_on_either_column_skip_most_files(spark, tmp_path, second):
    """Files by their recorded ranges: of 64 files along the curve a narrow filter on any of two columns touches few."""
    column = {"uniform": "cast(rand(2) * 10000 as int)", "skewed": "cast(pow(rand(2), 8) * 1000000 as int)",
              "text": "concat('k', lpad(cast(rand(2) * 10000 as int), 5, '0'))", "date": "date_add(date '2020-01-01', cast(rand(2) * 10000 as int))"}[second]
    rows = spark.sql(f"SELECT 'AU' AS country, cast(rand(1) * 10000 as int) AS a, if(id % 50 = 0, null, {column}) AS b, id FROM range(40000)")
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    t = VersionedTable(spark, str(tmp_path / "t"), ["country"])
    t.create(rows)
    t.cluster("a", "b", files=64)
    assert t.read().exceptAll(rows.select(t.read().columns)).count() == 0 and t.read().count() == 40000
    files = t.read(with_files=True).groupBy("file_path").agg(*[f(c).alias(f"{n}_{c}") for c in ("a", "b") for n, f in (("lo", F.min), ("hi", F.max))])
    files = files.collect()
    assert 50 <= len(files) <= 80
    for c in ("a", "b"):
        values = sorted(r[c] for r in rows.where(f"{c} is not null").collect())
        for at in (0.1, 0.5, 0.9):
            low, high = values[int(at * len(values))], values[int((at + 0.01) * len(values))]
            touched = [f for f in files if f[f"lo_{c}"] is not None and f[f"lo_{c}"] <= high and f[f"hi_{c}"] >= low]
            assert len(touched) <= 24, (c, at, len(touched))


def test_clustering_one_column_and_empty_tables(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["country"])
    t.create(spark.createDataFrame([], "country string, a int, b int"))
    t.cluster("a", "b")
    assert t.read().count() == 0
    t.append(spark.createDataFrame([("AU", 2, None), ("AU", None, 1), ("UK", 1, 1)], "country string, a int, b int"))
    t.cluster("a")
    t.cluster("b", "a")
    assert t.read().count() == 3
