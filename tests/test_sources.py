from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemill import schemas, sources
from tidemill.session import scratch_dir

ARRAY = '[\n  {"order_id": "O1", "quantity": 2, "total_amount": 39.98},\n  {"order_id": "O2", "quantity": "abc"}\n]\n'


@pytest.mark.parametrize("text, ids", [
    (ARRAY, ["O1", "O2"]),
    ('[{"order_id": "O1"}, {"order_id": "O2"}]', ["O1", "O2"]),
    ('\n{\n  "order_id": "O1",\n  "quantity": 2\n}\n', ["O1"]),
    ('{"order_id": "O1"}', ["O1"]),
    ('{"order_id": "O1"}\n\n   \n{"order_id": "O2"}\n', ["O1", "O2"]),
    ("", []),
])
def test_json_shapes(spark, tmp_path, text, ids):
    path = tmp_path / "orders.json"
    path.write_text(text)
    got = sources.json_records(spark, str(path), schemas.ORDER_FILE)
    assert got.count() == len(ids)
    assert sorted(r.order_id for r in got.collect()) == ids
    assert got.columns == schemas.ORDER_FILE.names


@pytest.mark.parametrize("text", ['{"order_id": "O1"}\n{"order_id": \n', '{\n "order_id": "O1"\n}\n{\n "order_id": "O2"\n}\n', '[{"order_id": "O1"}, {"order_id"'])
def test_bad_json_raises(spark, tmp_path, text):
    path = tmp_path / "orders.json"
    path.write_text(text)
    with pytest.raises(Exception):
        sources.json_records(spark, str(path), schemas.ORDER_FILE).collect()


@pytest.mark.parametrize("text", [
    '  {\n  "order_id": "O1"\n  }\n  {\n  "order_id": "O2"\n  }\n', '{\n"order_id": "O1"\n},{\n"order_id": "O2"\n}',
    '{"order_id": "O1"} {"order_id": "O2"}\n{"order_id": "O3"}\n', '[{"order_id": "O1"}]\n[{"order_id": "O2"}]\n',
    '[{"order_id": "O1"}] {"order_id": "O2"}', '{"order_id": "O1"}] {"order_id": "O2"}\n', '[1, {"order_id": "O2"}]', '"x"'])
def test_json_with_more_than_one_document_raises(spark, tmp_path, text):
    (tmp_path / "o.json").write_text(text)
    with pytest.raises(Exception):
        sources.json_records(spark, str(tmp_path / "o.json"), schemas.ORDER_FILE).collect()


def test_json_shape_is_decided_for_each_file(spark, tmp_path):
    (tmp_path / "in put").mkdir()
    for name, text in {"a": '[{"order_id": "O1"},\n {"order_id": "O2"}]', "b": '{"order_id": "O3"}\n\n{"order_id": "O4"}\n',
                       "c": '{\n "order_id": "O5"\n}\n', "d": "", "e": "[]", "f f%1": '{"order_id": "O6"}'}.items():
        (tmp_path / "in put" / f"{name}.json").write_text(text)
    got = sources.json_records(spark, str(tmp_path / "in put"), schemas.ORDER_FILE)
    assert sorted(r.order_id for r in got.collect()) == [f"O{i}" for i in range(1, 7)] and got.count() == 6


@pytest.mark.parametrize("many", ["a", "b", "c"])
def test_json_files_are_picked_by_the_shorter_list_of_names(spark, tmp_path, many):
    """Files of odd names and of blanks beside many of one shape; names of many files are in no plan."""
    shapes = {"a": '[{{"order_id": "{0}"}},\n {{"order_id": "{0}+"}}]', "b": '{{"order_id": "{0}"}}\n \n{{"order_id": "{0}+"}}\n', "c": '{{\n "order_id": "{0}"\n}}\n'}
    want = []
    for shape, text in shapes.items():
        for i in range(30 if shape == many else 2):
            (tmp_path / f"{shape} {i}%20[x]{{1}}.json").write_text(text.format(f"{shape}{i}"))
            want += [f"{shape}{i}"] + ([f"{shape}{i}+"] if shape != "c" else [])
    (tmp_path / "none.json").write_text("")
    (tmp_path / "blank.json").write_text(" \n\n ")
    got = sources.json_records(spark, str(tmp_path), schemas.ORDER_FILE)
    assert sorted(r.order_id for r in got.collect()) == sorted(want)
    assert got._jdf.queryExecution().analyzed().toString().count("[x]") < 30


def test_json_keeps_numbers_as_written(spark, tmp_path):
    path = tmp_path / "o.json"
    path.write_text(ARRAY)
    got = sources.json_records(spark, str(path), schemas.ORDER_FILE).orderBy("order_id").collect()
    assert [(r.quantity, r.total_amount) for r in got] == [("2", "39.98"), ("abc", None)]


def test_json_lines_keep_every_digit_beside_other_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"order_id": "O1", "total_amount": 12345678901234567.890}\n')
    (tmp_path / "b.json").write_text('[{"order_id": "O2", "total_amount": 1.5}]')
    got = sources.json_records(spark, str(tmp_path), schemas.ORDER_FILE).collect()
    assert sorted((r.order_id, r.total_amount) for r in got) == [("O1", "12345678901234567.890"), ("O2", "1.5")]


def test_csv_inferred_declared_and_text(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("product_id,product_name,category,unit_price\n007,Pen,Office,2.50\n008,,Office,\n")
    inferred = sources.read_csv(spark, str(path))
    assert dict(inferred.dtypes)["unit_price"] == "double"
    text = sources.read_csv_text(spark, str(path), schemas.PRODUCT_FILE).collect()
    assert [(r.product_id, r.unit_price) for r in text] == [("007", "2.50"), ("008", None)]
    declared = sources.read_csv(spark, str(path), schemas.STG_PRODUCTS)
    assert dict(declared.dtypes)["unit_price"] == "decimal(18,2)"


def test_frame_from_columns(spark):
    df = sources.frame_from_columns(spark, {"b": ["x", None], "a": [1, 2]}, schemas.T.StructType(
        [schemas.T.StructField("a", schemas.T.LongType()), schemas.T.StructField("b", schemas.T.StringType())]))
    assert [tuple(r) for r in df.collect()] == [(1, "x"), (2, None)]


def test_landing_path_is_the_day_before():
    assert sources.landing_path("/x", "orders", date(2025, 3, 1)) == "/x/landing/orders/orders_20250228.json"
    assert sources.landing_path("/x", "customers", date(2025, 12, 8)).endswith("customers/customers_20251207.csv")


def test_json_sink_writes_iso_times(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, TIMESTAMP '2025-10-01 00:00:00' AS t, DATE '2025-10-01' AS d")
    sources.write_json(df, str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out")).first()[0]
    assert line == '{"id":1,"t":"2025-10-01T00:00:00.000Z","d":"2025-10-01"}'


def test_anomaly_sink_replaces_a_day(spark, tmp_path):
    out = str(tmp_path / "anomalies")
    def record(n, day):
        return spark.createDataFrame([("dq_mismatch", day, n)], "kind string, date string, fact int")
    sources.write_anomalies(record(1, "2025-12-07"), out)
    sources.write_anomalies(record(2, "2025-12-08"), out)
    sources.write_anomalies(record(3, "2025-12-07"), out)
    got = spark.read.json(out).orderBy("date").collect()
    assert [(r.kind, str(r.date), r.fact) for r in got] == [("dq_mismatch", "2025-12-07", 3), ("dq_mismatch", "2025-12-08", 2)]


def test_managed_table_append_and_drop(spark, rows):
    df = spark.createDataFrame([("AU", 1), ("UK", 2)], "country string, n int")
    sources.save_table(df, "orders_t", ["country"])
    sources.save_table(df, "orders_t", ["country"], mode="append")
    assert spark.table("orders_t").count() == 4
    assert [r[0] for r in spark.sql("SHOW PARTITIONS orders_t").collect()] == ["country=AU", "country=UK"]
    sources.drop_table(spark, "orders_t")
    sources.drop_table(spark, "orders_t")
    assert not spark.catalog.tableExists("orders_t")


def test_partitioned_write_and_log_append(spark, tmp_path):
    df = spark.range(10).withColumn("p", (F.col("id") % 2).cast("string"))
    sources.write_partitioned(df, str(tmp_path / "p"), ["p"])
    assert {x.name for x in (tmp_path / "p").iterdir() if x.is_dir()} == {"p=0", "p=1"}
    for _ in range(2):
        sources.append_rows(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 20


def test_preview_limit(spark):
    assert spark.range(100).limit(5).count() == 5


def test_scratch_lies_in_the_shared_folder(spark):
    a, b = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_scd1_ties_moves_each_line_once_and_as_it_is(spark):
    """Lines of a part lie in any task, so what a task combines of a large table is hardly less than its lines."""
    from tidemill.catalog import files
    got = files.scd1_ties(spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_partkey").distinct().count()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and plan.index("partial_max") < plan.index("Exchange hashpartitioning(part")
