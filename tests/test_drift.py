"""CSV feeds whose columns change."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidemill.streaming import drift


class Feed:
    def __init__(self, spark, root):
        self.spark, self.root = spark, root
        (root / "in").mkdir()

    def put(self, name, text):
        data = text.encode()
        (self.root / "in" / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)

    def run(self, files=1000):
        drift.ingest_drifting(self.spark, str(self.root / "in"), str(self.root / "out"), str(self.root / "log"), str(self.root / "cp"), files)
        got = drift.read_drifting(self.spark, str(self.root / "out"), str(self.root / "log"))
        return got.drop("ingestion_timestamp", "ingestion_date", "source_system")


def test_columns_added_dropped_moved_and_retyped(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.put("1.csv", "id,amount,day,code,note\n1,10.50,2025-01-01,007,\n2,3,2025-01-02,12,hi\n")
    got = feed.run()
    assert got.dtypes == [("id", "bigint"), ("amount", "decimal(38,10)"), ("day", "date"), ("code", "string"), ("note", "string"), ("_rescued", "string")]
    feed.put("2.csv", "note,ID,amount,day,code\nx,3,4,2025-01-03,1\n")
    feed.put("3.csv.gz", 'id,channel,day,amount\nfour,web,2025-02-30,1.12345678901\n5,"a,b",,7\n6,x,2025-01-06,8,extra\n7,y\n')
    got = feed.run()
    rows = {r["id"]: r for r in got.collect() if r["id"] is not None}
    assert got.columns == ["id", "amount", "day", "code", "note", "channel", "_rescued"] and got.count() == 7
    assert (str(rows[3]["amount"]), rows[3]["note"], rows[3]["code"], rows[3]["channel"], rows[3]["_rescued"]) == ("4.0000000000", "x", "1", None, None)
    assert rows[5]["channel"] == "a,b" and rows[5]["day"] is None and rows[5]["_rescued"] is None
    bad = got.where("id is null").first()
    assert json.loads(bad["_rescued"]) == {"id": "four", "day": "2025-02-30", "amount": "1.12345678901"} and bad["channel"] == "web"
    assert json.loads(rows[6]["_rescued"]) == {"_line": "6,x,2025-01-06,8,extra"} and json.loads(rows[7]["_rescued"]) == {"_line": "7,y"}


@pytest.mark.parametrize("files", [1, 2, 1000])
def test_no_value_is_lost_however_files_fall_into_batches(spark, tmp_path, files):
    feed, want = Feed(spark, tmp_path), []
    columns = [["a", "b"], ["b", "a", "c"], ["c", "a"], ["A", "", "B"], ["a", "b"]]
    values = [["1", "x"], ["2", "3", "true"], ["no", "zwei"], ["5", "0x1", "2025-01-01"], ["-0", "99999999999999999999"]]
    for i, (names, row) in enumerate(zip(columns, values)):
        feed.put(f"{i}.csv", ",".join(names) + "\n" + (",".join(row) + "\n") * (i + 1))
        want += [sorted(row)] * (i + 1)
    got = feed.run(files)
    texts = [F.regexp_replace(F.col(f"`{c}`").cast("string"), r"\.0{10}$" if kind.startswith("decimal") else "$x", "").alias(c) for c, kind in got.dtypes]
    found = []
    for r in got.select(*texts).collect():
        rescued = list(json.loads(r["_rescued"]).values()) if r["_rescued"] else []
        found.append(sorted([v for c, v in r.asDict().items() if c != "_rescued" and v is not None] + rescued))
    assert sorted(found) == sorted(want)
    assert feed.run(files).count() == len(want)  # nothing twice


def test_a_repeated_batch_replaces_itself(spark, tmp_path, monkeypatch):
    feed = Feed(spark, tmp_path)
    feed.put("1.csv", "a,b\n1,x\n")
    write, calls = drift.stamp_ingestion, []

    def lost(df):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost after the log")
        return write(df)
    monkeypatch.setattr(drift, "stamp_ingestion", lost)
    with pytest.raises(Exception, match="lost after the log"):
        feed.run()
    assert [tuple(r) for r in feed.run().collect()] == [(1, "x", None)]
    assert drift.SchemaLog(spark, str(tmp_path / "log")).columns() == {"a": "bigint", "b": "string"}


def test_odd_files(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.put("0.csv", "")
    feed.put("1.csv", "a,a,_rescued,batch\n")
    feed.put("2.csv", "﻿a,a,_rescued,batch\n1,2,3,4\n")
    got = feed.run()
    assert [tuple(r) for r in got.collect()] == [(1, 2, 3, 4, None)]
    assert got.columns == ["a", "a_1", "_rescued_2", "batch_3", "_rescued"]


def test_typing_reads_each_value_once_in_generated_code(spark, tmp_path):
    """No rescue map for rows without a misfit: it stands behind a condition, above values that generated code has made."""
    text = "day string, n string, amount string, seen string, ok string, note string, _corrupt_line string"
    types = {"day": "date", "n": "bigint", "amount": "decimal(38,10)", "seen": "timestamp", "ok": "boolean", "note": "string", "late": "date"}
    data = [("2025-01-01", "-7", "1.50", "2025-01-01T01:02:03.123456Z", "true", "x", None), (None,) * 7,
            ("2025-02-30", "99999999999999999999", "-" + "9" * 28 + "." + "9" * 10, "2025-01-01 01:02:03", "false", "", None),
            ("2025-01-01\n", "-9223372036854775808\r\n", "0." + "1" * 11, "2025-01-01", "TRUE", "z", None), ("", "0", "-0", "now", "tru", None, "a,b")]
    rows = spark.createDataFrame(data, text).repartition(2)
    got = {r["n"]: r for r in drift.typed(rows, types).collect()}
    assert [c for c, _ in drift.typed(rows, types).dtypes] == [*types, "_rescued"]
    assert str(got[-7]["amount"]) == "1.5000000000" and got[-7]["seen"].microsecond == 123456 and got[-7]["_rescued"] is None
    assert got[-(1 << 63)]["day"].isoformat() == "2025-01-01"
    rescued = [json.loads(r["_rescued"]) for r in drift.typed(rows, types).collect() if r["_rescued"]]
    assert sorted(rescued, key=str) == sorted([
        {"day": "2025-02-30", "n": "99999999999999999999"}, {"amount": "0." + "1" * 11, "seen": "2025-01-01", "ok": "TRUE"},
        {"day": "", "amount": "-0", "seen": "now", "ok": "tru", "_line": "a,b"}], key=str)
    # Two projections: the map cannot be part of generated code, so the patterns are not in its projection.
    plan = drift.typed(rows, types)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    upper, lower = (i for i, x in enumerate(plan.splitlines()) if "Project [" in x)
    assert upper < lower and "value0" in plan.splitlines()[upper] and "text0" in plan.splitlines()[lower]


@pytest.mark.parametrize("kind, least, most", [
    ("boolean", "true", "false"), ("bigint", "0", "-9223372036854775808"), ("decimal(38,10)", "5", "-" + "9" * 28 + "." + "9" * 10),
    ("date", "2025-01-01", "2025-01-01"), ("timestamp", "2025-01-01 01:02:03", "2025-01-01T01:02:03.123456Z")])
def test_length_refuses_no_value(spark, kind, least, most):
    ends = ["", "\n", "\r\n", "\u2028", "\u0085"]
    rows = spark.createDataFrame([(x + end,) for x in (least, most) for end in ends], "x string")
    assert rows.where(F.col("x").rlike(drift._LOOKS[kind]) & ~drift._looks(F.col("x"), kind)).count() == 0
    assert rows.where(drift._looks(F.col("x"), kind)).count() >= 2
