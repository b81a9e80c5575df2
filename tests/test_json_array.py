"""JSON arrays split among tasks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemill import schemas
from tidemill.sources import json_array
from tidemill.sources.json_array import array_texts, json_array_records

TRICKY = ['a"b', "\\", '\\"', "}{][,", "", " ", "é 日", "\\\\\\", '"', "\n\t", '[{"x":1}]', "x" * 300]


def objects(seed, n):
    rng = random.Random(seed)
    return [{rng.choice(TRICKY) + str(j): rng.choice([*TRICKY, 1, -2.50, None, True, [1, {"y": rng.choice(TRICKY)}], {}]) for j in range(rng.randrange(4))} for _ in range(n)]


@pytest.mark.parametrize("indent,ascii_only", [(None, True), (1, False), (None, False)])
@pytest.mark.parametrize("width", [1, 7, 64, 1000, 1 << 20])
def test_any_range_gives_the_same_objects(tmp_path, indent, ascii_only, width):
    """Every range cut by itself, from the state that one reader would have there."""
    import pyarrow.fs as pafs
    want = objects(width, 12 if width < 64 else 60)
    text = ("\n " + json.dumps(want, indent=indent, ensure_ascii=ascii_only) + " \n").encode()
    path = tmp_path / "a.json"
    path.write_bytes(text)
    states, inside, escaped, depth = [], False, False, 0
    for byte in text:
        states.append((inside, depth))
        char = chr(byte)
        if inside:
            inside, escaped = (char != '"' or escaped), (char == "\\" and not escaped)
        else:
            inside = char == '"'
            depth += (char in "[{") - (char in "]}")
    got = []
    with pafs.LocalFileSystem().open_input_file(str(path)) as file:
        for start in range(0, len(text), width):
            got += [json.loads(t) for t in json_array._objects(file, "a", start, *states[start], width)]
    assert got == want


@pytest.mark.parametrize("width", [50, 333, 1 << 20])
def test_files_of_several_ranges(spark, tmp_path, width):
    want = {}
    for i in range(3):
        want[f"f{i}.json"] = objects(10 + i, [0, 1, 70][i])
        (tmp_path / f"f{i}.json").write_text(json.dumps(want[f"f{i}.json"], indent=i or None))
    got = {name: [] for name in want}
    for r in array_texts(spark, str(tmp_path), width).collect():
        got[r["file"].rsplit("/", 1)[1]].append(json.loads(r["value"]))
    for name, rows in want.items():
        assert sorted(map(str, got[name])) == sorted(map(str, rows))


@pytest.mark.parametrize("text", [" ", "{}", '[{"a":1}', '[{"a":1}}', '[{"a":1},]', "[,{}]", '[{"a":1}{"a":2}]', "[{},,{}]", "[1]", '["a"]', "[[{}]]", '[{"a":"b]', "[{}] {}", "[{}]]", "[{}],", '{"a":[{}]}', "[{]", "null"])
@pytest.mark.parametrize("width", [3, 1000])
def test_what_is_no_array_of_objects_raises(spark, tmp_path, text, width):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="not an array of objects|JSON ends too|no end of the array"):
        array_texts(spark, str(tmp_path), width).collect()


def test_numbers_stay_as_written(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"order_id": 1.10, "quantity": 12345678901234567890, "status": "x"}, {"total_amount":-1e5,"currency": null, "more": 3, "product_id": true, "customer_id": "7, 8.50"}]')
    got = json_array_records(spark, str(tmp_path), schemas.ORDER_FILE, 20).collect()
    rows = sorted(((r["order_id"], r["quantity"], r["total_amount"], r["status"], r["currency"], r["product_id"], r["customer_id"]) for r in got), key=str)
    assert rows == [("1.10", "12345678901234567890", None, "x", None, None, None), (None, None, "-1e5", None, None, "true", "7, 8.50")]


def test_quoting_changes_numbers_alone():
    rng, want = random.Random(3), objects(5, 40)
    numbers = [b"-1", b"0", b"1.50", b"2E+9"]
    texts = [json.dumps(x).encode()[:-1] + (b", " if x else b"") + b'"n" : ' + rng.choice(numbers) + b"}" for x in want]
    for text, quoted in zip(texts, json_array._quoted_numbers(texts)):
        before, after = json.loads(text, parse_int=str, parse_float=str), json.loads(quoted, parse_int=str, parse_float=str)
        assert before == after and isinstance(json.loads(quoted)["n"], str)
    assert json_array._quoted_numbers([]) == []


def test_a_large_array_is_read_by_many_tasks(spark, tmp_path):
    row = '{{"order_id": "{0}", "quantity": {0}.50, "status": "a \\"quoted\\" [text], {{no}} object {1}"}}'
    with open(tmp_path / "big.json", "w") as file:
        file.write("[")
        for i in range(300_000):
            file.write((",\n" if i else "") + row.format(i, "é" * (i % 50)))
        file.write("]")
    rows = json_array_records(spark, str(tmp_path), schemas.ORDER_FILE, 2 << 20)
    tasks = rows.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= 8 and sum(r["count"] for r in tasks) == 300_000
    found = rows.agg(F.count_distinct("order_id"), F.count_if(F.col("quantity") == F.concat("order_id", F.lit(".50"))), F.sum(F.length("status"))).first()
    assert tuple(found) == (300_000, 300_000, sum(len('a "quoted" [text], {no} object ') + i % 50 for i in range(300_000)))


def test_small_files_share_tasks(spark, tmp_path):
    """Three hundred files of some bytes are read by one task, beside a large one that is split."""
    for i in range(300):
        (tmp_path / f"s{i}.json").write_text(json.dumps([{"order_id": f"{i}"}]))
    (tmp_path / "big.json").write_text(json.dumps([{"order_id": "big", "status": "x" * 1000}] * 40_000))
    small = json_array_records(spark, str(tmp_path), schemas.ORDER_FILE, files=F.col("_metadata.file_path").contains("/s"))
    assert small.rdd.getNumPartitions() <= 2 and sorted(int(r["order_id"]) for r in small.collect()) == list(range(300))
    rows = json_array_records(spark, str(tmp_path), schemas.ORDER_FILE)
    assert 3 <= rows.rdd.getNumPartitions() <= 6 and rows.count() == 40_300
    tasks = rows.where("order_id = 'big'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 3
