"""Silver and gold tables that follow signed changes against tables built from all rows."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemill.operators import added, signed_changes, signed_sums
from tidemill.plans import retail as r
from tidemill.streaming import gold
from tidemill.streaming.retail import StreamedState

SALES = "transaction_id string, transaction_timestamp timestamp, store_id string, product_id string, quantity int, total_amount_usd decimal(24,2), ingestion_timestamp int"
STORES = "store_id string, region string, ingestion_timestamp int"
PRODUCTS = "product_id string, product_name string, category string, brand string, ingestion_timestamp int"


class Shop:
    """Random deliveries into the three states, and the tables that follow them."""

    def __init__(self, spark, store, seed):
        self.spark, self.store, self.rng, self.time = spark, store, random.Random(seed), 0
        self.landed = {"sales": [], "stores": [], "products": []}
        shapes = {"sales": ("transaction_id", SALES), "stores": ("store_id", STORES), "products": ("product_id", PRODUCTS)}
        self.shapes = {name: shape for name, (_, shape) in shapes.items()}
        self.keys = {name: key for name, (key, _) in shapes.items()}
        self.states = {name: StreamedState(spark, f"{store}/state/{name}", [key], ["ingestion_timestamp"], spark.createDataFrame([], shape).schema)
                       for name, (key, shape) in shapes.items()}

    def put(self, name, rows, number):
        self.landed[name] += rows
        self.states[name].put(self.spark.createDataFrame(rows, self.shapes[name]), "f", number)

    def deliver(self, number, sales=12, days=6):
        pick = self.rng.choice

        def when():
            import datetime
            return pick([None] + [datetime.datetime(2025, 1 + d % 3, 1 + d, 12) for d in range(days)])
        rows = []
        for _ in range(sales):
            self.time += 1
            rows.append((pick([None] + [f"t{i}" for i in range(40)]), when(), pick(["s1", "s2", "s3", None]), pick(["p1", "p2", "p3", None]),
                         pick([None, 1, 2, 3]), None if self.rng.random() < 0.2 else self.rng.randrange(1000), self.time))
        self.put("sales", [(*x[:5], x[5] if x[5] is None else __import__("decimal").Decimal(x[5]), x[6]) for x in rows], number)
        if number == 0 or self.rng.random() < 0.4:
            self.time += 1
            self.put("stores", [(s, pick(["EAST", "WEST", None]), self.time) for s in ("s1", "s2")[: pick([1, 2])]], number)
        if number == 0 or self.rng.random() < 0.3:
            self.time += 1
            self.put("products", [(pick(["p1", "p2"]), pick(["a", "b"]), "c", None, self.time)], number)

    def tables(self):
        for state in self.states.values():
            state.advance()
        notes = gold.Notes(self.spark, f"{self.store}/built")
        sums = gold.SalesSums(notes, f"{self.store}/sums", self.states["sales"])
        silver = gold.silver_table(notes, self.store, "silver/sales", self.states["sales"])
        return {"silver": silver.drop("bucket"), **gold.gold_tables(notes, self.store, sums, self.states["stores"], self.states["products"])}

    def wanted(self):
        from tidemill.operators import scd1
        sales, stores, products = (scd1(self.spark.createDataFrame(self.landed[n], self.shapes[n]), [self.keys[n]], ["ingestion_timestamp"]) for n in self.landed)
        return {"silver": sales, "gold_daily_sales_summary": r.daily_sales(sales, stores), "gold_monthly_revenue_by_region": r.monthly_revenue(sales, stores),
                "gold_product_performance": r.product_performance(sales, products)}

    def check(self, rows):
        got, want = self.tables(), self.wanted()
        for name, df in want.items():
            assert rows(got[name], *df.columns) == rows(df), name

    def files(self):
        return {str(p.relative_to(self.store)) for layer in ("silver", "gold") for p in Path(self.store, layer).rglob("part-*")}


def test_twenty_deliveries_equal_the_full_rebuild(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(gold, "APART", 5)  # sums are added up on the way
    monkeypatch.setattr(gold, "BUCKETS", 4)
    shop = Shop(spark, str(tmp_path), 1)
    for number in range(20):
        shop.deliver(number, sales=shop.rng.choice([1, 3, 12]))
        if number % 4 == 3:
            shop.check(rows)
        else:
            shop.tables()


def test_a_run_touches_only_what_changed(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(gold, "BUCKETS", 8)
    import datetime
    from decimal import Decimal
    shop = Shop(spark, str(tmp_path), 2)
    day = [datetime.datetime(2025, 1 + m, 5) for m in range(4)]
    shop.put("stores", [(f"s{i}", "WEST", 1) for i in range(4)], 0)
    shop.put("products", [(f"p{i}", "a", "b", "c", 1) for i in range(4)], 0)
    shop.put("sales", [(f"t{i}", day[i % 4], f"s{i % 4}", f"p{i % 4}", 1, Decimal(i), 1) for i in range(40)], 0)
    shop.check(rows)

    def changed():
        before = shop.files()
        shop.check(rows)
        return {str(Path(p).parent) for p in before ^ shop.files()}

    assert changed() == set()
    shop.put("sales", [("t0", None, None, None, 5, None, 2)], 1)  # a correction of one sale of day 0
    buckets = {k: spark.createDataFrame([(k,)], "k string").select(gold.bucket("k")).first()[0] for k in ("t0", "p0", "p1", "t7")}
    assert changed() == {f"silver/sales/bucket={buckets['t0']}", "gold/gold_daily_sales_summary/sales_date=2025-01-05",
                         "gold/gold_monthly_revenue_by_region/year=2025/month=1", f"gold/gold_product_performance/bucket={buckets['p0']}"}
    shop.put("stores", [("s2", "EAST", 3)], 1)  # a store moves: its days only
    assert changed() == {"gold/gold_daily_sales_summary/sales_date=2025-03-05", "gold/gold_monthly_revenue_by_region/year=2025/month=3"}
    shop.put("products", [("p1", "new", None, None, 3)], 1)
    assert changed() == {f"gold/gold_product_performance/bucket={buckets['p1']}"}
    shop.put("sales", [(f"t{i}", day[1], None, None, None, None, 4) for i in range(3, 40, 4)], 2)  # day 3 loses all its sales
    assert {p for p in changed() if "silver" not in p} == {"gold/gold_daily_sales_summary/sales_date=2025-02-05", "gold/gold_daily_sales_summary/sales_date=2025-04-05",
                                                          "gold/gold_monthly_revenue_by_region/year=2025/month=2", "gold/gold_monthly_revenue_by_region/year=2025/month=4"}
    shop.put("sales", [("t0", None, None, None, 5, None, 2)], 3)  # a replay
    assert changed() == set()


@pytest.mark.parametrize("seed", [3, 4])
def test_runs_that_break_off_are_made_good(spark, tmp_path, rows, monkeypatch, seed):
    """Each write of a run fails once, before or after its files are there; the next run ends with equal tables."""
    from pyspark.sql.readwriter import DataFrameWriter
    shop, write = Shop(spark, str(tmp_path), seed), DataFrameWriter.parquet
    shop.deliver(0)
    shop.check(rows)
    shop.deliver(1)
    step, broken = 0, True
    while broken:
        calls = []

        def failing(self, path, *args, **kwargs):
            calls.append(path)
            if len(calls) == step + 1 and seed % 2:
                raise RuntimeError("lost before the write")
            write(self, path, *args, **kwargs)
            if len(calls) == step + 1:
                raise RuntimeError("lost after the write")
        monkeypatch.setattr(DataFrameWriter, "parquet", failing)
        try:
            shop.tables()
            broken = False
        except RuntimeError:
            step += 1
        finally:
            monkeypatch.setattr(DataFrameWriter, "parquet", write)
        if step % 6 == 5 and broken:
            shop.deliver(2 + step)  # more arrives before the next try
    assert step > 8
    shop.check(rows)


def test_signed_sums_add_up(spark, rows):
    old = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 5), ("d", 7)], "k string, v int")
    changes = signed_changes(old, new)
    assert rows(changes) == [("b", 5, 1), ("b", None, -1), ("c", 3, -1), ("d", 7, 1)]
    by, measures = {"g": "length(k)"}, {"v": ("v", "long")}
    before, after = (signed_sums(df.withColumn("sign", F.lit(1)), by, measures) for df in (old, new))
    assert rows(added(before.union(signed_sums(changes, by, measures)), ["g"])) == rows(after) == [(1, 3, 13, 3)]


@pytest.mark.parametrize("after", [False, True])
def test_a_micro_batch_that_breaks_off_is_absorbed_once(spark, tmp_path, rows, monkeypatch, after):
    """The stream stops before or after it has stored a delta, a version is made in between, and the batch comes again."""
    from tidemill.sources import file_stream
    shape = "k string, v int, seq int"
    state = StreamedState(spark, str(tmp_path / "state"), ["k"], ["seq"], spark.createDataFrame([], shape).schema)

    def run(data):
        spark.createDataFrame(data, shape).write.mode("append").parquet(str(tmp_path / "in"))
        state.absorb(file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], shape).schema, "parquet"), str(tmp_path / "cp"))
    run([("a", 1, 1), ("b", 1, 1)])
    assert state.advance() == 1
    put = StreamedState.put

    def lost(self, *args):
        if after:
            put(self, *args)
        raise RuntimeError("lost")
    monkeypatch.setattr(StreamedState, "put", lost)
    with pytest.raises(Exception, match="lost"):
        run([("b", 2, 2), ("c", 3, 2)])
    monkeypatch.undo()
    assert state.advance() == (2 if after else 1)
    run([("c", 4, 3)])
    state.advance()
    assert rows(state.current().select("k", "v")) == [("a", 1), ("b", 2), ("c", 4)]
    # All signed changes add up to the rows that are there now.
    total = state.changes(0).groupBy("k", "v").agg(F.sum("sign").alias("s")).where("s <> 0")
    assert rows(total) == [("a", 1, 1), ("b", 2, 1), ("c", 4, 1)]
