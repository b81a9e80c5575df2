"""Files written and read back, and type-1 state over rows of equal sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import scd1
from ..session import scratch_dir
from ..sources import append_rows, json_records, read_csv, read_csv_text, table, write_json

_PART = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()),
                      T.StructField("p_size", T.IntegerType()), T.StructField("p_retailprice", T.DoubleType())])


def json_landing(spark: SparkSession, d: str) -> DataFrame:
    """Orders landed in one folder as lines, as arrays of up to 500 and as single objects over several lines."""
    work, key = scratch_dir(spark, "json"), F.col("o_orderkey")
    orders = table(spark, d, "orders").select("o_orderkey", F.struct(
        key.alias("order_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"), F.col("o_orderstatus").alias("status")).alias("r"))
    write_json(orders.where(key % 2 == 1).select("r.*"), f"{work}/lines")
    even = orders.where(key % 2 == 0)
    arrays = even.where(key % 500 != 0).groupBy(F.floor(key / 1000)).agg(F.to_json(F.collect_list("r")).alias("value"))
    alone = even.where(key % 500 == 0).select(F.to_json("r", {"pretty": "true"}).alias("value"))
    for name, texts in (("arrays", arrays), ("objects", alone)):
        texts.select("value").write.option("maxRecordsPerFile", 1).text(f"{work}/{name}")
    back = json_records(spark, f"{work}/*", T.StructType([T.StructField(c, T.StringType()) for c in ("order_id", "total", "status")]))
    return back.withColumn("total", F.col("total").cast("decimal(18,2)"))


def _parts_file(spark, d) -> str:
    path = scratch_dir(spark, "csv")
    table(spark, d, "part").select(*_PART.names).write.option("header", True).csv(path)
    return path


def log_append(spark, d):
    """Orders appended to a log in two goes."""
    path, orders = scratch_dir(spark, "log"), table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    early = F.col("o_orderdate") < F.lit("1995-01-01").cast("date")
    for part in (early, ~early):
        append_rows(table(spark, d, "orders").where(part).select(*orders.columns), path)
    return spark.read.schema(orders.schema).parquet(path)


def scd1_ties(spark, d):
    """Type-1 state per part where the year is the sequence, so that most rows tie; the line decides."""
    li = table(spark, d, "lineitem")
    rows = li.select(
        F.col("l_partkey").alias("part"), F.year("l_shipdate").alias("year"), F.struct(*_LINE).alias("line"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_discount") > 0.05, F.concat("l_returnflag", "l_linestatus")).alias("status"),
        F.col("l_extendedprice").alias("price"))
    # A part has some thirty lines, however many there are in all, and they lie anywhere: combining them ahead of the shuffle sorts all lines for little.
    return scd1(rows, ["part"], ["year"], ["year", "quantity", "status", "price"], F.col("line"), few=True)


_LINE = ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

QUERIES = {
    "json_landing": json_landing,
    "csv_declared": lambda s, d: read_csv(s, _parts_file(s, d), _PART),
    "csv_inferred": lambda s, d: read_csv(s, _parts_file(s, d)),
    "csv_text": lambda s, d: read_csv_text(s, _parts_file(s, d), _PART).select("p_partkey", "p_name", "p_size"),
    "log_append": log_append,
    "scd1_ties": scd1_ties,
}

# SQL ---------------------------------------------------------------------------

ORACLE = {
    "json_landing": """SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_totalprice AS DECIMAL(18,2)) AS total,
  o_orderstatus AS status FROM orders""",
    "csv_declared": "SELECT p_partkey, p_name, p_size, p_retailprice FROM part",
    "csv_inferred": "SELECT p_partkey, p_name, p_size, p_retailprice FROM part",
    "csv_text": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size FROM part",
    "log_append": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "scd1_ties": f"""WITH ranked AS (SELECT *, row_number() OVER (
  PARTITION BY l_partkey ORDER BY year(l_shipdate) DESC, {', '.join(c + ' DESC' for c in _LINE)}) AS place FROM lineitem)
SELECT l_partkey AS part, CAST(arg_min(year(l_shipdate), place) AS INTEGER) AS year,
  arg_min(l_quantity, place) FILTER (WHERE l_returnflag <> 'R') AS quantity,
  arg_min(l_returnflag || l_linestatus, place) FILTER (WHERE l_discount > 0.05) AS status,
  arg_min(l_extendedprice, place) AS price
FROM ranked GROUP BY l_partkey""",
}
