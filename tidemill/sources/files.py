"""Batch and streamed file reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_array import json_array_records


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; types are inferred (one more pass over the file) only without a schema."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_csv_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and every column as text."""
    text = T.StructType([T.StructField(n, T.StringType()) for n in schema.names])
    return spark.read.option("header", True).schema(text).csv(path)


def frame_from_columns(spark: SparkSession, columns: Mapping[str, Sequence], schema: T.StructType) -> DataFrame:
    """A small table from one list per column."""
    return spark.createDataFrame(list(zip(*[columns[n] for n in schema.names], strict=True)), schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


#: Closes the list a text is wrapped in; a text that ends the list itself cannot put it there.
_END = "\0end"


def _elements(text: Column) -> Column:
    """The JSON values a text holds, as text and with the closing mark; null if it is malformed."""
    return F.from_json(F.concat(F.lit("["), text, F.lit(',"\\u0000end"]')), "array<string>")


def _only(text: Column) -> Column:
    """The one JSON value a text holds, or null if it is malformed or holds more."""
    found = _elements(text)
    return F.when((F.size(found) == 2) & (F.get(found, F.lit(1)) == _END), F.get(found, F.lit(0)))


def json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Flat JSON records as text columns: an array, one object, or one object per line.

    The shape is decided for each file. A file whose lines with content are all whole objects is read by line, split among
    tasks. Of the others, one that begins with a bracket must hold one array of objects and is split as well, between objects; any
    other must hold one object and is read by one task, fractions as doubles. Everything else raises, so no record
    is lost. Names of files go to the driver, as any listing of files does.
    """
    text = T.StructType([T.StructField(n, T.StringType()) for n in schema.names])
    file, strict = F.col("_metadata.file_path"), {"mode": "FAILFAST"}
    lines = spark.read.text(path).select(file.alias("file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"), "value")
    full = F.col("value").rlike(r"\S")
    # A file of blanks alone counts as lines, of which it has none.
    shapes = lines.groupBy("file").agg(
        F.bool_and(F.when(full, F.coalesce(_only(F.col("value")).startswith("{"), F.lit(False)))).alias("by_line"),
        F.min_by(F.when(full, F.regexp_extract("value", r"\S", 0)), F.when(full, F.col("place"))).alias("first"))
    named: dict[str, list[str]] = {"lines": [], "array": [], "object": []}
    for r in shapes.collect():
        named["array" if r["by_line"] is False and r["first"] == "[" else "object" if r["by_line"] is False else "lines"].append(r["file"])

    def are(shape: str) -> Column:
        """Files of a shape, by the shorter list of names; the reader drops the others from its listing."""
        others = [name for other, names in named.items() if other != shape for name in names]
        return file.isin(named[shape]) if len(named[shape]) <= len(others) else ~file.isin(others)

    # The reader keeps numbers as written.
    records = spark.read.schema(text).options(**strict).json(path).where(are("lines"))
    if named["array"]:
        records = records.union(json_array_records(spark, path, schema, files=are("array")))
    if named["object"]:
        value, one = F.col("value"), _only(F.col("value"))
        held = spark.read.text(path, wholetext=True).where(are("object") & full).select(file.alias("file"), "value", one.alias("one"))
        bad = F.raise_error(F.concat(F.lit("neither one object, one array of objects, nor an object per line: "), F.col("file")))
        found = F.when(F.col("one").startswith("{"), F.from_json(value, text, strict)).otherwise(bad.cast(text))
        records = records.union(held.select(found.alias("r")).select("r.*"))
    return records


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv",
                files_per_batch: int | None = None, name_pattern: str | None = None) -> DataFrame:
    """A stream over the files of a folder; each file is picked up once per checkpoint."""
    reader = spark.readStream.schema(schema)
    if name_pattern:
        reader = reader.option("pathGlobFilter", name_pattern)
    if fmt == "csv":
        reader = reader.option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(path)
