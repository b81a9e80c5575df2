"""Incremental ingestion of CSV feeds whose columns change, by a schema log per feed.

The stream is one of files: each micro-batch holds the names of new files. Files of equal header are read together, all
columns as text. The log holds the columns of a feed and their types, inferred when a column first comes; later files may
add columns, leave some out, or order them otherwise. What does not fit the type of its column is kept as text in the
rescue column, so no value is lost and no file stops the feed.
"""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.retail import stamp_ingestion
from ..sources import append_rows, write_stream

RESCUED, BATCH = "_rescued", "batch"
#: Key of the rescue column for a whole line whose number of fields is not that of its header.
LINE = "_line"
_CORRUPT = "_corrupt_line"
_LOG = "position int, name string, type string, batch long"
#: Types in the order in which they are tried, and how text of each looks; the text must tell the value exactly.
_LOOKS = {
    "boolean": r"^(true|false)$",
    "bigint": r"^(0|-?[1-9][0-9]{0,18})$",
    "decimal(38,10)": r"^(?!-0(\.0*)?$)-?(0|[1-9][0-9]{0,27})(\.[0-9]{1,10})?$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?Z?$",
}


#: Bytes of the shortest and the longest such text; a line's end may follow, which a pattern's end allows.
_BYTES = {"boolean": (4, 5), "bigint": (1, 20), "decimal(38,10)": (1, 40), "date": (10, 10), "timestamp": (19, 27)}
_LINE_END = 3


def _looks(text: Column, kind: str) -> Column:
    """Whether text is written like a value of a type. The length, which costs little, refuses most of what is not."""
    least, most = _BYTES[kind]
    return F.octet_length(text).between(least, most + _LINE_END) & text.rlike(_LOOKS[kind])


def fits(text: Column, kind: str) -> Column:
    """Whether text is a value of a type, null being one of any."""
    if kind == "string":
        return F.lit(True)
    return text.isNull() | (_looks(text, kind) & text.try_cast(kind).isNotNull())


def infer_types(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The first type that all values of a text column fit, by one pass over all rows; string for a column without values."""
    if not columns:
        return {}
    some = [F.count(F.col(c)).alias(f"{i}") for i, c in enumerate(columns)]
    fit = [F.bool_and(fits(F.col(c), kind)).alias(f"{i}:{kind}") for i, c in enumerate(columns) for kind in _LOOKS]
    found = df.agg(*some, *fit).first()
    return {c: next((kind for kind in _LOOKS if found[f"{i}"] and found[f"{i}:{kind}"]), "string") for i, c in enumerate(columns)}


def header_of(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The column names of a CSV file, compressed or not: empty and repeated ones are named by their place.

    One line is read by the driver through Spark's file systems, as a listing of files is.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    file = hadoop.fs.Path(path)
    stream = file.getFileSystem(conf).open(file)
    try:
        codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
        lines = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        line = lines.readLine() or ""
    finally:
        stream.close()
    names, taken = [], {RESCUED, BATCH, _CORRUPT, "ingestion_timestamp", "ingestion_date", "source_system"}
    for i, name in enumerate(next(csv.reader([line.removeprefix("﻿")]), [])):
        name = name.strip() or f"_c{i}"
        while name.lower() in taken:
            name = f"{name}_{i}"
        taken.add(name.lower())
        names.append(name)
    return tuple(names)


class SchemaLog:
    """The columns of a feed in the order in which they came, each with its type and the micro-batch that brought it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def columns(self) -> dict[str, str]:
        try:
            rows = self.spark.read.schema(_LOG).parquet(self.path).orderBy("position").collect()  # One row per column.
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {r["name"]: r["type"] for r in rows}

    def widen(self, types: dict[str, str], batch: int) -> dict[str, str]:
        """Add columns; all columns."""
        known = self.columns()
        rows = [(len(known) + i, name, kind, batch) for i, (name, kind) in enumerate(types.items())]
        if rows:
            append_rows(self.spark.createDataFrame(rows, _LOG).coalesce(1), self.path)
        return {**known, **types}

    def schema(self) -> T.StructType:
        """The shape of the ingested table, without its micro-batch."""
        text = ", ".join([*[f"`{name}` {kind}" for name, kind in self.columns().items()], f"{RESCUED} string"])
        return T.StructType([*T.StructType.fromDDL(text).fields, T.StructField("ingestion_timestamp", T.TimestampType()),
                             T.StructField("ingestion_date", T.DateType()), T.StructField("source_system", T.StringType())])


def _texts(spark: SparkSession, files: Sequence[str], header: Sequence[str], known: dict[str, str]) -> DataFrame:
    """The rows of files of one header, as text under the names that the log has; a column that differs in case is the same."""
    shape = T.StructType([T.StructField(name, T.StringType()) for name in (*header, _CORRUPT)])
    rows = spark.read.schema(shape).options(header=True, enforceSchema=True, columnNameOfCorruptRecord=_CORRUPT).csv(list(files))
    same = {name.lower(): name for name in known}
    return rows.withColumnsRenamed({name: same[name.lower()] for name in header if name.lower() in same})


def typed(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text rows in the types of the log; misfits, and lines with fields too many or too few, go to the rescue column as JSON."""
    here = [(i, c, kind) for i, (c, kind) in enumerate(types.items()) if c in rows.columns]

    def value(text: Column, kind: str) -> Column:
        return text if kind == "string" else F.when(_looks(text, kind), text.try_cast(kind))

    # Values come first, each once; the few rows with a misfit alone pay for the map.
    read = rows.select(_CORRUPT, *[F.col(f"`{c}`").alias(f"text{i}") for i, c, _ in here], *[value(F.col(f"`{c}`"), kind).alias(f"value{i}") for i, c, kind in here])
    misfit = {c: F.col(f"text{i}").isNotNull() & F.col(f"value{i}").isNull() for i, c, kind in here if kind != "string"}
    entries = [(F.lit(c), F.when(misfit[c], F.col(f"text{i}"))) for i, c, _ in here if c in misfit]
    entries.append((F.lit(LINE), F.col(_CORRUPT)))
    kept = F.map_filter(F.create_map(*[x for pair in entries for x in pair]), lambda _, text: text.isNotNull())
    some = reduce(Column.__or__, misfit.values(), F.col(_CORRUPT).isNotNull())
    known = {c: F.col(f"value{i}") for i, c, _ in here}
    values = [known.get(c, F.lit(None).cast(kind)).alias(c) for c, kind in types.items()]
    return read.select(*values, F.when(some, F.to_json(kept)).alias(RESCUED))


def ingest_drifting(spark: SparkSession, landing: str, bronze: str, log: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Append the new files of a feed, stamped, under one folder per micro-batch; a micro-batch that is repeated replaces its own.

    ``files_per_batch`` bounds the file names that the driver holds. Files without a line add nothing.
    """
    shape = "path string, modificationTime timestamp, length long, content binary"
    # Only names are asked for, so no content is read here.
    names = spark.readStream.schema(shape).option("maxFilesPerTrigger", files_per_batch).format("binaryFile").load(landing).select("path")

    def absorb(batch: DataFrame, number: int) -> None:
        groups, tracked = defaultdict(list), SchemaLog(spark, log)
        for row in batch.orderBy("path").collect():
            groups[header_of(spark, row["path"])].append(row["path"])
        parts, types = [], tracked.columns()
        for header, files in groups.items():
            if header:
                rows = _texts(spark, files, header, types)
                types = tracked.widen(infer_types(rows, [c for c in rows.columns if c not in types and c != _CORRUPT]), number)
                parts.append((rows, header))
        if parts:
            whole = reduce(DataFrame.unionByName, [typed(rows, types) for rows, _ in parts])
            stamp_ingestion(whole).write.mode("overwrite").parquet(f"{bronze}/{BATCH}={number}")

    return write_stream(names, checkpoint, each_batch=absorb)


def read_drifting(spark: SparkSession, bronze: str, log: str) -> DataFrame:
    """The ingested rows in the present shape of the feed; columns that a row's file lacked are null."""
    return spark.read.schema(SchemaLog(spark, log).schema()).parquet(bronze).drop(BATCH)
