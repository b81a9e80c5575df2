"""A partitioned parquet table with numbered versions.

Layout under the root folder:

* ``data/write=K/<partitions>`` - the files one commit wrote, never changed;
* ``manifest/version=N`` - which partitions of which write make up version N,
  with their row counts;
* ``history/version=N`` - one row: operation, predicate, row counts, schema.

A commit writes data, manifest and history in that order, so a version is
visible only once it is whole. Updates and deletes first find the partitions
that hold a matching row and rewrite only those; every other partition is
carried over by its manifest row. One writer at a time is assumed.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .layout import curve
from .upsert import upsert

_HISTORY = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("operation", T.StringType()),
    T.StructField("predicate", T.StringType()),
    T.StructField("rows_before", T.LongType()),
    T.StructField("rows_after", T.LongType()),
    T.StructField("writes", T.ArrayType(T.IntegerType())),
    T.StructField("schema_json", T.StringType()),
])


_FILE = ("file_path", "file_size")


def _schema_of(entry) -> T.StructType:
    return T.StructType.fromJson(json.loads(entry["schema_json"]))


class VersionedTable:
    """Handle on one table root; holds no state but the path and the partition columns."""

    def __init__(self, spark: SparkSession, root: str, partition_by: Sequence[str]):
        self.spark, self.root, self.partition_by = spark, root.rstrip("/"), list(partition_by)

    # Reading -----------------------------------------------------------------

    def _entry(self, version: int | None):
        log = self.spark.read.schema(_HISTORY).parquet(f"{self.root}/history")
        if version is not None:
            log = log.where(F.col("version") == version)
        entry = log.orderBy(F.col("version").desc()).first()
        if entry is None:
            raise ValueError(f"no such version: {version}")
        return entry

    def exists(self) -> bool:
        try:
            self._entry(None)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def latest_version(self) -> int:
        return self._entry(None)["version"]

    def schema(self, version: int | None = None) -> T.StructType:
        return _schema_of(self._entry(version))

    def manifest(self, version: int | None = None) -> DataFrame:
        """Partition values, the write that holds them, and their row count."""
        return self._manifest(self._entry(version))

    def read(self, version: int | None = None, with_files: bool = False) -> DataFrame:
        """The rows of a version, the newest by default.

        The semi join is on partition columns only, so it prunes folders, and
        filters on partition columns reach the scan.
        """
        return self._read(self._entry(version), _FILE if with_files else ())

    def _manifest(self, entry) -> DataFrame:
        # Picked by a filter rather than by path: pruning folders by a join asks for a filtered side.
        schema = _schema_of(entry)
        shape = T.StructType([schema[c] for c in self.partition_by] + [
            T.StructField("rows", T.LongType()), T.StructField("write", T.IntegerType()),
            T.StructField("version", T.IntegerType())])
        stored = self.spark.read.schema(shape).parquet(f"{self.root}/manifest")
        return stored.where(F.col("version") == entry["version"]).drop("version")

    def _read(self, entry, about_file: Sequence[str] = ()) -> DataFrame:
        schema = _schema_of(entry)
        if not entry["writes"]:
            about = [T.StructField(c, T.StringType() if c == "file_path" else T.LongType()) for c in about_file]
            return self.spark.createDataFrame([], T.StructType(schema.fields + about))
        full = T.StructType(schema.fields + [T.StructField("write", T.IntegerType())])
        rows = (self.spark.read.schema(full).option("basePath", f"{self.root}/data")
                .parquet(*[f"{self.root}/data/write={w}" for w in entry["writes"]]))
        rows = rows.select(*schema.names, "write", *[F.col(f"_metadata.{c}") for c in about_file])
        # A version made of its own write alone has nothing to sieve out.
        if entry["writes"] != [entry["version"]]:
            live = self._manifest(entry)
            match = self._same_partition(rows, live) & (rows["write"] == live["write"])
            rows = rows.join(live, match, "left_semi")
        return rows.drop("write")

    def _same_partition(self, a: DataFrame, b: DataFrame) -> Column:
        # Plain equality with a stand-in for null; a null-safe comparison would not prune folders.
        def key(df: DataFrame, c: str) -> Column:
            return F.coalesce(df[c].cast("string"), F.lit("\0"))
        return reduce(lambda m, n: m & n, [key(a, c) == key(b, c) for c in self.partition_by])

    def history(self) -> DataFrame:
        return self.spark.read.schema(_HISTORY).parquet(f"{self.root}/history").drop("writes", "schema_json")

    def partitions(self, version: int | None = None) -> DataFrame:
        """Partition values and row counts, from the manifest alone."""
        return self.manifest(version).groupBy(*self.partition_by).agg(F.sum("rows").alias("rows"))

    def detail(self, version: int | None = None) -> DataFrame:
        """Files, bytes and rows of each partition."""
        return self._detail(self._entry(version))

    def _detail(self, entry) -> DataFrame:
        per_file = self._read(entry, _FILE).groupBy(*self.partition_by, "file_path").agg(
            F.first("file_size").alias("file_size"), F.count(F.lit(1)).alias("rows"))
        return per_file.groupBy(*self.partition_by).agg(
            F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"), F.sum("rows").alias("rows"))

    # Writing -----------------------------------------------------------------

    def create(self, df: DataFrame) -> int:
        """Write the table; an existing one gets a new version with these rows alone, and keeps its older versions."""
        before = self._entry(None) if self.exists() else None
        return self._commit("WRITE", None, self._spread(df), df.schema, kept=None, before=before)

    def append(self, df: DataFrame) -> int:
        """Add rows; new columns join the schema and read as null in older rows."""
        before = self._entry(None)
        schema = _schema_of(before)
        added = [f for f in df.schema.fields if f.name not in schema.names]
        merged = T.StructType(schema.fields + added)
        rows = df.select(*[
            F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in merged.fields])
        return self._commit("APPEND", None, self._spread(rows), merged, self._manifest(before), before)

    def update(self, where: Column, values: Mapping[str, Column], label: str) -> int:
        """Set columns where the predicate is true; a null predicate changes nothing."""
        before = self._entry(None)
        touched = self._read(before).where(where)
        return self._replace("UPDATE", label, before, touched, lambda rows: rows.select(*[
            F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in rows.columns]))

    def delete(self, where: Column, label: str) -> int:
        """Drop rows where the predicate is true; a null predicate keeps the row."""
        before = self._entry(None)
        touched = self._read(before).where(where)
        return self._replace("DELETE", label, before, touched,
                             lambda rows: rows.where(~F.coalesce(where, F.lit(False))))

    def merge(self, batch: DataFrame, keys: Sequence[str], on_insert: Mapping[str, Column] | None = None) -> int:
        """Upsert a batch that holds each key once; partitions without one of its keys are left alone."""
        before = self._entry(None)
        # Read four times below, and each time it must be the same rows.
        incoming = f"{self.root}/incoming/version={before['version'] + 1}"
        batch.write.mode("overwrite").parquet(incoming)
        batch = self.spark.read.schema(batch.schema).parquet(incoming)
        touched = self._read(before).join(batch.select(*keys), list(keys), "left_semi")
        return self._replace("MERGE", ", ".join(keys), before, touched,
                             lambda rows: upsert(rows, batch, keys, on_insert))

    def compact(self) -> int:
        """Rewrite partitions whose rows come from several files into fewer files."""
        before = self._entry(None)
        return self._replace("OPTIMIZE", None, before, self._detail(before).where("files > 1"), lambda rows: rows)

    def cluster(self, *columns: str, files: int | None = None) -> int:
        """Rewrite every partition in ranges of a column, or along a curve through several, so file statistics can skip on each.

        The place of a row in its old file ends the range key: rows that share
        the columns' values, even whole copies, can then go to several tasks. ``files`` is how many ranges there are.
        """
        before = self._entry(None)
        rows = self._read(before, ("file_path", "row_index"))
        along = "_curve"
        rows = rows.withColumn(along, F.col(columns[0]) if len(columns) == 1 else curve(rows, columns))
        order = [*self.partition_by, along]
        keys = [*order, F.xxhash64("file_path", "row_index")]
        ranged = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
        return self._commit("CLUSTER", ", ".join(columns), ranged.sortWithinPartitions(*order).drop("file_path", "row_index", along), _schema_of(before), None, before)

    def _spread(self, df: DataFrame) -> DataFrame:
        # Rebalancing gathers each partition's rows but splits one that is too large for a task.
        return df.hint("rebalance", *self.partition_by)

    def _replace(self, operation: str, label: str | None, before, touched: DataFrame, change) -> int:
        """Rewrite the partitions the touched rows lie in and keep the others."""
        version = before["version"] + 1
        # One row per partition, the size of a partition listing; stored because it is used twice.
        touched = touched.select(*self.partition_by).distinct()
        touched.write.mode("overwrite").parquet(f"{self.root}/touched/version={version}")
        stored = T.StructType(touched.schema.fields + [T.StructField("version", T.IntegerType())])
        touched = self.spark.read.schema(stored).parquet(f"{self.root}/touched").where(F.col("version") == version)
        rows, manifest = self._read(before), self._manifest(before)
        rows = rows.join(touched, self._same_partition(rows, touched), "left_semi")
        kept = manifest.join(touched, self._same_partition(manifest, touched), "left_anti")
        return self._commit(operation, label, self._spread(change(rows)), _schema_of(before), kept, before)

    def _commit(self, operation: str, label: str | None, rows: DataFrame, schema: T.StructType,
                kept: DataFrame | None, before) -> int:
        version = 0 if before is None else before["version"] + 1
        target = f"{self.root}/data/write={version}"
        rows.write.mode("overwrite").partitionBy(*self.partition_by).parquet(target)
        added = (self.spark.read.schema(schema).parquet(target).groupBy(*self.partition_by)
                 .agg(F.count(F.lit(1)).alias("rows")).withColumn("write", F.lit(version)))
        manifest = added if kept is None else kept.unionByName(added)
        path = f"{self.root}/manifest/version={version}"
        manifest.coalesce(1).write.mode("overwrite").parquet(path)
        total = self.spark.read.schema(manifest.schema).parquet(path).agg(
            F.sum("rows").alias("rows"), F.array_sort(F.collect_set("write")).alias("writes")).first()
        entry = [(version, operation, label, None if before is None else before["rows_after"],
                  total["rows"] or 0, total["writes"], schema.json())]
        (self.spark.createDataFrame(entry, _HISTORY).drop("version")
         .coalesce(1).write.mode("overwrite").parquet(f"{self.root}/history/version={version}"))
        return version
