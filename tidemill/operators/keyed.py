"""A table kept in buckets of its key, so that an upsert moves its batch alone.

Each version is a folder of bucketed parquet files, one file per bucket, sorted by key. A join on the key reads the
buckets as they lie: only the batch is shuffled, into as many partitions, and every task writes the bucket that it has
read. A version counts once its row is in the log; one that broke off is written again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .upsert import upsert

_LOG = "version int, buckets int, schema_json string"


class KeyedTable:
    """Handle on one table root; ``buckets`` is how many a new table gets, some 100 MB each being a good size."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), list(keys), buckets

    def version(self) -> int:
        """The newest version, or 0 without one."""
        last = self._last()
        return last["version"] if last else 0

    def read(self) -> DataFrame:
        """The rows of the newest version, known to Spark as bucketed by key."""
        last = self._last()
        if last is None:
            raise ValueError(f"no table at {self.root}")
        schema, name = T.StructType.fromJson(json.loads(last["schema_json"])), self._name(last["version"])
        if not self.spark.catalog.tableExists(name):
            keys = ", ".join(f"`{k}`" for k in self.keys)
            self.spark.sql(f"CREATE TABLE {name} ({schema.toDDL()}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                           f"INTO {last['buckets']} BUCKETS LOCATION '{self._folder(last['version'])}'")
        return self.spark.table(name)

    def replace(self, df: DataFrame) -> int:
        """Make ``df``, which holds each key once, the next version."""
        last = self._last()
        number = last["buckets"] if last else self.buckets
        return self._write(df.repartition(number, *self.keys), number)

    def upsert(self, batch: DataFrame, on_insert: Mapping[str, Column] | None = None) -> int:
        """Insert or update by a batch that holds each key once; the table itself is not shuffled. Null keys match nothing."""
        return self._write(upsert(self.read(), batch, self.keys, on_insert, one_pass=True), self._last()["buckets"])

    def _write(self, df: DataFrame, buckets: int) -> int:
        version = self.version() + 1
        name = self._name(version)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        df.write.format("parquet").mode("overwrite").bucketBy(buckets, *self.keys).sortBy(*self.keys).option("path", self._folder(version)).saveAsTable(name)
        row = [(version, buckets, self.spark.table(name).schema.json())]
        self.spark.createDataFrame(row, _LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        return version

    def _last(self) -> dict | None:
        try:
            last = self.spark.read.schema(_LOG).parquet(f"{self.root}/log").orderBy(F.desc("version")).first()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return last.asDict()

    def _folder(self, version: int) -> str:
        return f"{self.root}/version={version}"

    def _name(self, version: int) -> str:
        # The catalog only lends Spark the bucketing; the folder is what lasts.
        return f"tidemill_{hashlib.sha256(self.root.encode()).hexdigest()[:16]}_{version}"
