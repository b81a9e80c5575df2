"""Streamed type-1 tables and the streamed quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.scd1 import current_rows, fold_changes, merge_changes
from ..operators.signed import of_keys, signed_changes
from ..plans.retail import quarantine
from ..session import stored
from ..sources import append_rows, remove_folder, write_stream


def drop_replayed(bronze: DataFrame, keys: Sequence[str], time: str = "ingestion_timestamp",
                  delay: str = "1 day") -> DataFrame:
    """Drop exact redeliveries that arrive within the watermark's delay."""
    return bronze.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


_LOG = "step int, version int, generation int, deltas array<string>"
#: So many state rows may send their keys to all tasks.
_SMALL = 1 << 20


class StreamedState:
    """Type-1 state of keyed streams, kept as one folded delta per micro-batch.

    A batch is reduced to one row per key and written to ``generation=G/feed=ID/batch=N``, where ID is the stream's id in
    its checkpoint; nothing already stored is read or rewritten, and a second feed or a new checkpoint has its own
    folder. Reading merges the deltas. As the merge ignores order and repetition, a replayed batch (same folder,
    overwritten) or late files leave the same result. With ``shape``, the schema of the changes, a state without
    deltas reads as an empty table.

    ``advance`` turns the deltas that came since the last version into the next one and stores what it changed as signed
    rows: the old and the new row of every key that is not what it was. Only changed keys are merged, and the
    keys of small news go to all tasks, so that the rest is not shuffled. The whole state is folded into one delta, the first of a
    new generation, once the others have grown to a good part of the largest, or by ``compact``. A delta alone is not merged.
    One row of the log, written last, makes a version or a generation count; what broke off before is done again.
    ``few`` says that keys have few changes each, see ``operators.scd1``.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], sequence_by: Sequence[str],
                 shape: T.StructType | None = None, few: bool = False):
        self.spark, self.root, self.shape, self.few = spark, root.rstrip("/"), shape, few
        self.keys, self.sequence_by = list(keys), list(sequence_by)

    def absorb(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run the stream of changes into the state."""
        known = []

        def store(batch: DataFrame, number: int) -> None:
            if not known:  # the checkpoint holds the id before the first batch
                known.append(self.spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"])
            self.put(batch, known[0], number)
        return write_stream(changes, checkpoint, each_batch=store)

    def put(self, changes: DataFrame, feed: str, number: int) -> None:
        """Store one batch of changes; the same feed and number again replace it."""
        fold_changes(changes, self.keys, self.sequence_by, few=self.few).write.mode("overwrite").parquet(
            f"{self._folder(self._last())}/feed={feed}/batch={number}")

    def current(self, where: Column | None = None) -> DataFrame:
        """The rows of all deltas; ``where`` is a condition on keys, met before they are merged."""
        deltas = self._deltas(self._last())
        return current_rows(self._merged(deltas if where is None else deltas.where(where)), self.keys)

    def version(self) -> int:
        """How often ``advance`` has found news."""
        return self._last()["version"]

    def changes(self, after: int, until: int | None = None) -> DataFrame:
        """The signed rows of the versions above ``after``, up to ``until``, with their ``version``."""
        rows = self.spark.read.schema(self._change_shape()).parquet(f"{self.root}/changes").where(F.col("version") > after)
        return rows if until is None else rows.where(F.col("version") <= until)

    def advance(self) -> int:
        """Make a version of the deltas that came since the last one, if any; the version."""
        last = self._last()
        deltas = self._deltas(last)
        sizes = {r["delta"]: r["count"] for r in deltas.groupBy("delta").count().collect()}  # One per micro-batch.
        waiting = sorted(set(sizes) - set(last["deltas"]))
        if not waiting:
            return last["version"]
        number, fresh = last["version"] + 1, F.col("delta").isin(waiting)
        if last["deltas"]:
            news = deltas.where(fresh).drop("delta")
            keys = stored(news.select(*self.keys).distinct(), "changed-keys")
            old = of_keys(deltas.where(~fresh).drop("delta"), F.broadcast(keys) if sum(sizes[d] for d in waiting) <= _SMALL else keys)
            rows = signed_changes(*[current_rows(merge_changes(df, self.keys, self.few), self.keys) for df in (old, old.unionByName(news))])
        else:
            rows = current_rows(self._merged(deltas), self.keys).withColumn("sign", F.lit(1))
        rows.write.mode("overwrite").parquet(f"{self.root}/changes/version={number}")
        self._note({**last, "version": number, "deltas": [*last["deltas"], *waiting]})
        largest = max(sizes.values())
        if last["deltas"] and 2 * (sum(sizes.values()) - largest) > largest:
            self._fold()
        return number

    def compact(self) -> None:
        """Advance, and fold all deltas into the first of the next generation."""
        generation = self._last()["generation"]
        self.advance()
        if self._last()["generation"] == generation:
            self._fold()

    def _fold(self) -> None:
        # The generation before stays for those who still read it.
        last = self._last()
        number = last["generation"] + 1
        self._merged(self._deltas(last)).write.mode("overwrite").parquet(f"{self._folder({'generation': number})}/feed=folded/batch=0")
        self._note({**last, "generation": number, "deltas": ["folded/0"]})
        remove_folder(self.spark, self._folder({"generation": number - 2}))

    def _change_shape(self) -> T.StructType:
        columns = [f for f in self.shape.fields if f.name in self.keys] + [f for f in self.shape.fields if f.name not in self.keys]
        return T.StructType([*columns, T.StructField("sign", T.IntegerType()), T.StructField("version", T.IntegerType())])

    def _deltas(self, at: dict) -> DataFrame:
        """All deltas of a generation, with their name ``delta``."""
        try:
            deltas = self.spark.read.parquet(self._folder(at))
        except AnalysisException as missing:  # no change yet
            if missing.getCondition() != "PATH_NOT_FOUND" or self.shape is None:
                raise
            return fold_changes(self.spark.createDataFrame([], self.shape), self.keys, self.sequence_by).withColumn("delta", F.lit(""))
        return deltas.withColumn("delta", F.concat_ws("/", "feed", "batch")).drop("feed", "batch")

    def _merged(self, deltas: DataFrame) -> DataFrame:
        """One state row per key; a single delta has that already."""
        alone = len({path.rsplit("/", 1)[0] for path in deltas.inputFiles()}) == 1
        return deltas.drop("delta") if alone else merge_changes(deltas.drop("delta"), self.keys, self.few)

    def _last(self) -> dict:
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.root}/log").orderBy(F.desc("step")).first().asDict()
        except AnalysisException as missing:  # no version yet
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return {"step": 0, "version": 0, "generation": 0, "deltas": []}

    def _note(self, entry: dict) -> None:
        row = (entry["step"] + 1, entry["version"], entry["generation"], entry["deltas"])
        append_rows(self.spark.createDataFrame([row], _LOG).coalesce(1), f"{self.root}/log")

    def _folder(self, at: dict) -> str:
        return f"{self.root}/generation={at['generation']}"


def append_quarantine(staged: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append rejected rows with their reason; tagging and filtering hold no state."""
    return write_stream(quarantine(staged), checkpoint, path)
