"""Large JSON arrays of objects, read by many tasks.

A byte range of an array does not tell whether it starts inside a string, nor how deep. A first pass reports of every range
what it does to that state: whether its quotes are odd in number, and by how much its brackets change the depth if it starts
outside a string, and if inside. Running totals over the ranges of a file, a few numbers each, give every range the state at
its start; a second pass then cuts each range into the objects that start in it. Quotes and brackets in strings, escapes across
ranges, and objects that end in a later range are all as one reader would see them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

_QUOTE, _ESCAPE, _OPEN, _CLOSE = 34, 92, 123, 125
_DEPTH = np.zeros(256, np.int8)
_DEPTH[[91, 123]], _DEPTH[[93, 125]] = 1, -1
_BLANK = np.isin(np.arange(256), [9, 10, 13, 32])
#: Which byte may follow which outside of objects, blanks aside: 0 is any byte before a range, 1 the file's start, 2 its end.
_FOLLOWS = np.zeros((256, 256), bool)
_FOLLOWS[0] = True
for _pair in ("\x01[", "[{", "[]", "{}", "},", "}]", ",{", "]\x02"):
    _FOLLOWS[ord(_pair[0]), ord(_pair[1])] = True
#: Bytes that a task looks back at a time for escapes before its range.
_BACK = 64
#: Bytes of objects that a task hands on at a time.
_HELD = 4 << 20
#: Bytes that opening a file counts as, when ranges are dealt to tasks.
_OPENING = 64 << 10


def _escapes_before(file: pa.NativeFile, start: int) -> int:
    """How many escape characters end right before a place."""
    count = 0
    while start - count > 0:
        length = min(_BACK, start - count)
        piece = file.read_at(length, start - count - length)
        run = length - len(piece.rstrip(b"\\"))
        count += run
        if run < length:
            break
    return count


def _scan(data: np.ndarray, escapes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: whether an odd number of string quotes has come up to and with it, and its change of depth outside strings."""
    place = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data != _ESCAPE, place, -1))
    before = np.concatenate([[-1], plain[:-1]])
    run = place - 1 - before + np.where(before < 0, escapes, 0)
    odd = np.cumsum((data == _QUOTE) & (run % 2 == 0)) % 2 == 1
    return odd, _DEPTH[data]


def _objects(file: pa.NativeFile, path: str, start: int, inside: bool, depth: int, width: int) -> Iterator[bytes]:
    """The objects that start in one range, reading on for the end of the last and for what follows it."""
    at, end, size = start, start + width, file.size()
    last, last_at = (1 if start == 0 else 0), start
    begun: list[bytes] = []
    others = depth > 1  # the range starts in an object of the one before
    while at < size:
        raw = file.read_at(min(width, size - at), at)
        data = np.frombuffer(raw, np.uint8)
        odd, change = _scan(data, _escapes_before(file, at))
        outside = odd == inside
        change = np.where(outside, change, 0)
        level = depth + np.cumsum(change, dtype=np.int64)
        marks = np.flatnonzero(outside & ~_BLANK[data] & ((level <= 1) | (change == 1) & (level == 2)))
        codes, places = np.concatenate([[last], data[marks]]), np.concatenate([[last_at], at + marks])
        wrong = ~_FOLLOWS[codes[:-1], codes[1:]] & (places[:-1] < end)
        if wrong.any():
            raise ValueError(f"not an array of objects at byte {places[1:][wrong][0]} of {path}")
        stops = marks[data[marks] == _CLOSE]
        starts = marks[(data[marks] == _OPEN) & (at + marks < end)]
        if others and len(stops):
            others, stops = False, stops[1:]
        if begun:
            begun.append(raw[:stops[0] + 1] if len(stops) else raw)
            if len(stops):
                yield b"".join(begun)
                begun, stops = [], stops[1:]
        for first, stop in zip(starts, stops):
            yield raw[first:stop + 1]
        if len(starts) > len(stops):
            begun = [raw[starts[-1]:]]
        at, inside, depth = at + len(raw), bool(odd[-1]) != inside, int(level[-1])
        last, last_at = int(codes[-1]), int(places[-1])
        if last_at >= end and not begun:
            return
    if not _FOLLOWS[last, 2] and last_at < end:
        raise ValueError(f"no end of the array in {path}")


def _quoted_numbers(texts: list[bytes]) -> list[bytes]:
    """The objects with the numbers of their own fields as strings, so that no parser changes how they are written."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    odd, change = _scan(data, 0)
    change = np.where(odd, 0, change)
    bare = ~odd & (change == 0) & (np.cumsum(change, dtype=np.int64) == 1) & ~_BLANK[data] & ~np.isin(data, [_QUOTE, 44, 58])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], bare, [False]])))
    first = data[edges[::2]]
    number = ((first >= 48) & (first <= 57)) | (first == 45)
    places = edges.reshape(-1, 2)[number].ravel()
    bounds = bounds + np.searchsorted(places, bounds)
    whole = np.insert(data, places, _QUOTE).tobytes()
    return [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def array_texts(spark: SparkSession, path: str | list[str], width: int = 16 << 20, quote_numbers: bool = False, files: Column | None = None) -> DataFrame:
    """(file, value): the text of every object of the JSON arrays at ``path``, read in ranges of ``width`` bytes.

    A task reads about one whole range, or some hundreds of small files. ``quote_numbers`` turns the numbers of an object's own
    fields into strings; ``files`` is a condition on ``_metadata.file_path`` that picks files.

    The files are UTF-8 and not compressed. What is not one array of objects, unbalanced, or with wrong commas raises. A task
    holds some twenty bytes per byte of its range, and the longest object. An empty array and a file without a byte give no rows.
    """
    listed = spark.read.format("binaryFile").load(path)
    listed = (listed if files is None else listed.where(files)).select(F.col("_metadata.file_path").alias("file"), "length")
    ranges = listed.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(width).cast("long"))).alias("start"))
    # Small files share a task: opening one counts as some of its bytes.
    weight = F.least(F.lit(width), F.col("length") - F.col("start") + _OPENING)
    count = ranges.agg(F.coalesce(F.ceil(F.sum(weight) / width), F.lit(1)).cast("int")).first()[0]

    def spread(df: DataFrame) -> DataFrame:
        # A stated number of partitions is not merged, however few bytes the ranges themselves have. By hash, the ranges of a large file lie apart.
        return df.repartitionByRange(max(count, 1), F.xxhash64("file", "start"))

    def opened(address: str) -> pa.NativeFile:
        fs, name = pafs.FileSystem.from_uri(address.replace("s3a://", "s3://", 1) if address.startswith("s3a://") else address)
        return fs.open_input_file(name)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["file"]) as file:
                    data = np.frombuffer(file.read_at(min(width, row["length"] - row["start"]), row["start"]), np.uint8)
                    odd, change = _scan(data, _escapes_before(file, row["start"]))
                found = {**row, "odd": bool(odd[-1]) if len(odd) else False, "from_outside": int(change[~odd].sum()), "from_inside": int(change[odd].sum())}
                yield pa.RecordBatch.from_pylist([found])

    weighed = stored(spread(ranges).mapInArrow(weigh, "file string, length long, start long, odd boolean, from_outside long, from_inside long"), "ranges")
    # Ranges of one file, a row each: at most its bytes over the width.
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = weighed.withColumn("inside", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    change = inside.withColumn("change", F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside")))
    states = stored(change.select("file", "length", "start", "inside", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"),
                                  (F.col("inside") != F.col("odd")).alias("open"), F.sum("change").over(order).alias("after"),
                                  (F.lead("start").over(order).isNull()).alias("last")), "states")
    bad = states.where("last and (open or after <> 0)").select("file").limit(5).collect()
    if bad:
        raise ValueError("JSON ends too early or too late: " + ", ".join(r["file"] for r in bad))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(name: str, texts: list[bytes]) -> pa.RecordBatch:
            texts = _quoted_numbers(texts) if quote_numbers else texts
            return pa.RecordBatch.from_arrays([pa.array([name] * len(texts), pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], ["file", "value"])

        for batch in batches:
            for row in batch.to_pylist():
                texts, held = [], 0
                with opened(row["file"]) as file:
                    for text in _objects(file, row["file"], row["start"], row["inside"], row["depth"], width):
                        texts.append(text)
                        held += len(text)
                        if held >= _HELD:
                            yield batch_of(row["file"], texts)
                            texts, held = [], 0
                if texts:
                    yield batch_of(row["file"], texts)

    return spread(states.select("file", "start", "inside", "depth")).mapInArrow(cut, "file string, value string")


def json_array_records(spark: SparkSession, path: str | list[str], schema: T.StructType, width: int = 16 << 20, files: Column | None = None) -> DataFrame:
    """The flat objects of JSON arrays as text columns, numbers as they are written; see ``array_texts``."""
    text = T.StructType([T.StructField(n, T.StringType()) for n in schema.names])
    rows = array_texts(spark, path, width, quote_numbers=True, files=files)
    return rows.select(F.from_json("value", text, {"mode": "FAILFAST"}).alias("r")).select("r.*")
