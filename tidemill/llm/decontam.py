"""Benchmark decontamination by spaced seeds: hashes that ignore fixed positions, joined and then verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .bits import bits_of, is_set
from .tokens import ALNUM, Words, chunks, mix, randoms

#: Fixed masks: 1 takes a word into the hash, 0 ignores it. However a quarter of 8 to 13 words is replaced, one of them passes.
MASKS = ("11111", "101111", "111011", "10100111", "11001011", "11010101", "11110001")
#: Shorter items are searched for as they are, by a hash of all their words.
LEAST_WORDS = 8
#: Bits of the filter that goes to every task, whatever the size of the benchmark.
FILTER_BITS = 1 << 23


def _seeds(words: Words, masks: tuple[str, ...] = MASKS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every seed inside one row."""
    found = []
    for mask in masks:
        starts = len(words.hash) - len(mask) + 1
        if starts <= 0:
            continue
        taken = [j for j, bit in enumerate(mask) if bit == "1"]
        value = np.zeros(starts, np.uint64)
        for j, key in zip(taken, randoms(len(taken), 10 + int(mask, 2))):
            value += words.hash[j:starts + j] * key
        inside = np.flatnonzero(words.row[:starts] == words.row[len(mask) - 1:])
        found.append((mix(value[inside]), inside))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item, number, word hashes, seed hashes, their offsets) of the items that have words."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            for i in range(batch.num_rows):
                words = Words(batch["text"].slice(i, 1), ALNUM, lower=True)
                if len(words.hash):
                    value, offset = _seeds(words, MASKS if len(words.hash) >= LEAST_WORDS else ("1" * len(words.hash),))
                    yield pa.RecordBatch.from_arrays([batch["item"].slice(i, 1), pa.array([words.hash.tobytes()], pa.binary()),
                        pa.array([value.view(np.int64)], pa.list_(pa.int64())), pa.array([offset], pa.list_(pa.int64()))], ["item", "item_words", "seed", "offset"])

    kind = benchmark.schema[item].dataType.simpleString()
    cutout = benchmark.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text"))
    return cutout.mapInArrow(cut, f"item {kind}, item_words binary, seed array<bigint>, offset array<bigint>").withColumn("number", F.monotonically_increasing_id())


def _overlap(doc: np.ndarray, item: np.ndarray, shift: int, window: int, share: float) -> tuple[int, int, int] | None:
    """Range of document words that match the item at this shift but for replaced words, and the matches in it.

    The range joins all windows, of ``window`` words or the whole item if shorter, in which ``share`` of the words agree.
    """
    first, last = max(0, shift), min(len(doc), len(item) + shift)
    width = min(window, len(item))
    if last - first < width:
        return None
    same = np.concatenate([[0], np.cumsum(doc[first:last] == item[first - shift:last - shift])])
    good = np.flatnonzero(same[width:] - same[:-width] >= np.ceil(share * width - 1e-9))
    if not len(good):
        return None
    begin, end = int(good[0]), int(good[-1]) + width
    return first + begin, first + end, int(same[end] - same[begin])


def contaminations(docs: DataFrame, benchmark: DataFrame, keys: list[str], text: str = "text", item: str = "item_id", item_text: str = "text",
                   window: int = 13, share: float = 0.75) -> DataFrame:
    """One row per document and benchmark item found in it: ``keys``, item, ``start_word``, ``end_word``, ``n_match``.

    Words are runs of letters and digits, A-Z lowered. Seeds of both sides are joined on their hash; each hit gives a
    shift between document and item, and the words around it are compared: at least ``share`` of some ``window``
    words in a row (of the whole item if shorter) must agree. At the given window and share every such place is hit by a
    seed. Items under LEAST_WORDS words match where all their words agree. Null and empty texts match nothing. Repeated documents are reported for each row, repeated items for each item; of several
    places the one with most matches is given, the first of equals. Empty tables give an empty result. A passage that many
    items share makes a row for each of them and each document that holds it. Texts are read whole: a task needs some 100 bytes of
    memory per byte of its longest one.

    A filter of fixed size keeps most documents without any hit out of the shuffle; the join decides.
    """
    items = stored(_items(benchmark, item, item_text), "items")
    seeds = items.select("number", F.explode(F.arrays_zip("seed", "offset")).alias("s")).select("number", "s.seed", "s.offset")
    # Two filters over different bits of the hash: a lone seed seldom passes both.
    lengths = items.select((F.length("item_words") / 8).cast("int").alias("n")).where(F.col("n") < LEAST_WORDS).distinct().collect()  # LEAST_WORDS at most.
    masks = tuple(dict.fromkeys([*MASKS, *["1" * r.n for r in sorted(lengths)]]))
    low = bits_of(seeds, "seed", FILTER_BITS)
    high = bits_of(seeds.withColumn("high", F.shiftrightunsigned("seed", 32)), "high", FILTER_BITS)
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__tidemill_text"):
            words = Words(batch["__tidemill_text"], ALNUM, lower=True)
            value, at = _seeds(words, masks)
            hit = is_set(low, value) & is_set(high, value >> np.uint64(32))
            value, at = value[hit], at[hit]
            order = np.argsort(at, kind="stable")
            value, at = value[order].view(np.int64), at[order]
            row = words.row[at]
            rows = np.unique(row)
            if not len(rows):
                continue
            ends = np.searchsorted(row, rows, "right").astype(np.int32)
            bounds = np.concatenate([[0], ends]).astype(np.int32)
            place = at - words.of[row]
            yield pa.RecordBatch.from_arrays(
                [batch[k].take(pa.array(rows)) for k in keys]
                + [pa.array([words.hash[words.of[r]:words.of[r + 1]].tobytes() for r in rows], pa.binary()),
                   pa.ListArray.from_arrays(pa.array(bounds), pa.array(value)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(place))],
                [*keys, "doc_words", "seed", "place"])

    given = docs.select(*keys, F.col(text).cast("string").alias("__tidemill_text"))
    hits = stored(given.mapInArrow(scan, f"{kinds}, doc_words binary, seed array<bigint>, place array<bigint>").withColumn("doc", F.monotonically_increasing_id()), "hits")
    each = hits.select("doc", F.explode(F.arrays_zip("seed", "place")).alias("s")).select("doc", "s.seed", "s.place")
    shifts = each.join(seeds, "seed").select("doc", "number", (F.col("place") - F.col("offset")).alias("shift")).distinct()

    def verify(doc_words: pa.Array, item_words: pa.Array, shift: pa.Array) -> pa.Array:
        rows = []
        for d, i, s in zip(doc_words, item_words, shift.to_pylist()):
            found = _overlap(np.frombuffer(d.as_buffer(), np.uint64), np.frombuffer(i.as_buffer(), np.uint64), s, window, share)
            rows.append(found and {"start_word": found[0], "end_word": found[1], "n_match": found[2]})
        return pa.array(rows, pa.struct([(n, pa.int64()) for n in ("start_word", "end_word", "n_match")]))

    check = F.arrow_udf(verify, "struct<start_word:bigint,end_word:bigint,n_match:bigint>")
    compared = shifts.join(items.select("number", F.col("item").alias("__tidemill_item"), "item_words"), "number").join(hits.drop("seed", "place"), "doc")
    found = compared.withColumn("o", check("doc_words", "item_words", "shift")).where("o is not null")
    best = found.groupBy("doc", "number").agg(F.first("__tidemill_item").alias(item), *[F.first(k).alias(k) for k in keys if k != item],
        F.max(F.struct("o.n_match", (-F.col("o.start_word")).alias("start"), (-F.col("o.end_word")).alias("end"))).alias("o"))
    return best.select(*[k for k in keys if k != item], item, (-F.col("o.start")).alias("start_word"), (-F.col("o.end")).alias("end_word"), "o.n_match")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; decided by text, so ids may be null or repeated."""
    digest = "__tidemill_digest"
    marked = docs.withColumn(digest, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    found = contaminations(marked, benchmark, [digest], text, **options).select(digest).distinct()
    return marked.join(found, digest, "left_anti").drop(digest)
