"""Source divergence audit: how far the term shares of a source stray from those of the other sources of its language.

Inside tasks everything is Arrow compute: ``ascii_lower``, ``split_pattern_regex``, ``dictionary_encode`` and a hash
``group_by`` turn batches of text into partial counts. Spark merges these by (language, source, term) and deals the
kept terms of each language into columnar shards; every shard adds its part of each divergence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .tokens import chunks

#: What stands between terms: every ASCII character that is no letter.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text that are split at a time, and partial counts that a task holds before it hands them on.
CHUNK, HELD = 1 << 21, 1 << 19
#: Counts above zero that a shard should have, and cells of the dense blocks in which it is worked through.
SHARD, BLOCK = 1 << 17, 1 << 20
SCALE = 1_000_000_000

_PARTIAL = "lang string, source string, term string, n bigint, docs bigint"
_KEYS = ["lang", "source", "term"]


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences (n) of each term and rows that hold it (docs), by language and source; the term '' has all rows of a group."""
    lang, source = batch["lang"].dictionary_encode(), batch["source"].dictionary_encode()
    width = max(len(source.dictionary), 1)
    group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
    lists = pc.split_pattern_regex(pc.ascii_lower(batch["text"]), pattern=BETWEEN)
    terms = pc.list_flatten(lists).dictionary_encode()
    inside = pa.table({"row": pc.list_parent_indices(lists), "code": terms.indices}).group_by(["row", "code"]).aggregate([([], "count_all")])
    found = pa.table({"group": group[inside["row"].to_numpy()], "code": inside["code"], "n": inside["count_all"]})
    counts = found.group_by(["group", "code"]).aggregate([("n", "sum"), ("n", "count")])
    seen, rows = np.unique(group, return_counts=True)
    where = np.concatenate([seen, counts["group"].to_numpy()])
    term = pa.concat_arrays([pa.array([""] * len(seen), terms.dictionary.type), terms.dictionary.take(counts["code"].combine_chunks())])
    table = pa.table({"lang": lang.dictionary.take(pa.array(where // width)), "source": source.dictionary.take(pa.array(where % width)), "term": term,
                      "n": np.concatenate([np.zeros(len(seen), np.int64), counts["n_sum"].to_numpy()]),
                      "docs": np.concatenate([rows, counts["n_count"].to_numpy()])})
    # Texts that begin or end between terms have left empty ones.
    return table.filter(pc.or_(pc.not_equal(table["term"], ""), pa.array(np.arange(len(table)) < len(seen))))


def _merged(parts: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(parts).group_by(_KEYS).aggregate([("n", "sum"), ("docs", "sum")])
    return summed.rename_columns([c.removesuffix("_sum") for c in summed.column_names])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term of a group and the group's rows with it; term '' counts the group's rows.

    A task adds up its batches and hands on at most HELD counts at a time. Rows meet by language and term, of which
    a task has a row per source, so a frequent term or a large source is no hot key.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for batch in chunks(batches, "text", CHUNK):
            parts.append(_counted(batch))
            if sum(map(len, parts)) > HELD:
                parts = [_merged(parts)]
                if len(parts[0]) > HELD // 2:
                    yield from parts.pop().to_batches()
        if parts:
            yield from _merged(parts).to_batches()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))])
    partial = rows.mapInArrow(count, _PARTIAL).repartition("lang", "term")
    return partial.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _shares(count: np.ndarray, total: np.ndarray | int, kinds: int, smoothing: int) -> np.ndarray:
    """1 + floor(SCALE * (count + smoothing) / (total + smoothing * kinds)), exact also where a long is too small."""
    if count.size and int(count.max()) + smoothing > np.iinfo(np.int64).max // SCALE:
        count = count.astype(object)
    return (1 + SCALE * (count + smoothing) // (total + smoothing * kinds)).astype(np.int64)


def _of_shard(cells: pa.Table, groups: pa.Table, smoothing: int, ranks: int) -> pa.Table:
    """(lang, source, part, item, value) of one shard: its part of every pair's divergence, and the first terms of each source."""
    order = groups.sort_by("source")
    sources, totals = order["source"].combine_chunks(), order["total"].to_numpy()
    kinds, all_words, size = order["kinds"][0].as_py(), order["lang_total"][0].as_py(), len(order)
    row = pc.index_in(cells["source"], sources).to_numpy()
    terms = cells["term"].combine_chunks().dictionary_encode()
    code, n, of_lang = terms.indices.to_numpy(), cells["n"].to_numpy(), cells["everywhere"].to_numpy()
    place = np.empty(len(terms.dictionary), np.int64)
    place[pc.sort_indices(terms.dictionary).to_numpy()] = np.arange(len(place))
    far = np.zeros((size, size), np.int64)
    by_code, step = np.argsort(code, kind="stable"), max(1, BLOCK // size)
    edges = np.searchsorted(code[by_code], np.arange(0, len(place) + step, step))
    for first, a, b in zip(range(0, len(place), step), edges[:-1], edges[1:]):
        block, at = np.zeros((size, min(step, len(place) - first)), np.int64), by_code[a:b]
        block[row[at], code[at] - first] = n[at]
        share = _shares(block, totals[:, None], kinds, smoothing)
        for i in range(size - 1):
            far[i, i + 1:] += np.abs(share[i + 1:] - share[i]).sum(1)
    far += far.T
    one, other = np.nonzero(~np.eye(size, dtype=bool))
    above = _shares(n, totals[row], kinds, smoothing) - _shares(of_lang, all_words, kinds, smoothing) if len(n) else np.zeros(0, np.int64)
    held = np.flatnonzero(above > 0)
    held = held[np.lexsort((place[code[held]], -above[held], row[held]))]
    starts = np.searchsorted(row[held], np.arange(size))
    held = held[np.arange(len(held)) - starts[row[held]] < ranks]
    parts = [("pair", one, sources.take(pa.array(other)), far[one, other]), ("term", row[held], terms.dictionary.take(pa.array(code[held])), above[held])]
    return pa.concat_tables([pa.table({
        "lang": pa.array([order["lang"][0].as_py()] * len(value), pa.string()), "source": sources.take(pa.array(at)).cast(pa.string()),
        "part": pa.array([part] * len(value), pa.string()), "item": item.cast(pa.string()), "value": pa.array(value, pa.int64())}) for part, at, item, value in parts])


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, smoothing: int = 5,
          ranks: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): divergences of each source from the others of its language, and its most overused terms.

    Terms are runs of ASCII letters and non-ASCII characters, A-Z lowered; a language keeps those that at least
    ``least_docs`` of its rows hold. A group's share of a term is 1 + floor(10^9 (n + smoothing) / (N + smoothing V)) with N
    its occurrences of all V kept terms. Part ``pair``: the sum of absolute differences of the shares over all kept terms,
    for each other source. Part ``term``: by how much a term's share exceeds that in the whole language, first ``ranks``.
    Ranks count from 1 by falling value, then by the item's bytes. All arithmetic is exact.

    Null texts, languages and sources are ''. A group without terms takes part with counts of 0; a language without kept
    terms has pairs of value 0; a language with one source has no rows. Repeated rows count each, an empty table gives no
    rows, other columns are not read. A text is split as a whole, so a task needs some ten times the bytes of its longest one.
    A shard holds about SHARD counts and as many rows of sources as the language has; pairs are added up per shard
    before Spark adds up the shards.
    """
    counts = stored(term_counts(docs, text, lang, source), "term-counts")
    of_term = Window.partitionBy("lang", "term")
    held = counts.where("term <> ''").withColumns({"lang_docs": F.sum("docs").over(of_term), "everywhere": F.sum("n").over(of_term)})
    cells = stored(held.where(F.col("lang_docs") >= least_docs).select(*_KEYS, "n", "everywhere"), "cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells"))
    kinds = cells.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kinds"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").fillna(0, ["total", "cells"])
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("cells").alias("cells")).join(kinds, "lang", "left").fillna(0, ["kinds"])
    langs = stored(langs.select("lang", "lang_total", "kinds", (1 + F.col("cells") / F.lit(SHARD)).cast("int").alias("shards")), "langs")
    dealt = cells.join(langs, "lang").select(*_KEYS, "n", "everywhere", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"))
    sharded = groups.join(langs, "lang").select("lang", "source", "total", "lang_total", "kinds", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))

    def work(cells: pa.Table, groups: pa.Table) -> pa.Table:
        return _of_shard(cells, groups, smoothing, ranks)

    shards = dealt.groupBy("lang", "shard").cogroup(sharded.groupBy("lang", "shard")).applyInArrow(work, "lang string, source string, part string, item string, value bigint")
    found = stored(shards, "divergences")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pairs.union(terms.select(pairs.columns))
