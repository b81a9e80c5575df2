"""Quality rules: distribution divergence of a document from its language.

The counts of a text are taken by one vectorised pass; references, distances and verdicts are DataFrame work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .tokens import ALNUM, LOWER, SPACED, Words, chunks, mix, utf8

# Frequent function words of four languages.
COMMON = {
    "en": "the of and to in is that it was for on are with as be this by from or an have not at which they".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}
#: Every listed word once, in order; the last bin of the word histogram is any other word.
WORDS = sorted({w for words in COMMON.values() for w in words})
# Classes of characters, by leading byte.
CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "latin", "other")
_STOPS = b".,;:!?'\"()-"
_SYMBOLS = b"#*$%&|<>"


def _class_of(byte: int) -> int:
    char = chr(byte)
    if byte >= 128:
        return -1 if byte < 0xC0 else 6 if byte < 0xD0 else 7
    if char.isalpha():
        return 0 if char.islower() else 1
    return 2 if char.isdigit() else 3 if byte in (32, 9, 10, 11, 12, 13) else 4 if byte in _STOPS else 5


_CLASS = np.array([_class_of(b) for b in range(256)], np.int8)
_NOT_NEWLINE = np.arange(256) != 10
_IS_SYMBOL = np.isin(np.arange(256), list(_SYMBOLS))
_LEADS = (np.arange(256) & 0xC0) != 0x80

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_TYPE = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ",classes:array<bigint>,common:array<bigint>>"


def _twice(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether its key occurs in its row again, and whether it did so before."""
    both = key ^ mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    again, before = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:][same]] = True
    before[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, before


def _counts(texts: pa.Array) -> list[np.ndarray]:
    """The five counts and the two histograms of each text."""
    data, bounds = utf8(texts)
    n = len(texts)
    words = Words(texts)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[bounds[1:]] - total[bounds[:-1]]

    chars = per_row(_LEADS[data] & SPACED[data])
    symbols = per_row(_IS_SYMBOL[data])
    lines = Words(texts, _NOT_NEWLINE)
    filled = np.searchsorted(words.start, lines.start) < np.searchsorted(words.start, lines.end)
    row = lines.row[filled]
    _, before = _twice(row, lines.hash[filled])
    dup_lines = np.bincount(row[before], minlength=n)
    covered = np.zeros(len(words.hash), bool)
    if len(words.hash) >= 3:
        whole = np.flatnonzero(words.row[:-2] == words.row[2:])
        key = mix(words.hash[whole] + np.uint64(3) * mix(words.hash[whole + 1] + np.uint64(5) * mix(words.hash[whole + 2])))
        again, _ = _twice(words.row[whole], key)
        for j in range(3):
            covered[whole[again] + j] = True
    repeats = np.bincount(words.row[covered], minlength=n)
    kinds = _CLASS[data]
    classes = np.stack([per_row(kinds == k) for k in range(len(CLASSES))], 1)
    plain = Words(texts, ALNUM, lower=True)
    listed = Words(pa.array(WORDS), ALNUM, lower=True).hash
    rank = np.argsort(listed)
    place = np.minimum(np.searchsorted(listed[rank], plain.hash), len(WORDS) - 1)
    found = np.where(listed[rank][place] == plain.hash, rank[place], len(WORDS))
    bins = len(WORDS) + 1
    common = np.bincount(plain.row * bins + found, minlength=n * bins).reshape(n, bins)
    return [words.count, chars, symbols, dup_lines, repeats, classes, common]


def counted(text: Column) -> Column:
    """The counts of a text as a struct: COUNTS, then both histograms. Null counts as an empty text."""
    def count(texts: pa.Array) -> pa.Array:
        parts = [_counts(piece["t"]) for piece in chunks(iter([pa.record_batch([texts], ["t"])]), "t")]
        if not parts:
            parts = [_counts(texts)]
        flat = [np.concatenate(columns) for columns in zip(*parts)]
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.ravel().astype(np.int64)))
                 for a in flat[len(COUNTS):]]
        return pa.StructArray.from_arrays([pa.array(a.astype(np.int64)) for a in flat[:len(COUNTS)]] + lists, [*COUNTS, "classes", "common"])
    return F.arrow_udf(count, _TYPE)(text)


def distance(own: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms: the root of the divergence in bits, between 0 and 1.

    Null where either histogram is null or without counts.
    """
    def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        flat = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float)
        rows = flat.reshape(int(valid.sum()), -1) if len(flat) else np.zeros((int(valid.sum()), 1))
        full = np.zeros((len(column), rows.shape[1]))
        full[valid] = rows
        return full, full.sum(1)

    def compare(a: pa.Array, b: pa.Array) -> pa.Array:
        (p, n), (q, m) = matrix(a), matrix(b)
        known = (n > 0) & (m > 0)
        p, q = p[known] / n[known, None], q[known] / m[known, None]
        middle = (p + q) / 2
        total = np.zeros(len(p))
        for x in (p, q):
            share = np.divide(x, middle, out=np.ones_like(x), where=x > 0)
            total += (x * np.log2(share)).sum(1) / 2
        out = np.zeros(len(known))
        out[known] = np.sqrt(np.maximum(total, 0))
        return pa.array(out, pa.float64(), mask=~known)

    return F.arrow_udf(compare, "double")(own, reference)


def references(counts: DataFrame, lang: str, stats: str) -> DataFrame:
    """Both histograms added up over all rows of each language; one row per language."""
    sums = [F.sum(F.col(stats)[name][i]).alias(f"{name}_{i}") for name, n in (("classes", len(CLASSES)), ("common", len(WORDS) + 1)) for i in range(n)]
    both = counts.groupBy(lang).agg(*sums)
    return both.select(lang, *[F.array(*[f"{name}_{i}" for i in range(n)]).alias(f"ref_{name}") for name, n in (("classes", len(CLASSES)), ("common", len(WORDS) + 1))])


def judge(counts: DataFrame, lang: str, stats: str, class_limit: float = 0.3, word_limit: float = 0.2, word_noise: float = 1.7,
          least_chars: int = 200, least_words: int = 100) -> DataFrame:
    """``counts`` with the struct column ``quality`` for the struct ``stats`` of ``counted``; see ``assess``."""
    key = F.coalesce(F.concat(F.lit("0"), F.col(lang)), F.lit("1"))
    keyed = counts.drop("quality").withColumn("__tidemill_lang", key)
    known = stored(references(keyed.select("__tidemill_lang", stats), "__tidemill_lang", stats), "references")
    joined = keyed.join(known, "__tidemill_lang", "left")
    own = F.col(stats)
    joined = joined.withColumns({"__tidemill_far_class": distance(own["classes"], F.col("ref_classes")),
                                 "__tidemill_far_words": distance(own["common"], F.col("ref_common"))})
    base = (own["n_words"] < 50) | (100 * own["n_repeat_words"] > 50 * own["n_words"])
    limit = F.lit(word_limit) + F.lit(word_noise) / F.sqrt(own["n_words"])
    odd = ((own["word_chars"] >= least_chars) & (F.coalesce("__tidemill_far_class", F.lit(0.0)) > class_limit)) | (
        (own["n_words"] >= least_words) & (F.coalesce("__tidemill_far_words", F.lit(0.0)) > limit))
    verdict = F.struct(*[own[c].alias(c) for c in COUNTS], base.alias("base_failed"), (~base & ~odd).alias("kept"),
                       F.col("__tidemill_far_class").alias("class_distance"), F.col("__tidemill_far_words").alias("word_distance"))
    return joined.withColumn("quality", verdict).drop("__tidemill_lang", "__tidemill_far_class", "__tidemill_far_words", "ref_classes", "ref_common")


def assess(df: DataFrame, text: str = "text", lang: str = "lang", **limits: float) -> DataFrame:
    """``df`` with the struct column ``quality``: the base counts, ``base_failed``, ``kept`` and both distances.

    The references are the summed histograms of all rows of the same language, a null language being one of its
    own. A distance above its limit rejects; texts shorter than the guard of a distance are not judged by it, and
    the limit of the word distance falls with the length, as short samples stray further from any reference. Null and empty texts have counts of 0 and fail the base rule.
    Equal rows get equal verdicts, and an empty table stays empty. An input column ``quality`` is replaced.
    The texts are read twice and never shuffled. Texts are read whole: a task needs some 150 bytes of memory per byte of its longest one.
    """
    return judge(df.withColumn("__tidemill_stats", counted(F.col(text))), lang, "__tidemill_stats", **limits).drop("__tidemill_stats")
