"""Near-duplicate detection by min-max hashing.

Every permutation of the shingles gives two signature values, the least and the greatest: half the hash evaluations of
plain min-hashing, and a lower variance of the estimated similarity, as least and greatest rarely agree by chance together.
Bands of the signature bring candidates together, the whole signature estimates their similarity, and full sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .bits import texts_of
from .linking import components, leads, mixed, with_groups
from .tokens import Words, chunks, mix, randoms

#: Permutations; each gives two values of a signature. A band holds ROWS values, all least or all greatest ones.
PERMUTATIONS, ROWS = 60, 5
#: Bits of each value that the estimate compares, in longs of 16 values.
LONGS = 2 * PERMUTATIONS // 16 + 1
#: Standard deviations by which an estimate may fall short of the limit; a pair beyond is lost once in three million.
SIGMAS = 5
#: Longs of a set's parity sketch: each shingle flips one bit, so two sketches differ in no more bits than the sets in shingles.
PARITY = 8
#: Rounds in which groups meet leads before all remaining pairs meet; they save work and change no result.
ROUNDS = 4
CHUNK = 1 << 19


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each row in rising order, rows one after the other, and where each row starts."""
    words = Words(texts, lower=True)
    value, row = words.shingles(n)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], np.searchsorted(row[new], np.arange(words.rows + 1))


def signatures(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The 2 x PERMUTATIONS values of each set (none empty): least ones in the first half, greatest in the second."""
    out = np.empty((len(starts), 2 * PERMUTATIONS), np.uint64)
    factors, terms = randoms(PERMUTATIONS, 11), randoms(PERMUTATIONS, 12)
    for i in range(PERMUTATIONS):
        image = value * factors[i] + terms[i]
        image ^= image >> np.uint64(31)
        image *= np.uint64(0x9E3779B97F4A7C15)
        out[:, i] = np.minimum.reduceat(image, starts)
        out[:, PERMUTATIONS + i] = np.maximum.reduceat(image, starts)
    return out


def _bands(signature: np.ndarray) -> np.ndarray:
    """One hash for every ROWS values, which tells bands apart."""
    count = 2 * PERMUTATIONS // ROWS
    keys = (mix(signature) * np.tile(randoms(ROWS, 13), count)).reshape(len(signature), count, ROWS).sum(2, dtype=np.uint64)
    return mix(keys + randoms(count, 14))


def _nibbles(signature: np.ndarray) -> list[np.ndarray]:
    """Four bits of every value, 16 values to a long."""
    four = np.zeros((len(signature), 16 * LONGS), np.uint64)
    four[:, :signature.shape[1]] = mix(signature) >> np.uint64(60)
    longs = (four.reshape(len(signature), LONGS, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64)
    return [longs[:, j].view(np.int64) for j in range(LONGS)]


def differing(a: str, b: str) -> Column:
    """In how many values the signatures of two rows differ, by their four bits: columns ``{a}0``, ``{a}1``, ... and ``{b}0``, ..."""
    def of(j: int) -> Column:
        x = F.col(f"{a}{j}").bitwiseXOR(F.col(f"{b}{j}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111)))
    return sum((of(j) for j in range(1, LONGS)), of(0))


def _parity(value: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The longs of each set's parity sketch."""
    bit, which = np.uint64(1) << (value & np.uint64(63)), (value >> np.uint64(6)) % np.uint64(PARITY)
    longs = []
    for j in range(PARITY):
        flips = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(np.where(which == j, bit, np.uint64(0)))])
        longs.append((flips[bounds[1:]] ^ flips[bounds[:-1]]).view(np.int64))
    return longs


def most_differing(percent: int) -> int:
    """How many values of two similar signatures differ at most: mean and SIGMAS deviations at the limit itself."""
    p, k = (1 - percent / 100) * 15 / 16, 2 * PERMUTATIONS
    return int(np.ceil(k * p + SIGMAS * np.sqrt(k * p * (1 - p))))


def _signed(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Per row: key, hash of the text, size of the set, its 128-bit digest, bands, the four-bit signature and the parity sketch."""
    longs = [*[f"s{j}" for j in range(LONGS)], *[f"p{j}" for j in range(PARITY)]]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            value, bounds = _sets(batch["text"], n)
            sizes = np.diff(bounds)
            some = np.flatnonzero(sizes)
            digests = []
            for seed in (15, 16):
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix(value + randoms(1, seed)), dtype=np.uint64)])
                digests.append(pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)))
            signature = signatures(value, bounds[some])
            bands = _bands(signature)
            ends = np.zeros(len(sizes) + 1, np.int32)
            ends[1:] = np.cumsum(np.where(sizes > 0, bands.shape[1], 0))
            four = np.zeros((LONGS, len(sizes)), np.int64)
            four[:, some] = _nibbles(signature)
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["hash"], pa.array(sizes.astype(np.int64)), *digests, pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel().view(np.int64))), *[pa.array(x) for x in four], *[pa.array(x) for x in _parity(value, bounds)]],
                ["key", "hash", "size", "d1", "d2", "bands", *longs])

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    signed = rows.mapInArrow(sign, f"key {kind}, hash bigint, size bigint, d1 bigint, d2 bigint, bands array<bigint>, {', '.join(c + ' bigint' for c in longs)}")
    return signed.withColumn("row", F.monotonically_increasing_id())


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar: 100 x intersection >= ``percent`` x union."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            value, bounds = _sets(batch["text"], n)
            yield pa.RecordBatch.from_arrays([batch["node"], pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(value.view(np.int64)))], ["node", "set"])

    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = a.flatten().to_numpy().view(np.uint64), b.flatten().to_numpy().view(np.uint64)
        xo, yo = np.concatenate([[0], np.cumsum(a.value_lengths())]), np.concatenate([[0], np.cumsum(b.value_lengths())])
        out = np.zeros(len(a), bool)
        for i in range(len(a)):
            both = np.concatenate([x[xo[i]:xo[i + 1]], y[yo[i]:yo[i + 1]]])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            out[i] = 100 * shared >= percent * (len(both) - shared)
        return pa.array(out)

    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stored(nodes.join(asked, "node").select(F.col("key").alias("id"), "hash", "node"), "wanted")
    texts = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).cast("string").alias("text"))
    found = stored(texts_of(texts, wanted).select("node", "text").dropDuplicates(["node"]).mapInArrow(sets, "node bigint, set array<bigint>"), "sets")
    left, right = (found.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}")) for side in "ab")
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(F.arrow_udf(similar, "boolean")("set_a", "set_b")).select("a", "b")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: key, ``n_shingles``, ``component_id``, and ``kept``: whether the row's key names the component.

    Words are runs without ASCII white space, A-Z lowered; a document's set holds its distinct runs of ``n`` words, or the
    whole sequence if shorter. Documents link when 100 x intersection >= ``percent`` x union of their full sets, and the
    component is the smallest key reachable by links. Candidates share a band: at a similarity of 0.80 one pair in
    ten thousand shares none of the 24 bands of five values, at 0.85 one in a million; what is linked is always right.

    Equal sets are one node, so exact copies cost nothing. In some ``rounds`` each node meets one lead of another group, in the
    first ones a lead with which it shares two bands at once. Then all remaining pairs of separate groups meet, once each, whose
    sizes, signatures and parity sketches allow them to be similar; no candidate is left out.

    Rows without words or text link with nothing and name themselves. Repeated rows share a component. Null keys come last:
    a group of null keys has a null component and its rows are kept. An empty table stays empty, other columns are not
    read. Texts are read whole; a task needs some 60 bytes of memory per byte of its longest text.
    """
    longs = [*[f"s{j}" for j in range(LONGS)], *[f"p{j}" for j in range(PARITY)]]
    rows = stored(_signed(docs, key, text, n), "signatures")
    filled = rows.where("size > 0")
    sets = filled.groupBy("d1", "d2").agg(F.min("row").alias("node"))
    nodes = stored(rows.join(sets.select("node"), F.col("row") == F.col("node")).select("node", "key", "hash", "size", "bands", *longs), "nodes")
    half = PERMUTATIONS // ROWS
    loose = _buckets(nodes, F.col("bands"))
    strict = _buckets(nodes, F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: F.xxhash64(F.get("bands", i), F.get("bands", i + half))))
    marks = nodes.select("node", "size", *longs)

    def close(pairs: DataFrame) -> DataFrame:
        a, b = (marks.select([F.col(c).alias(side if c == "node" else f"{side}_{c}") for c in marks.columns]) for side in "ab")
        return pairs.join(a, "a").join(b, "b").where(_may_be_similar(percent)).select("a", "b")

    links, tried, names = None, None, None
    for turn in range(rounds):
        pairs = close(leads(with_groups(strict if 2 * turn < rounds else loose, names), turn))
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if not pairs.limit(1).count():
            continue
        found = stored(confirmed(pairs, docs, nodes, key, text, n, percent), "links")
        links, tried = found if links is None else links.union(found), pairs if tried is None else tried.union(pairs)
        names = stored(components(links), "components")
    apart = mixed(with_groups(loose, names)).select("node", "group", "token").join(nodes.drop("key", "hash"), "node")
    # A pair meets where its first shared band is.
    bands = [f"t{j}" for j in range(2 * half)]
    apart = apart.select("node", "group", "token", "size", *longs, *[F.expr(f"int(bands[{j}] >> 32)").alias(c) for j, c in enumerate(bands)],
                         (F.array_position("bands", F.col("token")) - 1).alias("place"))
    l, r = (apart.select([F.col(c).alias(f"{side}_{c}") for c in apart.columns]) for side in "ab")
    first = F.coalesce(*[F.when(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(j)) for j, c in enumerate(bands)])
    met = l.join(r, (F.col("a_token") == F.col("b_token")) & (F.col("a_node") < F.col("b_node")) & (F.col("a_group") != F.col("b_group"))
                 & _may_be_similar(percent) & (first == F.col("a_place")))
    rest = met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    if tried is not None:
        rest = rest.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    rest = stored(rest, "pairs")
    if rest.limit(1).count():
        found = confirmed(rest, docs, nodes, key, text, n, percent)
        names = components(found if links is None else links.union(found))
    members = with_groups(filled.join(sets, ["d1", "d2"]).select("key", "size", "node"), names)
    least = members.groupBy("group").agg(F.min("key").alias("component_id"))
    joined = members.join(least, "group").select("key", "size", "component_id")
    alone = rows.where("size = 0").select("key", "size", F.col("key").alias("component_id"))
    both = joined.union(alone)
    return both.select(F.col("key").alias(key), F.col("size").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def _buckets(nodes: DataFrame, tokens: Column) -> DataFrame:
    """(token, node) of the tokens that several nodes have."""
    rows = nodes.select(F.explode(tokens).alias("token"), "node")
    shared = rows.groupBy("token").agg(F.count("*").alias("many")).where("many > 1").select("token")
    return stored(rows.join(shared, "token"), "buckets")


def _may_be_similar(percent: int) -> Column:
    """Whether sizes, parity sketches and signatures of the sides ``a`` and ``b`` of a pair allow the least similarity.

    The first two are exact bounds: sets of m and n shingles of that similarity share need of them and differ in m + n - 2 need.
    """
    m, n = F.col("a_size"), F.col("b_size")
    need = F.ceil(F.lit(percent) * (m + n) / F.lit(100 + percent))
    odd = [F.bit_count(F.col(f"a_p{j}").bitwiseXOR(F.col(f"b_p{j}"))) for j in range(PARITY)]
    return (need <= F.least(m, n)) & (sum(odd[1:], odd[0]) <= m + n - 2 * need) & (differing("a_s", "b_s") <= most_differing(percent))
