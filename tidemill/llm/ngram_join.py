"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams, rare ones first, is cut into fragments. Each document's set falls into one segment per
fragment; overlaps of two documents are counted fragment by fragment and added up per pair. The first fragment of a
document is its prefix, the n-grams of which two similar documents must share one: its partial counts choose the pairs.
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

#: Cells of the frequency sketch: its size is fixed, whatever the data.
CELLS = 1 << 20
#: Classes of frequency, by a cell's weight over the usual one; an n-gram's key is its class and then 60 bits of hash.
CLASSES = (1.25, 1.5, 2, 3, 5, 10, 30)
CLASS_SHIFT = 60
FRAGMENTS = 8
#: Bytes of text that a task turns into n-grams at a time.
CHUNK = 1 << 19
#: Longs of a set's parity sketch: each n-gram flips one bit, so two sketches differ in no more bits than the sets in n-grams.
SKETCH = 8
#: Rounds in which groups meet leads before all remaining pairs meet; they save work and change no result.
ROUNDS = 2


def _shingles(column: pa.Array, n: int) -> tuple[Words, np.ndarray, np.ndarray]:
    words = Words(column, lower=True)
    return (words, *words.shingles(n))


def frequency_classes(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """A class per cell of n-gram hashes: 0 for cells of usual weight, higher for heavier ones.

    Counted over all n-grams of all documents into CELLS cells. The classes only order n-grams, so that those of a
    very common passage come last; what is found does not depend on them.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in chunks(batches, "text", CHUNK):
            _, value, _ = _shingles(batch["text"], n)
            cells += np.bincount((value % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        # Two cells to a row.
        pairs = cells.reshape(-1, 2)
        used = np.flatnonzero(pairs.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(pairs[used, 0]), pa.array(pairs[used, 1])], ["pair", "first", "second"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "pair int, first bigint, second bigint")
    sums = rows.groupBy("pair").agg(F.sum("first").alias("first"), F.sum("second").alias("second")).toArrow()  # CELLS / 2 rows at most.
    total = np.zeros((CELLS // 2, 2), np.int64)
    total[sums["pair"].to_numpy()] = np.stack([sums["first"].to_numpy(), sums["second"].to_numpy()], 1)
    total = total.ravel()
    usual = max(float(np.median(total)), 1.0)
    return np.searchsorted(np.array(CLASSES) * usual, total, "right").astype(np.uint8)


def _sets(column: pa.Array, n: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram keys of each row in the global order, rows one after the other, and where each row starts."""
    words, value, row = _shingles(column, n)
    key = (classes[(value % np.uint64(CELLS)).astype(np.int64)].astype(np.uint64) << np.uint64(CLASS_SHIFT)) | (value >> np.uint64(64 - CLASS_SHIFT))
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[new], row[new]
    return key, np.searchsorted(row, np.arange(words.rows + 1))


def _needed(a: Column, b: Column, percent: int) -> Column:
    """The least overlap at which sets of these sizes are similar: inter / union >= percent / 100."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))


def _prefix(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many n-grams, first in the order, must hold one of any similar set's."""
    return np.where(sizes > 0, sizes - -(-sizes * percent // 100) + 1, 0)


def _digest(key: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(key + randoms(1, seed)), dtype=np.uint64)])
    return (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)


def _parity(key: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The longs of each row's parity sketch."""
    bit = np.uint64(1) << (key & np.uint64(63))
    which = (key >> np.uint64(6)) % np.uint64(SKETCH)
    longs = []
    for j in range(SKETCH):
        flips = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(np.where(which == j, bit, np.uint64(0)))])
        longs.append((flips[bounds[1:]] ^ flips[bounds[:-1]]).view(np.int64))
    return longs


def _signatures(docs: DataFrame, key: str, text: str, n: int, percent: int, classes: np.ndarray) -> DataFrame:
    """Per row: key, hash of the text, size of the set, its 128-bit digest and parity sketch, and the prefix."""
    sketch = [f"s{j}" for j in range(SKETCH)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            keys, bounds = _sets(batch["text"], n, classes)
            sizes = np.diff(bounds)
            first = _prefix(sizes, percent)
            at = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(first)[:-1]]), first) + np.arange(int(first.sum()))
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(first)]).astype(np.int32)), pa.array(keys[at].view(np.int64)))
            digests = [pa.array(_digest(keys, bounds, seed)) for seed in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["hash"], pa.array(sizes), *digests, *[pa.array(x) for x in _parity(keys, bounds)], prefix],
                                             ["key", "hash", "size", "d1", "d2", *sketch, "prefix"])

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(sign, f"key {kind}, hash bigint, size bigint, d1 bigint, d2 bigint, {', '.join(c + ' bigint' for c in sketch)}, prefix array<bigint>").withColumn("row", F.monotonically_increasing_id())


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose overlap in the first fragment leaves their sets a chance to be similar.

    Up to the earlier end of the two prefixes the overlap is counted; beyond it all of the smaller rest may be shared.
    """
    def bound(a: pa.Array, m: pa.Array, b: pa.Array, n: pa.Array) -> pa.Array:
        most = np.zeros(len(a), np.int64)
        x, y = a.flatten().to_numpy(), b.flatten().to_numpy()
        xo, yo = np.concatenate([[0], np.cumsum(a.value_lengths())]), np.concatenate([[0], np.cumsum(b.value_lengths())])
        for i, (m1, n1) in enumerate(zip(m.to_pylist(), n.to_pylist())):
            p, q = x[xo[i]:xo[i + 1]], y[yo[i]:yo[i + 1]]
            end = min(p[-1], q[-1])
            p, q = p[:np.searchsorted(p, end, "right")], q[:np.searchsorted(q, end, "right")]
            both = np.sort(np.concatenate([p, q]))
            most[i] = int((both[1:] == both[:-1]).sum()) + min(m1 - len(p), n1 - len(q))
        return pa.array(most)

    left = nodes.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("prefix").alias("p"))
    right = nodes.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("prefix").alias("q"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    most = F.arrow_udf(bound, "bigint")(F.col("p"), F.col("m"), F.col("q"), F.col("n"))
    return both.withColumn("most", most).where(F.col("most") >= _needed(F.col("m"), F.col("n"), percent)).select("a", "b", "m", "n")


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, key: str, text: str, n: int, percent: int, classes: np.ndarray) -> DataFrame:
    """The pairs (a, b, m, n) that are similar: overlaps counted per fragment and added up."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.uint64((1 << CLASS_SHIFT) // (FRAGMENTS - 1) + 1)
        for batch in chunks(batches, "text", CHUNK):
            keys, bounds = _sets(batch["text"], n, classes)
            number = np.minimum(keys // width, np.uint64(FRAGMENTS - 1)).astype(np.int64)
            mark = number + FRAGMENTS * np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            starts = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]])) if len(mark) else np.zeros(0, np.int64)
            offsets = np.concatenate([starts, [len(mark)]]).astype(np.int32)
            segments = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["node"].take(pa.array(mark[starts] // FRAGMENTS)), pa.array(number[starts]), segments], ["node", "fragment", "segment"])

    def overlap(a: pa.Array, b: pa.Array) -> pa.Array:
        shared = np.zeros(len(a), np.int64)
        x, y = a.flatten().to_numpy(), b.flatten().to_numpy()
        xo, yo = np.concatenate([[0], np.cumsum(a.value_lengths())]), np.concatenate([[0], np.cumsum(b.value_lengths())])
        for i in range(len(a)):
            both = np.sort(np.concatenate([x[xo[i]:xo[i + 1]], y[yo[i]:yo[i + 1]]]))
            shared[i] = int((both[1:] == both[:-1]).sum())
        return pa.array(shared)

    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stored(nodes.join(asked, "node").select(F.col("key").alias("id"), "hash", "node"), "wanted")
    texts = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).cast("string").alias("text"))
    found = texts_of(texts, wanted)
    segments = stored(found.select("node", "text").mapInArrow(cut, "node bigint, fragment bigint, segment array<bigint>").dropDuplicates(["node", "fragment"]), "segments")
    left = segments.select(F.col("node").alias("a"), "fragment", F.col("segment").alias("p"))
    right = segments.select(F.col("node").alias("b"), "fragment", F.col("segment").alias("q"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "m", "n", F.arrow_udf(overlap, "bigint")("p", "q").alias("shared"))
    summed = partial.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("m").alias("m"), F.first("n").alias("n"))
    return summed.where(F.col("shared") >= _needed(F.col("m"), F.col("n"), percent)).select("a", "b")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: key, ``hash`` of the text, ``n_shingles``, ``component_id``, and the ``group``'s number.

    Words are runs without ASCII white space, A-Z lowered; a document's set holds its distinct runs of ``n`` words, or
    the whole sequence if shorter. Documents link when inter / union reaches ``percent`` / 100, and the component is
    the smallest key reachable by links. Rows without words or text link with nothing and name themselves, repeated
    rows share a component, and null keys come last: a group of null keys has a null component. Empty tables stay empty.
    Texts are read whole: a task needs some 100 bytes of memory per byte of its longest one.

    Equal sets become one node. Nodes that share an n-gram of their prefixes are candidates. In some ``rounds`` each node of
    a bucket with several groups meets one lead of another group, and the links found join up groups; then all pairs of still
    separate groups meet. Those leave the join only if place and parity sketch allow enough overlap. So near copies that do
    link cost a few pairs per member, and no link between separate groups is missed.
    """
    sketch = [f"s{j}" for j in range(SKETCH)]
    classes = frequency_classes(docs, text, n)
    rows = stored(_signatures(docs, key, text, n, percent, classes), "signatures")
    filled = rows.where("size > 0")
    sets = filled.groupBy("d1", "d2").agg(F.min("row").alias("node"))
    nodes = stored(rows.join(sets.select("node"), F.col("row") == F.col("node")).select("node", "key", "hash", "size", *sketch, "prefix"), "nodes")
    tokens = nodes.select(F.posexplode("prefix").alias("place", "token"), "node", "size")
    shared = tokens.groupBy("token").agg(F.count("*").alias("many")).where("many > 1").select("token")
    buckets = stored(tokens.join(shared, "token"), "buckets")

    links, tried, names = None, None, None
    for turn in range(rounds):
        # First the node of a token with the fewest rare n-grams of its own: the likely origin of its near copies.
        pairs = leads(with_groups(buckets, names), turn, None if turn else "place")
        pairs = stored(_possible(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), nodes, percent), "possible")
        if not pairs.limit(1).count():
            continue
        found = stored(_linked(pairs, docs, nodes, key, text, n, percent, classes), "links")
        links, tried = found if links is None else links.union(found), pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        names = stored(components(links), "components")
        # Tokens of one group have done their work.
        buckets = stored(mixed(with_groups(buckets, names)).drop("group"), "buckets")
    apart = mixed(with_groups(buckets, names)).join(nodes.select("node", *sketch), "node")
    l, r = (apart.select([F.col(c).alias(f"{c}_{side}") for c in apart.columns]) for side in "ab")
    need = _needed(F.col("size_a"), F.col("size_b"), percent)
    # The first n-gram that two similar sets share has enough left behind it in both.
    reach = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    apart_bits = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in sketch[1:]), F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))))
    met = l.join(r, (F.col("token_a") == F.col("token_b")) & (F.col("node_a") < F.col("node_b")) & (F.col("group_a") != F.col("group_b")) & (reach >= need)
                 & (apart_bits <= F.col("size_a") + F.col("size_b") - 2 * need))
    pairs = met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    if tried is not None:
        pairs = pairs.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    rest = stored(_possible(pairs, nodes, percent), "possible")
    if rest.limit(1).count():
        found = _linked(rest, docs, nodes, key, text, n, percent, classes)
        names = components(found if links is None else links.union(found))
    members = with_groups(filled.join(sets, ["d1", "d2"]).select("key", "hash", "size", "node"), names)
    least = members.groupBy("group").agg(F.min("key").alias("component_id"))
    joined = members.join(least, "group").select("key", "hash", "size", "component_id", "group")
    alone = rows.where("size = 0").select("key", "hash", "size", F.col("key").alias("component_id"), F.col("row").alias("group"))
    return joined.union(alone).select(F.col("key").alias(key), "hash", F.col("size").alias("n_shingles"), "component_id", "group")


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest key, then the smallest text hash.

    Rows without words are in no group and stay. Repeated rows, equal in key and text, count as one.
    """
    name = "__tidemill_name"

    def named(hash_: Column) -> Column:
        return F.concat_ws(":", F.col(key).cast("string"), hash_.cast("string"))

    groups = near_groups(docs, key, text, **options).where("n_shingles > 0")
    first = groups.groupBy("group").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "hash")).alias("f"))
    keepers = first.select(F.concat_ws(":", F.col("f.key").cast("string"), F.col("f.hash").cast("string")).alias(name))
    marked = docs.withColumn(name, named(F.xxhash64(text)))
    empty = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = marked.where(~empty).join(keepers, name, "left_semi").dropDuplicates([name])
    return kept.unionByName(marked.where(empty)).drop(name)
