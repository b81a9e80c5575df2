"""Repeated byte strings by a sparse, hash-compared suffix sort.

Every string of LENGTH bytes is owned by an anchor: the place inside it where GRAM bytes have the least hash, the first
of equals. Equal strings have equal anchors at equal places, so only suffixes that begin at anchors are sorted, and only
among anchors with equal bytes. Prefix polynomial hashes give the common extension of two suffixes by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .bits import bits_of, is_set, texts_of
from .tokens import chunks, mix, utf8, window_min

LENGTH, GRAM = 200, 72
#: Bits of the filter that keeps most lone anchors out of the shuffle, whatever the data.
FILTER_BITS = 1 << 25
#: An anchor with more different surroundings than this is settled string by string, by digests, instead of in one group; the result is the same.
GROUP = 4096
#: Suffixes sorted together in a task.
BLOCK = 8192
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, i up to n."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = 1 << max(n, 1).bit_length()
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            powers = np.empty(size + 1, np.uint64)
            powers[0], filled = 1, 1
            while filled <= size:
                step = min(filled, size + 1 - filled)
                powers[filled:filled + step] = powers[:step] * np.uint64(pow(b, filled, 1 << 64))
                filled += step
            both.append(powers)
        _POWERS[base] = tuple(both)
    return _POWERS[base]


class Hashes:
    """Prefix polynomial hashes of a byte array; any substring's hash takes two look-ups."""

    def __init__(self, data: np.ndarray, base: int = _BASES[0]):
        up, self.down = _powers(base, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def _anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each anchor: row, place, first and last start of the strings it owns (within ``data``), and a hash of its bytes."""
    none = tuple(np.zeros(0, t) for t in (np.int64,) * 4 + (np.uint64,))
    if len(data) < LENGTH:
        return none
    hashes = Hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = mix(hashes.of(at, at + GRAM))
    ranked = (gram & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)
    owner = (window_min(ranked, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(data) - LENGTH + 1)
    row = np.searchsorted(bounds, starts, "right") - 1
    inside = starts + LENGTH <= bounds[row + 1]
    starts, row, owner = starts[inside], row[inside], owner[:len(inside)][inside]
    if not len(starts):
        return none
    new = np.ones(len(starts), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    place, lo, hi = owner[first], starts[first], starts[last]
    return row[first], place, lo, hi, gram[place]


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A cryptographic digest of 128 bits of the bytes of each range, as two longs: equal ones stand for equal bytes, whoever wrote them."""
    whole = memoryview(np.ascontiguousarray(data))
    found = b"".join(hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist()))
    pairs = np.frombuffer(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _extension(hashes: Hashes, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common extension of the suffixes at a and b, up to ``most``: binary search over substring hashes."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high + 1) // 2
        same = hashes.of(a, a + middle) == hashes.of(b, b + middle)
        low = np.where(open_ & same, middle, low)
        high = np.where(open_ & ~same, middle - 1, high)


def suffix_sort(data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes [start, end) of ``data`` by group and then bytes, and each one's common extension with its
    predecessor in that order (0 for the first of a group).

    A merge sort: rows come by ascending ``group``; runs of doubling width are merged by finding each element's rank in
    the other run. A comparison takes a binary search for the common extension and then looks at one byte. Extensions
    of neighbours are verified on the bytes; should a hash have lied, the rows are sorted by their bytes instead.
    """
    n, hashes = len(start), Hashes(data)
    length = end - start
    padded = np.concatenate([data.astype(np.int64), [0]])

    def before(x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        """Whether suffix x comes before y; equal ones if ``ties``."""
        out = group[x] < group[y]
        same = np.flatnonzero(group[x] == group[y])
        if len(same):
            p, q = x[same], y[same]
            common = _extension(hashes, start[p], start[q], np.minimum(length[p], length[q]))
            left = np.where(common < length[p], padded[np.minimum(start[p] + common, len(data))], -1)
            right = np.where(common < length[q], padded[np.minimum(start[q] + common, len(data))], -1)
            out[same] = (left < right) | ((left == right) & ties)
        return out

    order, width = np.arange(n), 1
    while width < n:
        at = np.arange(n)
        block = at // (2 * width) * (2 * width)
        second = at >= block + width
        other = np.where(second, block, np.minimum(block + width, n))
        size = np.minimum(other + width, n) - other
        size = np.where(second, width, size)
        low, high = np.zeros(n, np.int64), size.copy()
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                break
            middle = (low[todo] + high[todo]) // 2
            x, y = order[other[todo] + middle], order[at[todo]]
            # An element of the second run follows its equals in the first.
            goes = np.where(second[todo], before(x, y, True), before(x, y, False))
            low[todo] = np.where(goes, middle + 1, low[todo])
            high[todo] = np.where(goes, high[todo], middle)
        merged = np.empty(n, np.int64)
        own = at - block - np.where(second, width, 0)
        merged[block + own + low] = order
        order, width = merged, 2 * width

    def neighbours(order: np.ndarray) -> np.ndarray:
        common = np.zeros(n, np.int64)
        pair = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
        p, q = order[pair - 1], order[pair]
        common[pair] = _extension(hashes, start[p], start[q], np.minimum(length[p], length[q]))
        return common

    def true_extension(p: int, q: int) -> int:
        m = int(min(length[p], length[q]))
        differ = np.flatnonzero(data[start[p]:start[p] + m] != data[start[q]:start[q] + m])
        return int(differ[0]) if len(differ) else m

    common = neighbours(order)
    pair = np.flatnonzero(common)
    if len(pair):
        p, q, m = start[order[pair - 1]], start[order[pair]], common[pair]
        inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        if (data[np.repeat(p, m) + inner] != data[np.repeat(q, m) + inner]).any():
            order = np.array(sorted(range(n), key=lambda i: (group[i], data[start[i]:end[i]].tobytes())), np.int64)
            common = np.array([0] + [true_extension(order[i - 1], order[i]) if group[order[i - 1]] == group[order[i]] else 0 for i in range(1, n)], np.int64)
    return order, common


def repeated_starts(data: np.ndarray, bounds: np.ndarray, anchor: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings of LENGTH bytes that occur twice: (item, offset of the start in the item).

    Item i holds the bytes bounds[i]:bounds[i + 1] of all strings its anchor owns; the anchor is at ``anchor`` in it.
    The suffixes from the anchors are sorted, and so are the bytes before the anchors, read backwards. A string with o
    bytes before its anchor has equals where both sorts agree: to depth o backwards and LENGTH - o forwards.
    """
    n = len(anchor)
    first, last = bounds[:-1], bounds[1:]
    right, right_common = suffix_sort(data, first + anchor, last, group)
    # All bytes in reverse order: what stands before an anchor becomes a suffix.
    total = len(data)
    left, left_common = suffix_sort(data[::-1].copy(), total - (first + anchor), total - first, group)
    items, offsets = [], []
    own = (last - first) - LENGTH
    edge = np.concatenate([[True], group[right][1:] != group[right][:-1]])
    edge_left = np.concatenate([[True], group[left][1:] != group[left][:-1]])
    for o in range(int(anchor.max()) + 1 if n else 0):
        owner = np.flatnonzero((anchor - o >= 0) & (anchor - o <= own))
        if len(owner) < 2:
            continue
        ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
        ahead[right] = np.cumsum(edge | (right_common < LENGTH - o))
        behind[left] = np.cumsum(edge_left | (left_common < o))
        both = ahead[owner] * (n + 1) + behind[owner]
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        twice = np.zeros(len(owner), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        items.append(owner[twice])
        offsets.append((anchor - o)[owner[twice]])
    if not items:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    items, offsets = np.concatenate(items), np.concatenate(offsets)
    order = np.lexsort((offsets, items))
    return items[order], offsets[order]


def _ranges(items: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts of the same item: item, first and last start."""
    new = np.ones(len(items), bool)
    new[1:] = (items[1:] != items[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(items)]]).astype(np.int64) - 1
    return items[first], starts[first], starts[last]


def repeats(docs: DataFrame, id_kind: str) -> DataFrame:
    """(id, hash, lo, hi): starts lo to hi, in bytes, of strings that start elsewhere too; ``docs`` has (id, hash, text)."""
    anchor_columns = f"id {id_kind}, hash bigint, place int, lo int, hi int, gram bigint, c1 bigint, c2 bigint"

    def scan(keep: np.ndarray | None):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "text"):
                data, bounds = utf8(batch["text"])
                row, place, lo, hi, gram = _anchors(data, bounds)
                if keep is None:
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64))], ["gram"])
                    continue
                k = np.flatnonzero(is_set(keep, gram))
                base, rows = bounds[row[k]], pa.array(row[k])
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].take(rows), batch["hash"].take(rows)] + [pa.array((x[k] - base).astype(np.int32)) for x in (place, lo, hi)]
                    + [pa.array(gram[k].view(np.int64)), *map(pa.array, _digests(data, lo[k], hi[k] + LENGTH))], [c.split()[0] for c in anchor_columns.split(", ")])
        return work

    grams = docs.select("text").mapInArrow(scan(None), "gram bigint")
    twice = stored(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    anchors = docs.mapInArrow(scan(bits_of(twice, "gram", FILTER_BITS)), anchor_columns)
    anchors = stored(anchors.join(twice, "gram", "left_semi"), "anchors")

    around = stored(anchors.groupBy("gram", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("hash", "id", "place", "lo", "hi")).alias("one")), "around")
    # Equal surroundings, by their digests, hold equal strings only.
    settled = anchors.join(around.where("n > 1").select("gram", "c1", "c2"), ["gram", "c1", "c2"], "left_semi").select("id", "hash", "lo", "hi")
    # Of anchors that are alike but differ around them, each kind is sorted once.
    kinds = around.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    open_ = around.join(kinds, "gram").select("one.*", "gram", "kinds")

    found_columns = f"id {id_kind}, hash bigint, lo int, hi int"
    names = [c.split()[0] for c in found_columns.split(", ")]
    grouped = open_.groupBy("id", "hash").agg(F.collect_list(F.struct("gram", "place", "lo", "hi", "kinds")).alias("own"))
    with_text = texts_of(docs, grouped)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, bounds = utf8(batch["text"])
            own = batch["own"]
            row = np.repeat(np.arange(batch.num_rows), own.value_lengths().to_numpy(zero_copy_only=False))
            flat = own.flatten()
            lo, hi = (flat.field(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
            for at in range(0, len(row), 4096):
                s = slice(at, at + 4096)
                pieces = [data[bounds[r] + a:bounds[r] + b + LENGTH].tobytes() for r, a, b in zip(row[s], lo[s], hi[s])]
                rows = pa.array(row[s])
                yield pa.RecordBatch.from_arrays([batch["id"].take(rows), batch["hash"].take(rows)] + [flat.field(c)[s.start:s.stop] for c in ("gram", "place", "lo", "hi", "kinds")]
                                                 + [pa.array(pieces, pa.binary())], ["id", "hash", "gram", "place", "lo", "hi", "kinds", "bytes"])

    pieces = stored(with_text.select("id", "hash", "text", "own").mapInArrow(
        cut, f"id {id_kind}, hash bigint, gram bigint, place int, lo int, hi int, kinds bigint, bytes binary"), "pieces")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            data, bounds = utf8_binary(table["bytes"].chunk(0))
            lo, place = (table[c].to_numpy().astype(np.int64) for c in ("lo", "place"))
            items, offsets = repeated_starts(data, bounds, place - lo, table["gram"].to_numpy())
            item, first, last = _ranges(items, offsets + lo[items])
            rows = pa.array(item)
            return pa.RecordBatch.from_arrays([table["id"].chunk(0).take(rows), table["hash"].chunk(0).take(rows), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names)

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                if sum(b.num_rows for b in held) >= BLOCK:
                    table = pa.Table.from_batches(held)
                    grams = table["gram"].to_numpy()
                    whole = int(np.searchsorted(grams, grams[-1]))  # The last group may go on.
                    if whole:
                        yield settle(table.slice(0, whole))
                        held = table.slice(whole).to_batches()
        if held:
            yield settle(pa.Table.from_batches(held))

    cold = pieces.where(F.col("kinds") <= GROUP).repartition("gram").sortWithinPartitions("gram").mapInArrow(sort, found_columns)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK // 4):
                part = batch.slice(at, BLOCK // 4)
                data, bounds = utf8_binary(part["bytes"])
                count = np.diff(bounds) - LENGTH + 1
                row = np.repeat(np.arange(part.num_rows), count)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = bounds[row] + offset
                values = _digests(data, start, start + LENGTH)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([part["id"].take(rows), part["hash"].take(rows), pa.array((part["lo"].to_numpy()[row] + offset).astype(np.int32)), *map(pa.array, values)],
                                                 ["id", "hash", "lo", "v1", "v2"])

    each = pieces.where(F.col("kinds") > GROUP).select("id", "hash", "lo", "bytes").mapInArrow(strings, f"id {id_kind}, hash bigint, lo int, v1 bigint, v2 bigint")
    each = stored(each, "strings")
    again = each.groupBy("v1", "v2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    hot = each.join(again, ["v1", "v2"], "left_semi").select("id", "hash", "lo", F.col("lo").alias("hi"))
    return settled.union(cold).union(hot)


def utf8_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each row starts and the last ends."""
    column = pa.concat_arrays([column.cast(pa.large_binary())])
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0]:bounds[-1]], bounds - bounds[0]


def removed(length: int, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings that start at lo to hi."""
    runs: list[tuple[int, int]] = []
    for k in np.argsort(lo, kind="stable"):
        a, b = int(lo[k]), int(hi[k]) + LENGTH
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept``, the bytes left.

    A byte goes if a string of LENGTH bytes over it also starts at another place of any text, the same one included.
    Strings are judged on the texts as given and never cross documents; overlapping repeats count, and so do equal
    rows, each of which is a document. Null texts are empty. ``kept`` is null where nothing was removed: the text
    stands as it is. Keys may be null or repeated: rows are told apart by key and hash of the text. Empty tables stay empty.
    Texts are read whole: a task needs some 100 bytes of memory per byte of its longest one. A stretch of one character over and over
    has an anchor at every byte, whose rows meet in the task of its text: 20 MB of it were too much for 4 GB of memory.
    """
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).cast("string").alias("text"))
    id_kind = docs.schema[key].dataType.simpleString()
    spans = repeats(rows, id_kind).groupBy("id", "hash").agg(F.collect_list(F.struct("lo", "hi")).alias("own"))
    touched = texts_of(rows, stored(spans, "spans")).dropDuplicates(["id", "hash"])

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            data, bounds = utf8(batch["text"])
            out = []
            for i in range(batch.num_rows):
                own, body = batch["own"][i].values, data[bounds[i]:bounds[i + 1]].tobytes()
                runs = removed(len(body), own.field("lo").to_numpy(), own.field("hi").to_numpy())
                edges = [0, *[x for run in runs for x in run], len(body)]
                left = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(body) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["hash"]] + [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.binary()))],
                                             ["id", "hash", "n_removed", "n_spans", "kept_sha256", "kept"])

    trimmed = touched.select("id", "hash", "text", "own").mapInArrow(trim, f"id {id_kind}, hash bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    trimmed = trimmed.withColumnsRenamed({"id": "its_id", "hash": "its_hash", "kept_sha256": "its_sha"})
    body = F.coalesce("text", F.lit("")).cast("binary")
    whole = rows.select("id", "hash", F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha"))
    joined = whole.join(trimmed, (F.col("hash") == F.col("its_hash")) & F.col("id").eqNullSafe(F.col("its_id")), "left")
    return joined.select(F.col("id").alias(key), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                         F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("its_sha", "sha").alias("kept_sha256"), "kept")
