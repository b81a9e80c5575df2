"""Min-max hashing, whitening and the divergence audit against brute force; rounds of the components."""

import gzip
import hashlib
import random
import re
import string
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import decontam, divergence, linking, minmax, mixing, ngram_join, passages, quality, secrets, sharding, suffix, warc, whitening

from .conftest import ODD, prose
from .test_operators import corpus, groups_of

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# Components.

@pytest.fixture
def rounds(monkeypatch):
    """The rounds that components() has taken."""
    seen, contract = [], linking._contract

    def counted(edges, seed):
        seen.append(seed)
        return contract(edges, seed)
    monkeypatch.setattr(linking, "_contract", counted)
    return seen


def test_chain_takes_rounds_by_the_logarithm(spark, rounds):
    n = 1000
    names = linking.components(spark.range(n).selectExpr("id as a", "id + 1 as b")).collect()
    assert len(names) == n + 1 and {r["component"] for r in names} == {0}
    assert len(rounds) <= 25


def test_star_takes_few_rounds(spark, rounds):
    names = linking.components(spark.range(1, 3000).selectExpr("id as a", "777777L as b")).collect()
    assert len(names) == 3000 and {r["component"] for r in names} == {1}
    assert len(rounds) <= 3


@pytest.mark.parametrize("seed,links", [(1, 60), (2, 150), (3, 400)])
def test_random_graphs(spark, seed, links):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(links)]
    name = {x: x for e in edges for x in e}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        name[y] = x
    got = linking.components(spark.createDataFrame([*edges, (None, 5), (6, None)], "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(x, find(x)) for x in name} and len(got) == len(name)


def test_no_links(spark):
    assert linking.components(spark.createDataFrame([(None, 1)], "a long, b long")).count() == 0
    assert linking.components(spark.createDataFrame([(4, 4)], "a long, b long")).collect() == [(4, 4)]


# Min-max hashing.

@pytest.mark.parametrize("n,percent", [(5, 85), (2, 60)])
def test_near_groups(spark, documents, n, percent):
    rows = corpus()
    sets, group = groups_of(rows, n, percent)
    least = {}
    for (key, _), g in zip(rows, group):
        least[g] = min((x for x in (least.get(g), key) if x is not None), default=None)
    want = sorted((repr(k), len(s), repr(least[g]), k == least[g]) for (k, _), s, g in zip(rows, sets, group))
    got = minmax.near_groups(documents(rows), n=n, percent=percent).collect()
    assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"]), r["kept"]) for r in got) == want


@pytest.mark.parametrize("rounds", [0, 3])
def test_rounds_change_nothing(spark, documents, rounds):
    """A dense family whose members link with some of the others only."""
    rng, base = random.Random(5), prose(8, 120)
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 7)):
            words[at] = f"x{i}-{at}"
        rows.append((i, " ".join(words)))
    _, group = groups_of(rows, 5, 80)
    assert 2 < len(set(group)) < 60
    got = minmax.near_groups(documents(rows), n=5, percent=80, rounds=rounds).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: rows[g][0] for (i, _), g in zip(rows, group)}


def test_near_groups_of_nothing(spark, documents):
    assert minmax.near_groups(documents([])).count() == 0
    assert sorted(minmax.near_groups(documents([(1, None), (2, "")])).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_min_max_estimates_without_bias_and_with_less_variance():
    rng = np.random.default_rng(3)
    share, tries, size = 0.8, 300, 400
    found, least = [], []
    for _ in range(tries):
        both = rng.integers(0, 2 ** 63, int(size * share), np.int64)
        left, right = (rng.integers(0, 2 ** 63, int(size * (1 - share) / 2), np.int64) for _ in range(2))
        value = np.concatenate([both, left, both, right]).astype(np.uint64)
        s = minmax.signatures(value, np.array([0, len(both) + len(left)]))
        same = s[0] == s[1]
        found.append(same.mean())
        least.append(same[:minmax.PERMUTATIONS].mean())
    assert abs(np.mean(found) - share) < 0.01
    # Twice the values of the least ones alone, and the two ends hardly depend on each other.
    assert np.var(found) < 0.62 * np.var(least)


def test_bands_find_similar_sets():
    """Of pairs at the limit nearly all share a band; the estimate drops none."""
    rng, limit = np.random.default_rng(4), minmax.most_differing(80)
    met = 0
    for _ in range(1000):
        both, left, right = (rng.integers(0, 2 ** 63, k, np.int64) for k in (160, 20, 20))
        s = minmax.signatures(np.concatenate([both, left, both, right]).astype(np.uint64), np.array([0, 180]))
        bands = minmax._bands(s)
        met += bool((bands[0] == bands[1]).any())
        four = [x.view(np.uint64) for x in minmax._nibbles(s)]
        apart = sum(sum(((int(x[0]) ^ int(x[1])) >> (4 * i)) & 15 != 0 for i in range(16)) for x in four)
        assert apart <= limit
    assert met >= 995


def test_one_huge_text(spark, documents):
    words = " ".join(prose(1, 400_000, 100_000))
    got = minmax.near_groups(documents([(1, words), (2, words + " and more"), (3, "x" * 20_000_000)])).collect()
    assert [(r["doc_id"], r["component_id"]) for r in sorted(got)] == [(1, 1), (2, 1), (3, 3)]


# Whitening.

def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, component string, n string")


def checked(got, rows, components=4):
    """Holds rows of whiten() against a dense eigendecomposition."""
    usable = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(256 * np.array([np.float32(v) for _, v in usable]).astype(float)).astype(np.int64)
    once = np.unique(x, axis=0)
    n, s = len(once), once.sum(0)
    off = once - s / n
    values, vectors = np.linalg.eigh(off.T @ off / n)
    rank = min(components, np.linalg.matrix_rank(off))
    values, vectors = values[::-1][:rank], vectors[:, ::-1][:, :rank]
    want = (x - s / n) @ vectors / np.sqrt(values)
    assert len(got) == len(usable) * rank
    by_key = defaultdict(list)
    for r in got:
        by_key[r["vec_id"]].append(r)
    total, signs = (off ** 2).sum() / n, np.zeros(rank)
    for (i, _), w, v in zip(usable, want, x):
        deviation = sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s))
        for r in by_key[i]:
            k = r["component"] - 1
            signs[k] = signs[k] or np.sign(r["whitened"] * w[k])
            assert abs(r["whitened"] * signs[k] - w[k]) < 1e-8 and r["deviation"] == deviation and r["n"] == n
            assert abs(r["explained"] / (values[k] / total) - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening(spark):
    rng = np.random.default_rng(1)
    scales = np.linspace(3, 0.1, 12)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(5, scales)], 0, "x", "y") for i in range(500)]
    rows += [(1000 + i, rows[0][1], 0, "x", "y") for i in range(200)]  # a hot vector counts once in the fit
    rows += [(2000, None, 1, None, None), (2001, [None] * 12, 1, "", ""), (2002, [float("nan")] * 12, 1, "", ""), (2003, [float("inf")] + [0.0] * 11, 1, "", ""),
             (None, rows[3][1], None, None, None)]
    checked(whitening.whiten(vectors_of(spark, rows)).collect(), rows)


@pytest.mark.parametrize("rank,d,n", [(2, 6, 80), (6, 6, 4), (3, 40, 30)])
def test_whitening_without_full_rank(spark, rank, d, n):
    rng = np.random.default_rng(rank)
    mixed = rng.integers(-3, 4, (n, rank)) @ rng.integers(-3, 4, (rank, d)) + 7
    rows = [(i, [float(c) for c in v], 0, "", "") for i, v in enumerate(mixed)]
    checked(whitening.whiten(vectors_of(spark, rows)).collect(), rows)


def test_ill_conditioned_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(c)) for c in [1e4 * a, 1e2 * b, c, 1e4 * a + c / 5]], 0, "", "") for i, (a, b, c) in enumerate(rng.normal(size=(100, 3)))]
    x = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    n, s = len(x), x.sum(0)
    values = np.linalg.svd(x - s / n)[1] ** 2 / n
    got = whitening.whiten(vectors_of(spark, rows)).collect()
    explained = {r["component"]: r["explained"] for r in got}
    assert len(got) == 4 * n
    for k in range(4):
        assert abs(explained[k + 1] / (values[k] / values.sum()) - 1) < 1e-4
    assert all(r["identity_error"] < 1e-4 for r in got)


def test_whitening_of_nothing(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None, 0, "", "")], [(1, [], 0, "", "")], [(1, [1.0, 2.0], 0, "", ""), (2, [1.0, 2.0], 0, "", "")]):
        got = whitening.whiten(vectors_of(spark, rows))
        assert got.columns == columns and got.count() == 0


def test_other_widths_are_dropped(spark):
    rows = [(1, [1.0, 2.0], 0, "", ""), (2, [2.0, 2.5], 0, "", ""), (3, [1.0], 0, "", ""), (4, [5.0, 1.0], 0, "", "")]
    got = whitening.whiten(vectors_of(spark, rows)).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 4}
    checked(got, [rows[0], rows[1], rows[3]])


def test_deviation_beyond_int64_arithmetic():
    fit = whitening.Fit(1 << 20, [3 << 20, -(1 << 30)], np.eye(2), np.ones(2), 1.0, 3)
    x = np.array([[4, -1023], [3, -1024]])
    assert fit.deviations(x).tolist() == [2 * (1 << 40), 0]
    with pytest.raises(OverflowError):
        whitening.Fit(1 << 40, [0, 0], np.eye(2), np.ones(2), 1.0, 3).deviations(np.array([[1 << 40, 0]]))


# Divergence.

def audited(rows, least=30, smoothing=5, ranks=50):
    """(lang, source, part, item, value, rank) by plain counting; rows: (text, lang, source)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = [m.translate({c: c + 32 for c in range(65, 91)}) for m in LETTERS.findall(text)]
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        everywhere = Counter()
        for s in sources:
            everywhere.update({t: counts[lang, s][t] for t in kept})

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + smoothing) // (total + smoothing * len(kept)) for t in kept}
        p, q = {s: share(counts[lang, s]) for s in sources}, share(everywhere)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(items, 1)]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["Über", "ÜBER", "naïve", "日本", "Ab", "aB", "x y"]
    return [(rng.choice([" ", "-", "\x00", "1", "_", "\n"]).join(rng.choices(words, range(1, len(words) + 1), k=rng.randrange(30))),
             rng.choice(["en", "de", None, ""]), rng.choices(["s1", "s2", "S", None, "ß"], [9, 3, 1, 1, 1])[0]) for _ in range(n)]


@pytest.mark.parametrize("least,ranks", [(30, 50), (3, 4)])
@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, monkeypatch, least, ranks, small):
    if small:  # many flushes, shards and blocks
        for name, value in (("CHUNK", 200), ("HELD", 40), ("SHARD", 20), ("BLOCK", 16)):
            monkeypatch.setattr(divergence, name, value)
    rows = texts(1, 700) + [(None, "en", "s1"), ("", "en", "empty"), (None, "fr", "alone"), ("one two", "it", "a"), (None, "it", "b")]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, source string, n long, term string, shard int").repartition(3)
    got = divergence.audit(docs, least_docs=least, ranks=ranks)
    assert got.dtypes[-2:] == [("value", "bigint"), ("rank", "int")]
    assert sorted(tuple(r) for r in got.collect()) == audited(rows, least, ranks=ranks)


def test_divergence_of_odd_rows(spark, documents):
    rows = [(t, "en", s) for (_, t) in ODD for s in ("a", "b")] * 20
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == audited(rows)
    assert divergence.audit(documents([])).count() == 0
    assert divergence.audit(documents([(None, None)])).count() == 0


def test_shares_beyond_longs():
    count = np.array([0, 7, 10 ** 17, 3 * 10 ** 17])
    got = divergence._shares(count, 4 * 10 ** 17 + 7, 4, 5)
    assert got.tolist() == [1 + 10 ** 9 * (int(c) + 5) // (4 * 10 ** 17 + 27) for c in count]


# Archives.

def archive_of(tmp_path, members):
    path = tmp_path / f"a{len(list(tmp_path.iterdir()))}.warc.gz"
    path.write_bytes(b"".join(members))
    return f"file://{path}", path.stat().st_size


def members_of(n, payload=lambda i: f"page {i} ".encode() * 40):
    return [gzip.compress(warc.record("response", i, "http://a/", None, hashlib.sha256(payload(i)).hexdigest(), len(payload(i)), payload(i)), 5, mtime=0) for i in range(n)]


def read(spark, archives, width):
    return warc.read_archives(spark, spark.createDataFrame(archives, "path string, bytes long"), width)


@pytest.mark.parametrize("width", [60, 230, 1 << 20])
@pytest.mark.parametrize("damage", ["first of a range", "last cut short", "magic in the middle", "first of all", "junk behind"])
def test_damaged_archives_raise(spark, tmp_path, damage, width):
    members = members_of(5)
    if damage == "first of a range":
        members[2] = members[2][:30] + bytes([members[2][30] ^ 255]) + members[2][31:]
    elif damage == "last cut short":
        members[4] = members[4][:-9]
    elif damage == "magic in the middle":
        members[2] = b"\0" + members[2][1:]
    elif damage == "first of all":
        members[0] = b"\x1f\x8b\x00" + members[0][3:]
    else:
        members.append(b"junk")
    with pytest.raises(Exception, match="no record at|damaged record|records are missing"):
        read(spark, [archive_of(tmp_path, members)], width).count()


def test_ranges_are_read_by_as_many_tasks(spark, tmp_path):
    archives = [archive_of(tmp_path, members_of(60)) for _ in range(3)]
    total = sum(size for _, size in archives)
    scanned = warc._scanned(spark, spark.createDataFrame(archives, "path string, bytes long"), total // 110)
    assert scanned.rdd.getNumPartitions() >= 100
    with_rows = scanned.groupBy(F.spark_partition_id()).count().count()
    assert with_rows >= 50
    got = read(spark, archives, total // 110).collect()
    assert Counter(r["record_id"] for r in got) == Counter({str(i): 3 for i in range(60)})


def test_large_and_tricky_members(spark, tmp_path):
    noise = random.Random(1).randbytes(3 << 20)
    members = members_of(6, lambda i: [b"", noise, b"\x1f\x8b\x08" * 500, gzip.compress(b"WARC/1.1 not a record"), b"x", noise[:70000]][i])
    stored = archive_of(tmp_path, members)
    for width in (5000, 70_001, 1 << 22):
        got = {r["record_id"]: bytes(r["payload"]) for r in read(spark, [stored], width).collect()}
        assert len(got) == 6 and got["1"] == noise and got["0"] == b"" and got["2"] == b"\x1f\x8b\x08" * 500


# Secrets.

@pytest.mark.parametrize("alphabet", ["0123456789abcdef", string.ascii_uppercase + "234567", string.digits + string.ascii_lowercase,
                                      string.digits + string.ascii_uppercase, string.digits + string.ascii_letters, string.digits + string.ascii_letters + "-_"])
@pytest.mark.parametrize("length", [20, 24, 32])
def test_recall_of_random_keys(alphabet, length):
    rng = random.Random(length)
    keys = ["".join(rng.choices(alphabet, k=length)) for _ in range(500)]
    found = sum(any(a <= 4 and b >= 2 + length for a, b in secrets.entropy_spans(f"a: {key} z")) for key in keys)
    assert found >= 0.93 * len(keys)


def test_names_and_numbers_are_no_keys():
    for text in ("data/2024/reports/summary-of-all-sales", "release_2024_version_17_candidate_3", "aVeryLongCamelCaseName2024", "CONSTANT_NAME_WITH_MANY_PARTS_1",
                 "--------------------------------", "part0001/part0002/part0003/part0004", "2024-01-01-2024-12-31-1234567890"):
        assert secrets.entropy_spans(text) == [], text


def test_long_texts_take_time_in_proportion():
    key = "Zk8Qw3Xp9Lm2Vt7Rb4Ny6Hc1"
    for unit in ("example_", f"token=abcdefgh12 {key} ", f"{key}/sample/", "deadbeef" * 4 + " "):
        took = []
        for size in (1 << 17, 1 << 20):
            text = unit * (size // len(unit))
            start = time.perf_counter()
            secrets.scan(text)
            took.append(time.perf_counter() - start)
        assert took[1] < 24 * took[0] + 0.5  # eight times the text; quadratic work would be 64 times


def test_spans_inside_base_matches_add_nothing():
    rng = random.Random(2)
    for _ in range(200):
        text = " ".join(rng.choice(["token=" + "".join(rng.choices(string.ascii_letters + string.digits, k=30)), "ab12" * 8, "AKIA" + "Q7" * 10, "word",
                                    "".join(rng.choices(string.ascii_letters + string.digits, k=25))]) for _ in range(6))
        covers = [s for found in secrets.base_spans(text).values() for s in found]
        want = [(a, b) for a, b in secrets.entropy_spans(text) if not any(x <= a and b <= y for x, y in covers)]
        got = [tuple(map(int, s.split(":")[1:])) for s in secrets.scan(text)[4].split(",") if s.startswith("entropy")]
        assert got == want


def test_secrets_of_an_empty_table(documents):
    assert documents([]).select(secrets.secrets(F.col("text")).alias("s")).select("s.*").count() == 0


# Very long texts.

@pytest.fixture(scope="module")
def long_texts():
    """20 MB without a break, and 20 MB of words in which a passage comes twice."""
    rng = random.Random(6)
    words = rng.choices([f"w{i}x{i * 7}" for i in range(200_000)], k=1_700_000)
    return [(1, "x" * 20_000_000), (2, " ".join(words)), (3, "short text"), (4, " ".join(words[:60]))]


@pytest.mark.parametrize("operator", ["quality", "decontam", "ngram_join", "suffix", "secrets", "divergence", "sharding", "mixing", "warc"])
def test_long_texts(spark, documents, long_texts, operator):
    docs = documents(long_texts)
    if operator == "quality":
        got = {r["doc_id"]: (r["n_words"], r["kept"]) for r in quality.assess(docs).select("doc_id", "quality.*").collect()}
        assert (got[1], got[2][0], got[3]) == ((1, False), 1_700_000, (2, False))
    elif operator == "decontam":
        bench = spark.createDataFrame([(7, " ".join(long_texts[3][1].split()[20:50]))], "item_id long, text string")
        assert {(r["doc_id"], r["start_word"]) for r in decontam.contaminations(docs, bench, ["doc_id"]).collect()} == {(2, 20), (4, 20)}
    elif operator == "ngram_join":
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_groups(docs).collect()}
        assert got[1] == (1, 1) and got[2][0] > 1_600_000 and got[4] == (56, 4)
    elif operator == "suffix":
        # One character over and over has an anchor at every byte, all of which meet in one task: not 20 MB of it.
        got = {r["doc_id"]: r["n_removed"] for r in suffix.cut_repeats(documents([(1, "x" * 200_000), *long_texts[1:]])).collect()}
        assert (got[1], got[3], got[4]) == (200_000, 0, len(long_texts[3][1])) and got[2] >= got[4]
    elif operator == "secrets":
        assert {r["spans"] for r in docs.select(secrets.secrets(F.col("text")).alias("s")).select("s.*").collect()} == {""}
    elif operator == "divergence":
        got = divergence.audit(docs, least_docs=1).collect()
        assert {r["part"] for r in got} == {"pair", "term"}
    elif operator == "sharding":
        assert sharding.shard(docs, [F.col("doc_id")], 3).select("shard").distinct().count() == 3
    elif operator == "mixing":
        rows = docs.select("doc_id", "source", mixing.words_in(F.col("text")).alias("words"))
        assert mixing.mix(rows, F.col("source"), F.col("words"), F.col("doc_id")).count() == 4
    else:
        pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
        got = {r["record_id"]: r["payload_bytes"] for r in warc.round_trip(spark, pages, width=1 << 20, columns=["record_id", "payload_bytes"]).collect()}
        assert got == {str(i): len(t) for i, t in long_texts}


# Passages.

def test_windows_of_repeated_tokens_are_compared_together(monkeypatch):
    """Windows whose tokens repeat are judged as one by one, without a comparison of sets for each."""
    rng, width, calls, near = np.random.default_rng(7), passages.LEAST, [], passages._near

    def counted(x, y):
        calls.append(1)
        return near(x, y)
    monkeypatch.setattr(passages, "_near", counted)
    found = 0
    for turn in range(30):
        base = rng.integers(0, 60, 90).astype(np.uint64)
        # Copies with some tokens replaced and some moved.
        a, b = np.concatenate([base, base[20:70]]), base.copy()
        b[rng.integers(0, 90, turn % 6)] = 1000
        b[5:80] = np.roll(b[5:80], turn % 9)
        b = np.concatenate([rng.integers(0, 60, turn).astype(np.uint64), b])
        want = {(s, d) for d in range(-len(a), len(b)) for s in range(max(0, -d), min(len(a), len(b) - d) - width + 1) if near(a[s:s + width], b[s + d:s + d + width])}
        calls.clear()
        got = list(passages._slid(a, b, []))
        assert not calls
        for x, y, z, w in got:
            assert w - z == y - x >= width
        # Each range is made of near windows, with less than a window between them.
        for x, y, z, _ in got:
            assert any(d == z - x and s < y and x < s + width for s, d in want)
        found += len(got)
    assert found > 20


def test_copies_are_compared_once(spark, documents, monkeypatch):
    """Texts that stand under many ids are fetched and compared once, and every id has its passage."""
    kept, store = {}, passages.stored

    def seen(df, name):
        kept.setdefault(name, []).append(store(df, name))
        return kept[name][-1]
    monkeypatch.setattr(passages, "stored", seen)
    passage = prose(78, 60, 10 ** 6)
    texts = [" ".join([*prose(510 + i, 30, 10 ** 6), *passage, *prose(610 + i, 30, 10 ** 6)]) for i in range(3)]
    rows = [(20 * i + k, t) for i, t in enumerate(texts) for k in range(12)] + [(None, texts[0]), (5, texts[0])]
    got = [(r.doc_id, r.class_id, r.n_words, r.spans) for r in passages.shared_passages(documents(rows)).collect()]
    assert len(got) == 37 and {g[1] for g in got} == {0}
    assert {g[0] for g in got} == {20 * i + k for i in range(3) for k in range(12)} | {None}
    # A copy has its whole text, and each text the passage at least.
    assert all(g[2] >= 60 for g in got)
    assert {a.count() for a in kept["asked"]} == {3}


def test_scattered_tokens_are_not_slid(monkeypatch):
    """Equal tokens that lie dense in one text and apart in the other cost no comparison for each distance."""
    calls, per_window = [], passages._per_window

    def counted(*args):
        calls.append(1)
        return per_window(*args)
    monkeypatch.setattr(passages, "_per_window", counted)
    common = np.arange(400, dtype=np.uint64)
    a, b = common, np.arange(1000, 2600, dtype=np.uint64)
    # Every 4th place of b holds a token of a, and 30 at a stretch are 4 times in it: no window has enough different ones.
    b[::4] = common
    for start in range(101, 1500, 350):
        b[start:start + 30] = common[start // 5:start // 5 + 30]
    assert passages.common_passages(a, b) == [] and len(calls) < 12


def test_texts_with_one_common_line_are_no_candidates(spark, documents, monkeypatch):
    """Texts that share a few signatures, yet too few functions of them, stay out of the join that lists all signatures of a pair."""
    kept, store = {}, passages.stored

    def seen(df, name):
        kept[name] = store(df, name)
        return kept[name]
    monkeypatch.setattr(passages, "stored", seen)
    rows = [(i, " ".join([*prose(900 + i, 60, 10 ** 6), *"one two three four five".split(), *prose(990 + i, 60, 10 ** 6)])) for i in range(60)]
    passage = prose(77, 60, 10 ** 6)
    rows += [(100 + i, " ".join([*prose(500 + i, 30, 10 ** 6), *passage, *prose(600 + i, 30, 10 ** 6)])) for i in range(3)]
    got = {r.doc_id: r.class_id for r in passages.shared_passages(documents(rows)).collect()}
    assert got == {100: 100, 101: 100, 102: 100}
    shared = kept["windows"].where("hash is not null").groupBy("value").agg(F.count_distinct("id").alias("n")).agg(F.max("n")).first()[0]
    assert shared >= 10  # the line is a signature of many texts
    assert kept["apart"].where("a.id < 100 and b.id < 100").count() <= 60


def test_many_texts_with_one_common_line_make_no_pairs(spark, documents, monkeypatch):
    """A line that more components hold than COMMON joins no two texts that have no more in common, copies of them included."""
    kept, store = {}, passages.stored

    def seen(df, name):
        kept[name] = store(df, name)
        return kept[name]
    monkeypatch.setattr(passages, "stored", seen)
    line = prose(1200, 34, 10 ** 6)
    texts = [" ".join([*prose(1300 + i, 60, 10 ** 6), *line, *prose(1400 + i, 60, 10 ** 6)]) for i in range(40)]
    rows = list(enumerate(texts)) + [(100 + i, t) for i, t in enumerate(texts[:20])]
    # Texts with the line whose passage stands apart from it, and one that has it alone.
    passage = prose(1500, 60, 10 ** 6)
    rows += [(200 + i, " ".join([*passage, *prose(1600 + i, 50, 10 ** 6), *line, *prose(1700 + i, 60, 10 ** 6)])) for i in range(2)] + [(300, " ".join(passage))]
    pairs = {}
    for limit in (10 ** 6, 16):
        monkeypatch.setattr(passages, "COMMON", limit)
        got = {r.doc_id: r.class_id for r in passages.shared_passages(documents(rows)).collect()}
        assert got == {**{i: i for i in range(20)}, **{100 + i: i for i in range(20)}, 200: 200, 201: 200, 300: 200}
        pairs[limit] = kept["apart"].where("a.id < 200 and b.id < 200").count()
    assert kept["common"].count() and 8 * pairs[16] < pairs[10 ** 6]


def test_places_of_passages():
    """Every passage lies where its hits are dense, tokens that stand in a text several times included."""
    rng = np.random.default_rng(9)
    some = 0
    for turn in range(60):
        base = rng.integers(0, (40, 10 ** 6)[turn % 2], 100).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(10 ** 7, 10 ** 8, 70), base, rng.integers(10 ** 7, 10 ** 8, 20)]).astype(np.uint64) for _ in range(2))
        b[rng.integers(70, 170, turn % 12)] = 1
        x, y = passages._dense(a, np.isin(a, b))
        inside = np.zeros(len(a), bool)
        for f, t in zip(x, y):
            inside[f:t] = True
        found = passages.common_passages(a, b)
        some += bool(found)
        assert all(inside[f[0]:f[1]].all() for f in found) and not inside[:30].any()
    assert some > 30


def test_blocks_of_a_component_meet(spark, documents, monkeypatch):
    """Near copies and copies give the same rows whether a component is one block or many; nothing of the shuffles stays."""
    base = prose(1800, 260, 10 ** 6)
    rows = []
    for i in range(14):
        text = list(base)
        for k in range(i % 5, 260, 40 + 3 * (i % 4)):
            text[k] = f"x{i}k{k}"
        rows += [(i, " ".join(text))] + [(100 + i, " ".join(text)), (None, " ".join(text))][:i % 3]
    want = sorted(map(repr, passages.shared_passages(documents(rows)).collect()))
    monkeypatch.setattr(passages, "BLOCK_TEXTS", 3)
    assert sorted(map(repr, passages.shared_passages(documents(rows)).collect())) == want and len(want) == len(rows)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
