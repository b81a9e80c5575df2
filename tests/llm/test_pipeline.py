"""The stages against brute-force decisions on small documents."""

import re
from collections import Counter

import corpus_pipeline
from tidemill.llm import quality

from .test_operators import corpus, groups_of, waterfill


def test_stages(spark, documents, tmp_path):
    item = next(t for _, t in corpus() if t and len(t) > 400)
    spark.createDataFrame([(1, " ".join(item.split()[40:70]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    given = documents(corpus())
    given.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]

    def through(name, frame):
        out = stages[name](spark, frame, str(tmp_path))
        path = str(tmp_path / re.sub(r"\W", "-", name))
        out.write.parquet(path)
        return spark.read.parquet(path)

    kept = through("quality rules", docs)
    judged = {(r.doc_id, r.text) for r in quality.assess(docs).where("quality.kept").collect()}
    assert {(r.doc_id, r.text) for r in kept.collect()} == judged and judged and kept.columns == docs.columns

    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    single = through("n-gram Jaccard join", kept)
    _, group = groups_of(rows, 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted({g: k for (k, _), g in reversed(list(zip(rows, group)))}.values())

    clean = through("benchmark decontamination", single)
    passage = item.split()[40:70]

    def holds(text):
        words = text.split()
        return any(sum(a == b for a, b in zip(words[i:i + 13], passage[j:j + 13])) >= 10 for i in range(len(words) - 12) for j in range(18))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in single.collect() if not holds(r.text)) != sorted(r.doc_id for r in single.collect())

    mixed = through("mixing sources to target weights", clean)
    sizes = Counter()
    for r in clean.collect():
        sizes[r.source] += len(r.text.split())
    taken, copies = Counter(), Counter()
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
        copies[r.doc_id] += 1
    want = waterfill(sizes)
    assert max(copies.values()) <= 3 and all(abs(taken[s] - want[s]) <= 80 for s in want)

    last = through("sharding", mixed)
    assert last.columns == [*[c for c in docs.columns if c != "shard"], "shard", "slot"] and last.count() == mixed.count()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.shard, r.slot) for r in whole.collect()) == Counter((r.doc_id, r.shard, r.slot) for r in last.collect())
