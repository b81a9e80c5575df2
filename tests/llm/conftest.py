import random

import pytest

#: Rows that every operator has to stand: null and empty texts, ties, repeated rows, null ids.
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, None), (4, "one"), (4, "one"), (5, "one"), (None, "a null id and a few words"), (6, "x" * 5000)]


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture
def documents(spark):
    """A frame of documents from (id, text) pairs, with extra columns whose names clash with the operators' own."""
    def make(rows):
        rows = [(i, t, None if i is None else "en", None if t is None else f"s{len(t) % 3}", 0, "x", "y", 7) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, quality string, size long")
    return make
