import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from tributary.llm.near_docs import Near, one_of_each


def grams(text, k=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def groups(texts):
    """The components of Jaccard >= 0.8 among texts, by comparing all."""
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def corpus():
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdé") for _ in range(5)) for _ in range(400)]
    out = []
    for _ in range(60):
        words = [r.choice(vocab) for _ in range(r.randrange(40, 300))]
        for _ in range(r.randrange(1, 5)):
            own = list(words)
            for _ in range(r.randrange(0, 1 + len(own) // 30)):
                own[r.randrange(len(own))] = r.choice(vocab)
            out.append(" ".join(own))
    return out


def test_against_all_pairs(spark):
    """The pipeline's stage leaves the first of each group; most pairs are beyond two bits of a fingerprint."""
    texts = corpus() + [None, "", " \n", "a b", "A  b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("name", F.lit(1)).repartition(4)
    got = P.near_duplicates(spark, df, "")
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(groups(texts)))


def test_large_groups_that_fall_apart(spark):
    """Hundreds of variants of a text, most of them not near each other, in buckets that are cut into many blocks."""
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(900)]
    base = [r.choice(vocab) for _ in range(150)]
    texts = []
    for _ in range(260):
        own = list(base)
        for _ in range(r.randrange(1, 9)):
            own[r.randrange(len(own))] = r.choice(vocab)
        texts.append(" ".join(own))
    want = sorted(set(groups(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 20 < len(want) < 250
    for near in (Near(), Near(block=16), Near(block_bytes=20_000)):
        assert sorted(r.doc_id for r in one_of_each(df, near).collect()) == want


def test_recall():
    assert Near().recall(0.8) > 0.99999 and Near().recall(0.9) > 0.9999999


def test_empty(spark):
    assert one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_of_one_id(spark):
    """Rows that share an id, or have none, stay if their texts are unrelated; equal rows are one."""
    texts = corpus()
    rows = [(7, texts[0]), (7, texts[-1]), (7, texts[-1]), (9, texts[-1]), (None, texts[30]), (None, texts[30] + " x")]
    want = [(7, texts[0]), (7, texts[-1])]
    got = [(r.doc_id, r.text) for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(x for x in got if x[0]) == sorted(want) and sum(x[0] is None for x in got) == 1
