import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tributary.llm import divergence
from tributary.llm.divergence import Audit, audit

KIND = "doc_id long, lang string, source string, text string"


def slow(rows, least=30, ranks=50):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def p(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (n + 5 * v) for t in kept}

        mine, all_ = p(counts[lang, source]), p(sum((c for (a, _), c in counts.items() if a == lang), Counter()))
        pairs = [(sum(abs(mine[t] - x) for t, x in p(counts[lang, other]).items()), other) for a, other in groups if a == lang and other != source]
        terms = [(mine[t] - all_[t], t) for t in kept if counts[lang, source][t] and mine[t] > all_[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < ranks]
    return sorted(out)


def corpus(n, sources, seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeÉ中") for _ in range(r.randrange(1, 4))) for _ in range(150)]
    rows = []
    for i in range(n):
        s = None if i % 50 == 0 else "hot" if i % 3 == 0 else f"s{r.randrange(sources)}"
        own = vocab[hash_of(s) % 100 :][:60]
        rows.append((i, r.choice(["en", "en", "de", None]), s, r.choice([" ", "1", "\n"]).join(r.choice(own) for _ in range(r.randrange(0, 80)))))
    return rows


def hash_of(s):
    return sum(map(ord, s or "x")) * 7


@pytest.mark.parametrize("tile, side", [(100_000, 400), (40, 400), (40, 3)])
def test_against_all_terms(spark, monkeypatch, tile, side):
    """Also where a language has many parts and blocks; terms are dense or sparse."""
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "SIDE", side)
    rows = corpus(400, 14)
    rows += [rows[1], rows[1], (1, "fr", "alone", "mot"), (2, "it", "a", "uno"), (3, "it", "b", None), (4, "en", "empty", ""), (5, "en", "empty", "12 34"), (6, "de", "long", "aa bb " * 50_000)]
    df = spark.createDataFrame(rows, KIND).withColumn("count", F.lit(1)).withColumn("term", F.lit("x")).withColumn("n", F.lit(None).cast("int")).repartition(5)
    want = slow(rows, least=5)
    assert sorted(map(tuple, audit(df, Audit(least_docs=5)).collect())) == want
    assert {w[2] for w in want} == {"pair", "term"} and ("it", "a", "pair", "b", 0, 1) in want


@pytest.mark.parametrize("heavy", [0, 2, 1000])
def test_dense_and_sparse_agree(spark, heavy):
    rows = corpus(200, 10, 2)
    assert sorted(map(tuple, audit(spark.createDataFrame(rows, KIND), Audit(least_docs=4, heavy=heavy)).collect())) == slow(rows, least=4)


def test_large_counts_and_empty(spark):
    n = spark.range(1).select(divergence.estimate(F.lit(9_000_000_000_000_000), F.lit(9_100_000_000_000_000), F.lit(1000), Audit()).alias("p")).first().p
    assert n == 1 + 1_000_000_000 * (9_000_000_000_000_000 + 5) // (9_100_000_000_000_000 + 5000)
    assert audit(spark.createDataFrame([], KIND)).count() == 0
