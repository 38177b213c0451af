import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tributary.llm.common import components
from tributary.llm.embed_dedup import Hashing, near_vectors
from tributary.llm.simhash import fingerprint, near_duplicates


def roots(nodes, edges):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts():
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdé") for _ in range(4)) for _ in range(200)]
    out = []
    for _ in range(25):
        words = [r.choice(vocab) for _ in range(r.randrange(60, 300))]
        for _ in range(r.randrange(1, 7)):
            own = list(words)
            for _ in range(r.randrange(0, 3)):
                own[r.randrange(len(own))] = r.choice(vocab)
            out.append(r.choice([" ", "\n"]).join(own))
    return out + [None, "", " \t", "One", "one two", "ONE two", "x" * 100_000, out[0].upper(), out[0]]


def test_simhash_against_all_pairs(spark):
    rows = list(enumerate(texts()))
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("rep", F.lit(0)).repartition(4)
    fp = {i: slow_fingerprint(t) for i, t in rows}
    want = roots(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(df).collect()}
    assert got == {(i, f"{fp[i]:016x}", want[i]) for i in fp} and len(set(want.values())) < len(want)


def test_simhash_edges(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "zz"), (5, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in near_duplicates(df).collect())
    assert got == [("5", "5"), ("None", "5"), ("None", "None"), ("None", "None")]
    assert near_duplicates(df.limit(0)).count() == 0


def bridge():
    """Texts of two fingerprints that differ in three or four bits, and one between them."""
    r, seen = random.Random(11), {}
    base = [f"w{r.randrange(50)}" for _ in range(14)]
    for _ in range(40_000):
        own = list(base)
        for _ in range(r.randrange(1, 3)):
            own[r.randrange(len(own))] = f"w{r.randrange(50)}"
        seen[fingerprint(" ".join(own))] = " ".join(own)
    fps = list(seen)
    for m in fps[:4000]:
        near = [x for x in fps[:8000] if 0 < (x ^ m).bit_count() <= 2]
        for i, a in enumerate(near):
            for b in near[i + 1 :]:
                if (a ^ b).bit_count() > 2:
                    return seen[a], seen[m], seen[b]


def test_a_fingerprint_of_null_ids_alone_ties_others(spark):
    found = bridge()
    if found is None:
        pytest.skip("no such fingerprints among those tried")
    a, m, b = found
    df = spark.createDataFrame([(1, a), (None, m), (2, b)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(df).collect()} == {(1, 1), (None, 1), (2, 1)}


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7)]
    want = roots({x for e in edges for x in e}, edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for native in (False, True):
        got = {x.node: x.root for x in components(df, native).collect()}
        assert got == {x: want[x] for x in got} and all(x in got for x in want if any(x in e and e[0] != e[1] for e in edges))


def vectors():
    r = np.random.default_rng(5)
    out = []
    for _ in range(60):
        base = r.normal(size=16)
        for _ in range(int(r.integers(1, 8))):
            out.append((base + r.normal(size=16) * r.choice([0, 0.03, 0.08])) * r.choice([1, 1, 3]))
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 60 < 50) if i % 11 else None) for i, v in enumerate(out)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    return rows + [(n + i, v, 1) for i, v in enumerate(odd)] + [(n + 20 + i, rows[0][1], 1) for i in range(40)]


def linked(rows, least=0.93):
    good = {i: (np.array(v, dtype=float), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and any(v)}
    return [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= least]


def test_vectors_against_all_pairs(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash")).repartition(4)
    pairs = linked(rows)
    want, count = roots([r[0] for r in rows], pairs), dict.fromkeys((r[0] for r in rows), 0)
    for a, b in pairs:
        count[a] += 1
        count[b] += 1
    for hashing in (Hashing(tables=40), Hashing(tables=40, block=3)):  # enough tables to miss none here; blocks that cut every bucket
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, hashing=hashing).collect()}
        assert got == {i: (count[i], want[i], want[i] == i) for i in want}
    assert near_vectors(df.limit(0)).count() == 0


def test_vectors_of_shared_and_null_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.95, 0.3122, 0.0], [0.8, 0.6, 0.0]  # a with b, b with c
    rows = [(1, a, 1), (1, [0.0, 0.0, 1.0], 1), (None, b, 1), (7, c, 1), (9, [0.0, 0.0, 2.0], 2), (3, [0.0, 0.1, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in near_vectors(df, hashing=Hashing(tables=60)).collect())
    assert got == [(0, 2, 1), (1, 1, 1), (1, 1, 1), (3, 1, 1), (7, 1, 1), (9, 0, 9)]


def test_recall():
    h = Hashing()
    assert h.recall(0.93) > 0.95 and h.recall(0.985) > 0.999
    r = np.random.default_rng(1)
    a = r.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = r.normal(size=a.shape)
    o -= (o * a).sum(axis=1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * o
    met = (h.buckets(a) == h.buckets(b)).any(axis=1).mean()
    assert abs(met - h.recall(0.93)) < 0.02
