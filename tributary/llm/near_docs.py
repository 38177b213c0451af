"""One document of each group of near duplicates: SimHash balls and MinHash bands for candidates, exact Jaccard of word shingles for verdicts.

Texts of equal words are one class. Classes whose fingerprints meet in a SimHash ball are candidates, as in simhash. A ball of radius 2 reaches
few pairs at a similarity of 0.8, where some ten of 64 bits differ, and one of radius 10 would be millions of words a text; so classes that share a MinHash band
are candidates as well. In each bucket, classes are first compared with its least one; buckets that hold several components after that are
compared whole, in blocks: a bucket of many classes is cut into parts, and each pair of parts is one task's, which gives the links that tie components
together and no pairs. So no pair within a bucket is left out, and no bucket needs to be in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import components, durable, small_batches
from tributary.llm.simhash import BLOCK, links, majority


@dataclass(frozen=True)
class Near:
    """least: Jaccard similarity from which texts are near duplicates. shingle: words of a shingle. bands, rows: buckets of a text, and minima that make one.
    block, block_bytes: classes of a bucket, and bytes of their shingles, that are compared with as many others at once."""

    least: float = 0.8
    shingle: int = 5
    bands: int = 24
    rows: int = 4
    seed: int = 42
    block: int = 512
    block_bytes: int = 8 << 20

    def recall(self, similarity: float) -> float:
        """The chance that a pair of that similarity meets in a bucket."""
        return 1 - (1 - similarity**self.rows) ** self.bands


def shingles(text: str | None, near: Near) -> tuple[int, np.ndarray]:
    """The hash of a text's words, and the sorted hashes of its different shingles; a shorter text is one shingle, one without words has none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and ASCII white space
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    name = int(np.array([h(joined, near.seed)], dtype=np.uint64).view(np.int64)[0])
    if not words:
        return name, np.empty(0, dtype=np.uint64)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends[:-1]]]
    k = min(near.shingle, len(words))
    return name, np.unique(np.fromiter((h(joined[a:b], near.seed) for a, b in zip(starts, ends[k - 1 :])), dtype=np.uint64, count=len(words) - k + 1))


def band_keys(found: np.ndarray, near: Near) -> list[int]:
    """The bucket of a text in each band: a hash of the band's minima."""
    r = np.random.default_rng(near.seed)
    n = near.bands * near.rows
    factors = r.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = r.integers(0, 1 << 63, n, dtype=np.uint64)
    least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(found), 1 << 12):  # a block at a time, whatever the length
        x = found[i : i + (1 << 12)]
        x = (x ^ (x >> np.uint64(31)))[None, :] * factors[:, None] + offsets[:, None]
        least = np.minimum(least, x.min(axis=1))
    import xxhash

    keys = [xxhash.xxh64_intdigest(b.astype("<u8").tobytes(), i) for i, b in enumerate(least.reshape(near.bands, near.rows))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def buckets(docs: DataFrame, near: Near, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row, name, fp, keys) of each row: row is the text's hash, name that of its words, fp its fingerprint; a text without words is in no bucket."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            each = [shingles(t, near) for t in batch["text"].tolist()]
            keys = [band_keys(x, near) if len(x) else [] for _, x in each]
            fps = np.array([majority((x[i : i + BLOCK] for i in range(0, len(x), BLOCK)), len(x)) for _, x in each], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "row": batch["row"], "name": [n for n, _ in each], "fp": fps, "keys": keys})

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    return read.mapInPandas(run, "doc_id long, row long, name long, fp long, keys array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, near: Near, text: str) -> DataFrame:
    """(name, found): the shingles of each wanted (row, name), once a name."""
    read = docs.select(F.xxhash64(text).alias("_row"), F.col(text).alias("text")).join(wanted, F.col("_row") == F.col("row"), "left_semi").dropDuplicates(["_row"]).select("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            each = [shingles(t, near) for t in batch["text"].tolist()]
            yield pd.DataFrame({"name": [n for n, _ in each], "found": [x.tobytes() for _, x in each]})

    return read.mapInPandas(run, "name long, found binary")


def verified(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) of names whose Jaccard similarity is at least the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"].tolist(), batch["y"].tolist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= near.least * (len(x) + len(y) - both) - 1e-9)
            yield batch.loc[keep, ["a", "b"]]

    # Sizes alone rule out a pair whose smaller set is less than the threshold of the larger one.
    size = lambda c: F.octet_length(c)
    both = pairs.join(sets.select(F.col("name").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("name").alias("b"), F.col("found").alias("y")), "b")
    both = both.where(F.least(size("x"), size("y")) >= near.least * F.greatest(size("x"), size("y")) - 1e-6)
    return both.select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def shared(met: DataFrame, what: str) -> DataFrame:
    """The rows of met whose key has different values of a column, with the key's least value, rows and bytes: from an aggregation that combines before its shuffle, so a key's rows need not be in one task."""
    ends = met.groupBy(F.col("key").alias("_key")).agg(F.min(what).alias("low"), F.max(what).alias("high"), F.count("*").alias("n"), F.sum("bytes").alias("sum")).where("low <> high")
    return met.join(ends, F.col("key") == F.col("_key")).drop("_key", "high")


def ties(cell: list[tuple], band: int, near: Near) -> list[tuple[int, int]]:
    """Links (a, b) of the classes (side, name, root, shingles, keys) of a block of a band's bucket that tie its components together. Classes of side 0 are compared with those of side 1, or
    all with each other if there is one side alone. Pairs that meet in an earlier band are compared there."""
    names, roots = [x[1] for x in cell], np.array([x[2] for x in cell])
    sets = [np.frombuffer(x[3], dtype=np.uint64) for x in cell]
    sizes, keys = np.array([len(x) for x in sets]), np.stack([x[4] for x in cell])
    left = sum(x[0] == 0 for x in cell)
    out = []
    for i in range(left):
        begin = left if left < len(cell) else i + 1
        fine = roots[begin:] != roots[i]
        fine &= np.minimum(sizes[begin:], sizes[i]) >= near.least * np.maximum(sizes[begin:], sizes[i]) - 1e-9
        for k in range(band):
            fine &= keys[begin:, k] != keys[i, k]
        others = np.flatnonzero(fine) + begin
        if not len(others):
            continue
        ends = np.cumsum(sizes[others])
        found = np.concatenate([sets[j] for j in others])
        at = np.minimum(np.searchsorted(sets[i], found), sizes[i] - 1)
        both = np.add.reduceat((sets[i][at] == found).astype(np.int64), ends - sizes[others])
        for j in others[both >= near.least * (sizes[i] + sizes[others] - both) - 1e-9].tolist():
            if roots[i] != roots[j]:
                out.append((names[i], names[j]))
                roots[roots == roots[j]] = roots[i]
    return out


def compared(rows: DataFrame, near: Near) -> DataFrame:
    """(a, b) that tie components together, of rows (cell, band, side, name, root, found, keys)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, now = [], None

        def done() -> pd.DataFrame:
            return pd.DataFrame(ties(cell, now[1], near), columns=["a", "b"], dtype="int64")

        for batch in batches:
            for x in zip(batch["cell"].tolist(), batch["band"].tolist(), batch["side"].tolist(), batch["name"].tolist(), batch["root"].tolist(), batch["found"].tolist(), batch["keys"].tolist()):
                if x[:2] != now:
                    if len(cell) > 1:
                        yield done()
                    cell, now = [], x[:2]
                cell.append(x[2:])
        if len(cell) > 1:
            yield done()

    return rows.repartition("cell").sortWithinPartitions("cell", "band", "side", "name").mapInPandas(run, "a long, b long")


def in_balls(classes: DataFrame) -> DataFrame:
    """(a, b): names that share a fingerprint with, or whose fingerprint is in a SimHash ball with that of, another."""
    one = durable(classes.groupBy("fp").agg(F.min("name").alias("first")))
    same = classes.join(one, "fp").where("name <> first").select(F.col("first").alias("a"), F.col("name").alias("b"))
    near = links(one.select("fp")).select(F.col("a").alias("x"), F.col("b").alias("y"))
    side = lambda c, fp: one.select(F.col("fp").alias(fp), F.col("first").alias(c))
    return same.unionByName(near.join(side("a", "x"), "x").join(side("b", "y"), "y").select("a", "b"))


def near_links(docs: DataFrame, found: DataFrame, near: Near, text: str) -> DataFrame:
    """(node, root) of the names that near duplicates tie together."""
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    classes = durable(found.where(F.size("keys") > 0).groupBy("name").agg(F.first(F.struct("row", "fp", "keys")).alias("c")).select("name", "c.*"))
    met = durable(shared(classes.select("name", F.posexplode("keys").alias("band", "key")).withColumn("bytes", F.lit(0).cast("long")), "name").select("name", "band", "key", "low"))
    balls = in_balls(classes.select("name", "fp"))
    some = durable(balls.unionByName(met.where("name <> low").select(F.col("low").alias("a"), F.col("name").alias("b"))).select(*pair).distinct())
    names = some.select(F.col("a").alias("name")).union(some.select("b")).distinct()
    sets = durable(shingle_sets(docs, classes.join(names, "name", "left_semi").select("row"), near, text))
    first = durable(verified(some, sets, near))
    roots = durable(components(first))
    # Buckets that hold several components still are compared whole.
    sizes = sets.select(F.col("name").alias("_name"), F.octet_length("found").cast("long").alias("bytes"))
    rooted = met.drop("low").join(roots, F.col("name") == F.col("node"), "left").join(sizes, F.col("name") == F.col("_name"))
    open_ = shared(durable(rooted.select("name", "band", "key", "bytes", F.coalesce("root", "name").alias("root"))), "root")
    open_ = open_.withColumn("cuts", F.greatest(F.ceil(F.col("n") / near.block), F.ceil(F.col("sum") / near.block_bytes)).cast("int"))
    open_ = open_.withColumn("mine", F.pmod(F.xxhash64("name"), F.col("cuts").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    cell = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    cells = open_.select(cell.alias("cell"), "band", F.when(F.col("mine") <= F.col("other"), F.lit(0)).otherwise(F.lit(1)).alias("side"), "name", "root")
    cells = cells.join(sets, "name").join(classes.select("name", "keys"), "name")
    return components(first.unionByName(durable(compared(cells, near))))


def one_of_each(docs: DataFrame, near: Near = Near(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates: the first by id, nulls last, and hash of the text.

    Groups are components of links among texts, so rows that share an id, or have none, are told apart by what they say; of equal rows one stays.
    Texts without words, nulls among them, are one group. A text of any length is read whole, a block of its shingles at a time. No rows, no result.
    Other columns stay as they are, whatever their names.
    """
    found = durable(buckets(docs, near, doc_id, text))
    roots = near_links(docs, found, near, text)
    named = found.join(roots, F.col("name") == F.col("node"), "left").select("doc_id", "row", F.coalesce("root", "name").alias("root"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("f")).select("f.doc_id", "f.row")
    mine = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("mine"), F.col(doc_id).cast("long").alias("my_id"), F.xxhash64(text).alias("my_hash"))
    stay = mine.join(first, F.col("my_id").eqNullSafe(F.col("doc_id")) & (F.col("my_hash") == F.col("row")), "left_semi")
    return stay.dropDuplicates(["my_id", "my_hash"]).select(*[F.col("mine")[c].alias(c) for c in docs.columns])
