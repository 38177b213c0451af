"""Embedding near-duplicates by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions; the floors of (projection + shift) / width, some in a row, are a
bucket of a table. Vectors that share a bucket in any table are compared by their cosine. Over normalised vectors the distance
is sqrt(2 - 2 cosine), so the chance that a link is found follows from width, directions and tables alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.common import components, durable, small_batches


@dataclass(frozen=True)
class Hashing:
    """tables: so many; each has so many hashes in a row, of that width. block: vectors of a bucket that are compared with as many others at once. seed: of the directions."""

    tables: int = 18
    hashes: int = 6
    width: float = 1.25
    block: int = 1024
    seed: int = 7

    def recall(self, cosine: float) -> float:
        """The chance that a pair of this cosine shares a bucket."""
        c = math.sqrt(max(0.0, 2 - 2 * cosine))
        if c == 0:
            return 1.0
        r = self.width / c
        one = math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))
        return 1 - (1 - one**self.hashes) ** self.tables

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """An int32 for each vector (row) and table."""
        rng = np.random.default_rng([self.seed, unit.shape[1]])
        n = self.tables * self.hashes
        directions, shift = rng.standard_normal((unit.shape[1], n)), rng.uniform(0, self.width, n)
        cells = np.floor((unit @ directions + shift) / self.width).astype(np.int64).reshape(len(unit), self.tables, self.hashes)
        odd = np.random.default_rng(self.seed).integers(1 << 62, size=self.hashes) | 1
        mixed = (cells * odd).sum(axis=2, dtype=np.int64).view(np.uint64)
        mixed ^= mixed >> np.uint64(29)
        return (mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, whatever their scale, in double precision."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def found(a: np.ndarray, b: np.ndarray, keys_a: np.ndarray, keys_b: np.ndarray, t: int, least: float, same: bool) -> np.ndarray:
    """Which pairs of the rows of a and b link, and meet in no earlier table than t. same: a is b; then each pair is told once, as (smaller, larger)."""
    near = a @ b.T >= least
    if same:
        near = np.triu(near, 1)
    if t and near.any():
        x, y = np.nonzero(near)
        for i in range(0, len(x), 1 << 20):
            p, q = x[i : i + (1 << 20)], y[i : i + (1 << 20)]
            earlier = np.zeros(len(p), dtype=bool)
            for k in range(t):
                earlier |= keys_a[p, k] == keys_b[q, k]
            near[p[earlier], q[earlier]] = False
    return near


def spanning(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) for the bipartite links between nodes a and b."""
    rows, cols = a.copy(), b.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_cols = np.minimum(cols, np.where(near, rows[:, None], top).min(axis=0, initial=top))
        new_rows = np.minimum(rows, np.where(near, new_cols[None, :], top).min(axis=1, initial=top))
        if (new_cols == cols).all() and (new_rows == rows).all():
            break
        rows, cols = new_rows, new_cols
    nodes, roots = np.concatenate([a, b]), np.concatenate([rows, cols])
    keep = nodes != roots
    return nodes[keep], roots[keep]


def classes(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame]:
    """All rows as (vec_id, h1, h2), the hashes null where a vector links with nothing; and a row for each distinct vector of a label: (h1, h2, rep, least, copies, label, v). rep is its first hash, by which it is known, least its least id."""
    e = F.col("e")
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("e"))
    fine = e.isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & F.coalesce(F.exists(e, lambda x: x != 0), F.lit(False))
    key = lambda seed: F.when(fine, F.xxhash64(F.lit(seed), F.col("label").cast("string"), F.size(e), e))
    v = v.select("vec_id", "label", "e", key(1).alias("h1"), key(2).alias("h2"))
    one = v.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").cast("string").alias("label"), F.first("e").alias("v")).withColumn("rep", F.col("h1"))
    return v.select("vec_id", "h1", "h2"), one


def near_vectors(vectors: DataFrame, least: float = 0.93, hashing: Hashing = Hashing(), vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors; links are pairs of one label and length whose cosine is at least ``least``.

    Copies of a vector link with each other and with all that links with any of them; they are compared once, with
    their number as weight. A bucket of many vectors is cut into blocks, and each pair of blocks is a task's; a pair of vectors counts in the
    first table in which they meet. No pairs are sent on: a task gives each vector's links and a spanning forest.
    Vectors that are null, empty, zero, or hold null or non-finite components, and those of null label, have no links and stay
    alone in a component of their own id. A null vec_id takes part as a vector, ties others together, is no component's name and is not kept. Rows that share an id
    but not a vector are each told by their own vector; a vector of any length is compared whole. No rows, no result. Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    each, one = classes(vectors, vec_id, embedding, label)
    one = durable(one)
    each = durable(each)
    raw = np.dtype("<f4" if isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType) else "<f8")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["v"].map(len)
            for _, part in batch.groupby(sizes):
                unit = units(np.stack([np.asarray(x, dtype=np.float64) for x in part["v"]]))
                keys = hashing.buckets(unit)
                yield pd.DataFrame({"rep": part["rep"], "copies": part["copies"], "label": part["label"], "v": [np.asarray(x, dtype=raw).tobytes() for x in part["v"]], "keys": list(keys)})

    hashes = one.select("rep", "copies", "label", "v").mapInPandas(hashed, f"rep long, copies long, label string, v binary, keys array<int>")
    hashes = durable(hashes)
    dim = F.octet_length("v").alias("dim")
    spread = hashes.select("rep", "label", dim, F.posexplode("keys").alias("t", "key"))
    # Buckets with one vector are done; those with more than a block are cut.
    counts = spread.groupBy("label", "dim", "t", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("cuts", F.ceil(F.col("n") / hashing.block).cast("int"))
    main = spread.join(counts, ["label", "dim", "t", "key"])
    mine = F.pmod(F.xxhash64("rep"), F.col("cuts").cast("long")).cast("int")
    main = main.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    main = main.select("rep", "t", F.xxhash64("label", "dim", "t", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), F.when(F.col("mine") <= F.col("other"), F.lit(0)).otherwise(F.lit(1)).alias("side"), (F.col("mine") == F.col("other")).alias("same"))
    main = main.join(hashes.select("rep", "copies", "v", "keys"), "rep")
    main = main.repartition("cell").sortWithinPartitions("cell", "side", "rep")

    def compare(cell: list[tuple]) -> pd.DataFrame | None:
        rep = np.array([x[0] for x in cell], dtype=np.int64)
        t, same = cell[0][1], cell[0][4]
        unit = units(np.frombuffer(b"".join(x[6] for x in cell), dtype=raw).reshape(len(cell), -1))
        copies, keys = np.array([x[5] for x in cell], dtype=np.int64), np.stack([x[7] for x in cell])
        n = len(cell) if same else sum(x[3] == 0 for x in cell)
        if not n or (not same and n == len(cell)):
            return None
        left, right = slice(0, n), slice(0, n) if same else slice(n, None)
        near = found(unit[left], unit[right], keys[left], keys[right], t, least, same)
        if not near.any():
            return None
        links = np.zeros(len(cell), dtype=np.int64)
        links[left] += near @ copies[right]
        links[right] += copies[left] @ near
        a, b = spanning(near, rep[left], rep[right])
        got = links > 0
        return pd.DataFrame({"rep": np.concatenate([rep[got], a]), "links": np.concatenate([links[got], np.zeros(len(a), dtype=np.int64)]), "root": pd.array(np.concatenate([rep[got], b]), dtype="Int64")})

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, now, out, rows = [], None, [], 0
        for batch in batches:
            for x in zip(batch["rep"].tolist(), batch["t"].tolist(), batch["cell"].tolist(), batch["side"].tolist(), batch["same"].tolist(), batch["copies"].tolist(), batch["v"].tolist(), batch["keys"].tolist()):
                if x[2] != now:
                    if len(cell) > 1 and (made := compare(cell)) is not None:
                        out.append(made)
                        rows += len(made)
                    cell, now = [], x[2]
                    if rows > 50_000:
                        yield pd.concat(out)
                        out, rows = [], 0
                cell.append(x)
        if len(cell) > 1 and (made := compare(cell)) is not None:
            out.append(made)
        if out:
            yield pd.concat(out)

    made = durable(main.mapInPandas(compared, "rep long, links long, root long"))
    links = made.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "_l")
    roots = components(made.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    of = one.select("h1", "h2", "rep", "least", "copies").join(links, F.col("rep") == F.col("_l"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    of = of.select(F.col("h1").alias("_1"), F.col("h2").alias("_2"), "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    names = of.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    of = of.join(names, F.col("root") == F.col("_root")).select("_1", "_2", "n_links", "component_id")
    out = each.join(of, (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
