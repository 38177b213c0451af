"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits have a word between them that differs from each in at most
one. So every distinct fingerprint emits itself and its 64 neighbours, and fingerprints that meet are near.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.llm.common import components, durable, small_batches

#: Bits by which linked fingerprints differ at most. Half of it is emitted.
RADIUS = 2
#: Hashes that are counted at once.
BLOCK = 1 << 16


def majority(blocks, n: int) -> int:
    """The fingerprint of n hashes, which come in blocks: a bit is set if it is in over half of them."""
    bits = np.zeros(64, dtype=np.int64)
    for hashes in blocks:
        bits += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of a text: bit by bit the majority of its word shingles' XXH64."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends[:-1]]]
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    # A block at a time, whatever the length.
    return majority((np.array([h(joined[a:b], seed) for a, b in zip(starts[i : min(n, i + BLOCK)], ends[i + k - 1 :])], dtype="<u8") for i in range(0, n, BLOCK)), n)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64 bit integer."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch["text"].tolist()], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": fps})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, fp long")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) among distinct fingerprints (fp) that hold all of those within the radius together.

    At most 65 fingerprints meet at one word, and any two of those differ in two bits at most; so each is tied to
    the least of them alone, and no pairs within a meeting are lost.
    """
    masks = F.array(F.lit(0).cast("long"), *[F.lit(x).cast("long") for x in (1 << np.arange(64, dtype=np.uint64)).astype(np.uint64).view(np.int64).tolist()])
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = fps.repartition(parts, "fp").select("fp", F.explode(masks).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("word"), "fp")
    met = met.withColumn("first", F.min("fp").over(W.partitionBy("word"))).where(F.col("fp") != F.col("first"))
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("first"))) <= radius).select(F.col("fp").alias("a"), F.col("first").alias("b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links, for each row of docs.

    Null, empty and blank texts have fingerprint zero, which links as any other. Repeated rows are in one component.
    Fingerprints are what is linked, so rows of null id tie others together, too, and have their component; it is null only
    where no row of the component has an id. A text of any length is hashed whole, a block of shingles at a time. No rows, no result. Other columns are not read.
    """
    fps = durable(fingerprints(docs, doc_id, text, shingle))
    classes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("rep").alias("component_id"))
    of = rooted.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id")
    out = fps.join(of, fps["fp"] == of["_fp"], "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
