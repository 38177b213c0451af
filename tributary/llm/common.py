"""What the operators share: the shared folder, durable intermediate results, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.session import ship

#: What separates words, as a pattern for Java, RE2 and Python alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch: a batch of long texts must fit in a Python worker beside others.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tributary-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder if "://" in folder else ("file:" + folder if folder.startswith("/") else folder)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own, not yet made, below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and read from a table in the shared folder from now on, so that a lost executor loses nothing."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Before an operator in Python: an Arrow batch holds so many rows, and the workers can import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forest(pairs):
    """For mapInPandas over columns (a, b): the same components by fewer edges, each to its component's least node.

    At most a million edges are held; what is held is then passed on and forgotten, so memory is bounded.
    """
    import pandas as pd

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def held():
        nodes = [x for x in parent if find(x) != x]
        return pd.DataFrame({"a": pd.Series(nodes, dtype="int64"), "b": pd.Series([find(x) for x in nodes], dtype="int64")})

    for batch in pairs:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                parent.setdefault(min(x, y), min(x, y))
        if len(parent) > 1_000_000:
            yield held()
            parent.clear()
    yield held()


def _edges_hash(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31))).alias("s")).first()
    return row["n"], row["x"], row["s"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half-round: neighbours above (large) or up to (small) each node are tied to the node's least neighbour.

    The least neighbour comes from an aggregation that combines before the shuffle and a join, whose
    skewed side Spark can split; no node's neighbours need be in one task.
    """
    around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    tied = around.join(least, "a")
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # edges go from the larger node to the smaller one here
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, native: bool = False, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b), both long: root is the least node of its component.

    Alternating large and small stars, in rounds that grow as the logarithm of the nodes; every
    round's edges are written to the shared folder. Nulls and loops are ignored; no edges, no rows.
    Unless native, each partition first thins out its own edges.
    """
    wide = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    if native:
        now = durable(wide.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    else:
        now = durable(wide.mapInPandas(forest, "a long, b long").distinct())
    before = _edges_hash(now)
    for _ in range(rounds):
        if not before[0]:
            break
        now = durable(_star(_star(now, True), False))
        after = _edges_hash(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())


def checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df, already durable, marked for broadcast only if it has so few rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
