"""What a session needs before operators in Python run in it."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets the workers import this package, wherever the driver has it from. Once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    file = Path(tempfile.mkdtemp(prefix="tributary-")) / "tributary_package.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(file))
    _shipped.add(sc.applicationId)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt out by columns whose values are nearly all different, for work that is much per row: a small file, which one task reads, is worked on by as many tasks as a shuffle has, and groupings by more than these columns need no other shuffle."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *by)


def once_each(df: DataFrame, column: str, value: Column) -> DataFrame:
    """df with a value that depends on a column alone and costs much: it is computed once for each distinct content, and joined with all rows. Null is a content as any other."""
    each = dealt(df.select(column).distinct(), column).select(F.col(column).alias("_each"), value)
    return df.join(each, F.col(column).eqNullSafe(F.col("_each")), "left").drop("_each")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own, not yet made, below the one of spark.checkpoint.dir; below a local one only where none is set and all runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(shared or f'file://{tempfile.mkdtemp()}').rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written once and read from there by all that follows."""
    path = new_folder(df.sparkSession, "fusion")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """df, written once to the folder of spark.checkpoint.dir and read from there by all that follows; as it is where none is set."""
    return stored(df) if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df
