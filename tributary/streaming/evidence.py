"""Streams of evidence: counts by value as they grow, and profiles of the entities that a batch touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tributary.functions.confidence import confidence, weight
from tributary.functions.text import key_of
from tributary.operators.evidence import normalized
from tributary.plans.engine import RunResult, resolve


def value_counts(stream: DataFrame, at: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Of each window, entity, field and key: n and the confidence of so many agreeing rows. State is dropped when the watermark has passed a window."""
    rows = normalized(stream).where("value is not null").withColumn("key", key_of(F.col("value"))).withWatermark(at, late)
    out = rows.groupBy(F.window(at, window).alias("window"), "entity_id", "field_name", "key").agg(F.count("*").alias("n"), F.max(weight(F.col("source_type"))).alias("weight"))
    return out.withColumn("confidence", confidence(F.col("weight"), F.col("n")))


def resolve_touched(stream: DataFrame, store: str, sink: Callable[[RunResult, int], None], checkpoint: str) -> StreamingQuery:
    """Appends each batch to the evidence stored as Parquet and hands the newly resolved profiles of its entities to sink."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{store}/batch={number}")  # again the same if the batch is repeated
        spark = rows.sparkSession
        touched = spark.read.schema(rows.schema).parquet(f"{store}/batch={number}").select("entity_id").distinct()
        sink(resolve(spark.read.schema(rows.schema).parquet(store).drop("batch").join(touched, "entity_id", "left_semi")), number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).start()
