"""The long table that everything works on: a row is one fact about one entity from one source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import text as X
from tributary.functions.confidence import source_rank, weight

SCHEMA = "entity_id string, source_seq int, ev_seq long, field_name string, raw_value string, value string, value_map map<string,string>, value_json string, source_id string, source_type string, method string"
COLUMNS = [x.split()[0] for x in SCHEMA.replace("map<string,string>", "map").split(", ")]
#: Their values are a payload of their own, not a string.
PAYLOADS = {"links": "value_map", "extra_attributes": "value_map", "experience": "value_json", "education": "value_json"}


def evidence(df: DataFrame, entity_id: Column, field: Column, raw: Column, source_id: Column, source_type: Column, method: Column, source_seq: Column | None = None, ev_seq: Column | None = None, value_map: Column | None = None, value_json: Column | None = None) -> DataFrame:
    """Rows of df as evidence. Without places, all count as one source's first fact and ties go by value."""
    zero = F.lit(0)
    parts = {"entity_id": entity_id, "source_seq": source_seq if source_seq is not None else zero, "ev_seq": ev_seq if ev_seq is not None else zero, "field_name": field, "raw_value": raw, "value": F.lit(None), "value_map": value_map if value_map is not None else F.lit(None), "value_json": value_json if value_json is not None else F.lit(None), "source_id": source_id, "source_type": source_type, "method": method}
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    return df.select(*[v.cast(kinds[k]).alias(k) for k, v in parts.items()])


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def normalized(ev: DataFrame, normalizers: dict = X.NORMALIZERS) -> DataFrame:
    """value from raw_value by the field's normalizer; payloads pass as they are."""
    payload = F.col("field_name").isin(*PAYLOADS)
    return ev.withColumn("value", F.when(~payload, X.normalize(F.col("field_name"), F.col("raw_value"), normalizers)))


def accepted(ev: DataFrame) -> DataFrame:
    has = (F.col("value").isNotNull() & (F.col("value") != "")) | F.col("value_map").isNotNull() | F.col("value_json").isNotNull()
    return ev.where(has)


def rejected(ev: DataFrame) -> DataFrame:
    """What its normalizer made nothing of."""
    gone = F.col("value").isNull() & F.col("value_map").isNull() & F.col("value_json").isNull()
    return ev.where(gone).select("entity_id", F.col("field_name").alias("field"), "raw_value", "source_id", F.lit("failed normalization").alias("reason"))


def ranked(ev: DataFrame, compat: bool = False) -> DataFrame:
    """With weight and rank."""
    return ev.withColumns({"weight": weight(F.col("source_type")), "rank": source_rank(F.col("source_id"), F.col("source_seq"), compat)})
