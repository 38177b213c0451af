"""Policies of a caller's own for fields: aggregates of a key's facts, and aggregates of a field's keys, compiled into the same two groupings that the library's policies use."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.text import key_of
from tributary.operators.evidence import ranked
from tributary.operators.merge import place


@dataclass(frozen=True, eq=False)
class Policy:
    """How a field's facts become its value.

    partial: aggregates, by name, over the facts of one key, of columns of evidence, its weight and rank.
    value, confidence: aggregates over a field's keys, of a struct that has key, n, first (place), weight, longest (value) and what partial gives.
    key: what tells equal values; a value without one doesn't count.
    Aggregates that Spark combines before a shuffle (sums, extremes, min_by) keep a field of very many facts in small pieces.
    """

    value: Callable[[Column], Column]
    confidence: Callable[[Column], Column]
    partial: Mapping[str, Column]
    key: Callable[[Column], Column] = key_of


def weighted_plurality(weight: Column | None = None) -> Policy:
    """The value of most weight, each fact counting its source's, of equal ones the first; its confidence is its share of the weight. Weights are summed as decimals, so in any order."""
    counted = (F.col("weight") if weight is None else weight).cast("decimal(18,6)")
    score = lambda p: p["score"].cast("double")
    return Policy(lambda p: F.min_by(p["longest"], F.struct(-p["score"], p["first"])), lambda p: F.coalesce(F.try_divide(F.max(score(p)), F.sum(p["score"]).cast("double")), F.lit(0.0)), {"score": F.sum(counted)})


def latest(order: Column | None = None) -> Policy:
    """What was said last, by the place of a fact or an order of one's own; its confidence is the weight of the last who said it."""
    at = F.struct(F.lit(0).alias("o"), place().alias("at")) if order is None else F.struct(order.alias("o"), place().alias("at"))
    return Policy(lambda p: F.max_by(p["last"]["v"], p["last"]["at"]), lambda p: F.max_by(p["last"]["w"], p["last"]["at"]), {"last": F.max_by(F.struct(F.col("value").alias("v"), F.col("weight").alias("w"), at.alias("at")), at)})


def merge_by(ev: DataFrame, policies: Mapping[str, Policy], by: list[str] = ["entity_id"], rows: bool = False) -> DataFrame:
    """(entity_id, field_name, value, confidence, n_values) of the fields that policies name, each by its own, all in two groupings.

    Facts without a value, or of an empty key, don't count; a field without others has no row. rows: with `groups`, (key, rows) of each key as merge_single has them, which grow with the facts.
    """
    field, kinds = F.col("field_name"), list(dict.fromkeys(policies.values()))
    key, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, policy in policies.items():
        key = F.when(field == name, policy.key(F.col("value"))).otherwise(key)
        number = F.when(field == name, F.lit(kinds.index(policy))).otherwise(number)
    facts = ranked(ev.where(field.isin(*policies) & (F.col("value") != ""))).withColumn("_key", key).withColumn("_kind", number).where("_key <> ''")
    at = place()
    group = [*by, "field_name", "_kind", "_key"]
    row = F.struct(at.alias("at"), F.col("source_id").alias("source"), "method", F.col("raw_value").alias("raw"))
    made = [F.struct(*[v.alias(k) for k, v in policy.partial.items()]).alias(f"_p{i}") for i, policy in enumerate(kinds) if policy.partial]
    keys = facts.groupBy(*group).agg(
        F.count("*").alias("n"), F.min(at).alias("first"), F.max("weight").alias("weight"), F.min(F.struct((-F.length("value")).alias("l"), at.alias("at"))).alias("longest"),
        *made, *([F.array_sort(F.collect_list(row)).alias("_rows")] if rows else []),
    )
    base = [F.col("_key").alias("key"), "n", "first", "weight", F.col("longest.at.value").alias("longest")]
    packed = [F.struct(*base, *[F.col(f"_p{i}")[k].alias(k) for k in policy.partial]).alias(f"_s{i}") for i, policy in enumerate(kinds)]
    keys = keys.select(*[c for c in group if c != "_key"], "_key", *packed, *(["_rows"] if rows else []))
    ends = [f(F.col(f"_s{i}")).alias(f"_{name}{i}") for i, policy in enumerate(kinds) for name, f in (("value", policy.value), ("conf", policy.confidence))]
    gathered = [F.array_sort(F.collect_list(F.struct(F.col("_key").alias("key"), F.col("_rows").alias("rows")))).alias("groups")] if rows else []
    one = keys.groupBy(*by, "field_name", "_kind").agg(*ends, F.count("*").alias("n_values"), *gathered)
    pick = lambda name, kind: F.coalesce(*[F.when(F.col("_kind") == i, F.col(f"_{name}{i}").cast(kind)) for i in range(len(kinds))])
    return one.select(*by, "field_name", pick("value", "string").alias("value"), pick("conf", "double").alias("confidence"), "n_values", *(["groups"] if rows else []))


def merged_fields(ev: DataFrame, policies: Mapping[str, Policy]) -> DataFrame:
    """(entity_id, field_name, single): what merge_by gives as merge_single's struct. sources and methods are those of all facts, in order; a field in conflict lists the raw values of its other keys."""
    one = merge_by(ev, policies, rows=True)
    winner = F.lit(None).cast("string")
    for name, policy in policies.items():
        winner = F.when(F.col("field_name") == name, policy.key(F.col("value"))).otherwise(winner)
    one = one.withColumn("_win", winner).withColumn("_all", F.array_sort(F.flatten(F.transform("groups", lambda g: g["rows"]))))
    others = F.filter("groups", lambda g: ~g["key"].eqNullSafe(F.col("_win")))
    each = lambda rows, name: F.transform(rows, lambda r: r[name])
    lost = F.map_from_entries(F.transform(others, lambda g: F.struct(g["key"], each(g["rows"], "raw"))))
    conflict = F.col("n_values") > 1
    single = F.struct("value", "confidence", each(F.col("_all"), "source").alias("sources"), each(F.col("_all"), "method").alias("methods"), conflict.alias("conflict"), F.when(conflict, lost).alias("conflicting_values"))
    return one.select("entity_id", "field_name", single.alias("single"))
