"""What two runs say differently: keys that only one of them has, and values that aren't the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.session import kept

#: Levels of objects and lists that are taken apart; what lies deeper is compared as text.
DEPTH = 6


def key_difference(a: Column, b: Column) -> tuple[Column, Column]:
    """The keys of one JSON object that another hasn't got, and the other way round, in their orders. What is no object, null among it, has none."""
    keys = lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))
    return F.array_except(keys(a), keys(b)), F.array_except(keys(b), keys(a))


def leaves(outputs: DataFrame, by: str = "entity_id", output: str = "output_json", depth: int = DEPTH) -> DataFrame:
    """(by, path, value) of what an output says at each path, $.a[0].b, as text of JSON. Empty objects and lists are values; a null output says nothing. No shuffle: an output is taken apart where it is."""
    spark = outputs.sparkSession
    rows = outputs.select(by, F.lit("$").alias("path"), F.try_parse_json(output).alias("v")).where("v is not null")
    inner = spark.tvf.variant_explode_outer(F.col("v").outer()).select("pos", "key", "value")
    step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
    for _ in range(depth):
        stays = F.col("pos").isNull()  # neither object nor list, or an empty one
        rows = rows.lateralJoin(inner).select(by, F.when(stays, F.col("path")).otherwise(F.concat("path", step)).alias("path"), F.when(stays, F.col("v")).otherwise(F.col("value")).alias("v"))
    return rows.select(by, "path", F.to_json("v").alias("value"))


def compare(left: DataFrame, right: DataFrame, by: str = "entity_id", output: str = "output_json", depth: int = DEPTH) -> DataFrame:
    """(by, path, change, left, right) wherever two runs' outputs differ: change is only_left, only_right or differs. Outputs without a difference have no row.

    Outputs are brought together by entity, and only those whose texts aren't the same are taken apart and compared by (entity, path): what that costs grows with the entities that changed. The pairs are
    kept in the folder of spark.checkpoint.dir, where one is set. An entity is in a run once; a null id is compared as any other.
    """
    of = lambda df, side: df.select(F.col(by).alias(f"{side}_by"), F.col(output).alias(side))
    both = of(left, "left").join(of(right, "right"), F.col("left_by").eqNullSafe(F.col("right_by")), "full")
    pairs = kept(both.where(~F.col("left").eqNullSafe(F.col("right"))).select(F.coalesce("left_by", "right_by").alias("by"), "left", "right"))
    said = lambda side: leaves(pairs, "by", side, depth).select(F.col("by").alias(f"{side}_by"), F.col("path").alias(f"{side}_path"), F.col("value").alias(side))
    both = said("left").join(said("right"), F.col("left_by").eqNullSafe(F.col("right_by")) & (F.col("left_path") == F.col("right_path")), "full")
    change = F.when(F.col("right_path").isNull(), "only_left").when(F.col("left_path").isNull(), "only_right").when(F.col("left") != F.col("right"), "differs")
    return both.select(F.coalesce("left_by", "right_by").alias(by), F.coalesce("left_path", "right_path").alias("path"), change.alias("change"), "left", "right").where("change is not null")
