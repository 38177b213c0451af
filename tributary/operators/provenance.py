"""Who said what of a field, as long tables: a fact a row, nothing gathered, so a field of an entity may have any number of facts.

merge_single() gives the same as arrays, which is fine for fields that few sources speak of. Here what wins is decided from one row for each distinct value, and the facts are
joined with it; Spark splits the join where an entity is hot. Arrays are made, if at all, by who shows the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.text import key_of
from tributary.operators.merge import CONTAINMENT, decisions, value_groups
from tributary.session import stored

BY = ["entity_id", "field_name"]
#: A fact's place among those of its field.
ORDER = ["source_seq", "ev_seq", "source_id", "value"]


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "number") -> DataFrame:
    """df with the number of each row within its group, from 0, without a group's rows being in one task.

    Rows are sorted over all partitions and written once; a group's running sum is over one row for each partition that has some of it. Rows of equal order are numbered either way.
    """
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", at)
    rows = stored(rows.withColumn("_part", F.shiftright("_at", 33)))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*by, "_part"]]
    return rows.alias("r").join(parts.alias("p"), same).select(*[F.col(f"r.{c}") for c in df.columns], (F.col("p._before") + F.col("r._at") - F.col("p._first")).alias(name))


def facts(ev: DataFrame, by: list[str] = BY, containment: tuple[str, ...] = CONTAINMENT) -> DataFrame:
    """Each fact (by, source_seq, ev_seq, source_id, value, raw_value, method, key) with the decision of its field: case (agreed, contained, plurality, tie), value it came to as winner, and won: whether it says so."""
    won = decisions(ev, by, containment).select(*[F.col(c).alias(f"_{c}") for c in by], "case", F.col("key").alias("_key"), F.col("value").alias("winner"))
    rows = ev.where(F.col("value") != "").select(*by, *ORDER, "raw_value", "method", key_of(F.col("value")).alias("key"))
    return rows.join(won, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).select(*by, *ORDER, "raw_value", "method", "key", "case", "winner", ((F.col("case") != "tie") & (F.col("key") == F.col("_key"))).alias("won"))


def _sources() -> Column:
    """Whether a fact's source is among those of its field."""
    return F.col("won") | F.col("case").isin("contained", "tie")


def _methods() -> Column:
    return F.col("won") | (F.col("case") == "tie")


def sources(told: DataFrame) -> DataFrame:
    """The facts(), those whose sources stand for their field's value: the winners', and all of a tie or of a fuller name."""
    return told.where(_sources())


def conflicting(told: DataFrame) -> DataFrame:
    """The facts() against their field's value: of a tie all."""
    return told.where(~F.col("won"))


def provenance_rows(told: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, source, method, at) of facts(): the distinct pairs of a field in the order of at.

    A pair is a fact's source and method, but for a fuller name: there the sources of all and the methods of those who said it in full are paired one by one, as far as
    the methods reach. Pairs are combined before they are shuffled.
    """
    place = F.struct(*[F.col(c) for c in ORDER])
    plain = told.where((F.col("case") != "contained") & _sources()).select(*by, F.col("source_id").alias("source"), "method", F.struct(F.lit(0).cast("long").alias("n"), place.alias("place")).alias("at"))
    whole = told.where("case = 'contained'")
    s, m = numbered(whole, by, ORDER).select(*by, "number", "source_id", *[F.col(c).alias(f"_{c}") for c in ORDER]), numbered(whole.where("won"), by, ORDER).select(*[F.col(c).alias(f"m_{c}") for c in by], F.col("number").alias("m_number"), "method")
    paired = s.join(m, [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in by] + [F.col("number") == F.col("m_number")])
    paired = paired.select(*by, F.col("source_id").alias("source"), "method", F.struct(F.col("number").alias("n"), F.struct(*[F.col(f"_{c}").alias(c) for c in ORDER]).alias("place")).alias("at"))
    return plain.union(paired).groupBy(*by, "source", "method").agg(F.min("at").alias("at"))


def conflict_counts(ev: DataFrame, by: list[str] = BY, containment: tuple[str, ...] = CONTAINMENT) -> DataFrame:
    """(by, key, n) of the values against the field's, all of a tie: one row for each distinct value is all that is shuffled twice."""
    won = decisions(ev, by, containment).where("case <> 'agreed'").select(*[F.col(c).alias(f"_{c}") for c in by], "case", F.col("key").alias("_key"))
    groups = value_groups(ev, by, rows=False)
    return groups.join(won, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).where((F.col("case") == "tie") | (F.col("key") != F.col("_key"))).select(*by, "key", "n")
