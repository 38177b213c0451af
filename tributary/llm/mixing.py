"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, served again from the front when it
is through. A copy of a document finishes at the virtual time ``words of its source so far / target``;
all copies are range-sorted by these times and taken until the budget's words are reached. The cut lies in one range, found by the ranges' sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.llm.common import WORD, durable

#: Rows of a part of a source's queue, and of a range of the global order; both are summed row by row by one task.
PART, RANGE = 100_000, 100_000
#: Most ranges of one sort; where that makes them larger, the one that holds the cut is sorted into ranges again.
RANGES = 20_000
#: Columns that the operator adds; working columns of clashing names would not survive.
ADDED = ("size", "source_size", "target", "taken", "copies")


@dataclass(frozen=True)
class Mix:
    """weights: given to the sources in code point order, null last, over and over. budget: total words as a part of all words.
    passes: how often a document may be used at most."""

    weights: tuple[int, ...] = (3, 1, 2)
    budget: float = 1.5
    passes: int = 2


def digits(rows: int) -> int:
    """So many digits of the hash cut so many rows, even of one source, into parts; three at least."""
    n = 3
    while 16**n * PART < rows:
        n += 1
    return n


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(_s, source_size, target) of each source from rows (_s, size).

    With sources capped at passes times their size, the level that all the others share by weight is
    the largest of those had by capping the first j sources in the order of cap / weight.
    The windows run over one row a source.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.pmod(F.col("_n"), F.lit(len(mix.weights))) + 1).cast("int"))
    per = sizes.groupBy("_s").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("_n", F.row_number().over(W.orderBy(F.col("_s").asc_nulls_last())) - 1).withColumn("_w", weight).withColumn("_cap", (F.lit(float(mix.passes)) * F.col("source_size")))
    before = W.orderBy(F.col("_cap") / F.col("_w"), "_n").rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy()
    level = (F.lit(float(mix.budget)) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    per = per.withColumn("_level", level)
    per = per.withColumn("_top", F.max("_level").over(all_rows))
    return per.select("_s", "source_size", F.least(F.col("_cap"), F.col("_top") * F.col("_w")).alias("target"))


#: What copies are ordered by, and its types.
ORDER = {"v": "double", "n": "boolean", "s": "string", "h": "string", "i": "string", "z": "long"}


def cut(copies: DataFrame, rows: int, budget: float) -> dict | None:
    """The last copy, in the global order, that the budget's words reach; an empty one if they reach none, None if they hold all.

    The copies are sorted into ranges; the one that the budget ends in is sorted into ranges again until it has few rows, or only equal ones.
    """
    order, before, earlier = list(ORDER), 0, None
    while True:
        ranged = durable(copies.select(*order).repartitionByRange(min(RANGES, max(1, -(-rows // RANGE))), *order).withColumn("range", F.spark_partition_id()))
        ends = ranged.groupBy("range").agg(F.sum("z").alias("z"), F.count("*").alias("n")).withColumn("end", F.lit(before) + F.sum("z").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, 0)))
        first = ends.where(F.col("end") > budget).orderBy("range").select("range", "n", (F.col("end") - F.col("z")).alias("before")).first()
        if first is None:
            return None
        # What lies in earlier ranges is taken: where the first copy of this one is too large, the last of those is the cut.
        last = ranged.where(F.col("range") < first["range"]).agg(F.max(F.struct(*order)).alias("at")).first()["at"]
        earlier = last.asDict() if last else earlier
        copies, before = ranged.where(F.col("range") == first["range"]), first["before"]
        if first["n"] <= 4 * RANGE or first["n"] == rows:
            break
        rows = first["n"]
    run = F.lit(before) + F.sum("z").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    last = copies.withColumn("run", run).where(F.col("run") <= budget).agg(F.max(F.struct(*order)).alias("at")).first()["at"]
    return last.asDict() if last else earlier or {}


def mix_sources(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with size, source_size, target, copies and taken (size times copies): how often the mix uses each row.

    A null text has size 0; documents without words never fill the mix, they are used once if their turn
    comes. A null source is a source of its own, the last. Equal rows are told apart by nothing and
    may stand for one another. A null id is hashed by its text. An empty table gives no rows. A text of any length is one document, taken or not.
    Columns of docs stay, but those named like the added ones or beginning with ``_mix`` are replaced.
    A source's hot queue is cut into parts by hash and the global order into ranges, so no task holds more than a part of either.
    """
    drop = [c for c in docs.columns if (c in ADDED or c.startswith("_mix")) and c not in (doc_id, text, source)]
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit("")))
    base = docs.drop(*drop).withColumns({"size": n_words(F.col(text)), "_mix_s": F.col(source).cast("string"), "_mix_h": key})

    light = durable(base.select("_mix_s", "_mix_h", F.col(doc_id).alias("_mix_id"), "size"))
    part = F.substring("_mix_h", 1, digits(light.count()))
    base, light = base.withColumn("_mix_p", part), light.withColumn("_mix_p", part)
    goal = durable(targets(light.select(F.col("_mix_s").alias("_s"), "size"), mix))
    sums = light.groupBy("_mix_s", "_mix_p").agg(F.sum("size").alias("sum"), F.count("*").alias("n"))
    offset = F.coalesce(F.sum("sum").over(W.partitionBy("_mix_s").orderBy("_mix_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = sums.withColumn("_mix_off", offset).join(goal, F.col("_mix_s").eqNullSafe(F.col("_s")))
    parts = durable(parts.select(F.col("_mix_s").alias("_mix_k"), F.col("_mix_p").alias("_mix_q"), "_mix_off", "source_size", "target", "sum", "n"))
    total = parts.agg(F.sum("sum").alias("t"), F.sum("n").alias("n")).first()
    budget, parts = float(mix.budget) * (total["t"] or 0), parts.drop("sum", "n")

    def queued(rows: DataFrame, i: str) -> DataFrame:
        joined = rows.join(parts, F.col("_mix_s").eqNullSafe(F.col("_mix_k")) & (F.col("_mix_p") == F.col("_mix_q")))
        inside = W.partitionBy("_mix_s", "_mix_p").orderBy("_mix_h", i, "size").rowsBetween(W.unboundedPreceding, 0)
        return joined.withColumn("_mix_cum", F.col("_mix_off") + F.sum("size").over(inside))

    def finish(epoch: int) -> Column:
        at = (F.col("_mix_cum") + F.lit(epoch) * F.col("source_size")).cast("double") / F.col("target")
        return F.when(F.col("target") > 0, at).otherwise(F.lit(float(epoch)))

    def at(epoch: int, i: str) -> Column:
        """The place of a copy in the global order."""
        return F.struct(finish(epoch).alias("v"), F.col("_mix_s").isNull().alias("n"), F.coalesce("_mix_s", F.lit("")).alias("s"), F.col("_mix_h").alias("h"), F.coalesce(F.col(i).cast("string"), F.lit("")).alias("i"), F.col("size").alias("z"))

    copies = queued(light, "_mix_id").select(F.explode(F.array(*[at(e, "_mix_id") for e in range(mix.passes)])).alias("at")).select("at.*")
    upto = cut(copies, (total["n"] or 0) * mix.passes, budget)
    if upto is None:
        takes = [F.lit(True)] * mix.passes
    elif not upto:
        takes = [F.lit(False)] * mix.passes
    else:
        last = F.struct(*[F.lit(upto[k]).cast(kind).alias(k) for k, kind in ORDER.items()])
        takes = [at(e, doc_id) <= last for e in range(mix.passes)]
    count = takes[0].cast("long")
    for t in takes[1:]:
        count = count + F.when(F.col("size") > 0, t.cast("long")).otherwise(F.lit(0))
    out = queued(base, doc_id).withColumn("copies", count)
    out = out.withColumn("taken", F.col("size") * F.col("copies"))
    return out.drop(*[c for c in out.columns if c.startswith("_mix") and c not in (doc_id, text, source)])


def mixed_rows(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, with docs' own columns, whatever their names.

    Null texts, null sources and null ids, ties, repeated rows, very long texts and empty tables: as mix_sources() has them. Of equal rows each is taken for itself.
    """
    own = [doc_id, text, source]
    rest = [c for c in docs.columns if c not in own]
    packed = docs.select(*own, F.struct(*(docs[c] for c in rest)).alias("rest")) if rest else docs
    out = mix_sources(packed, mix, doc_id, text, source).where("copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(c) if c in own else F.col("rest")[c].alias(c) for c in docs.columns])
