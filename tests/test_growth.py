"""What a query costs grows no faster than its input: nothing large is broadcast, small files are worked on by many tasks, equal contents are worked on once."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tributary import session
from tributary.plans import compare
from tributary.plans import queries as Q
from tributary.sources import csv_splits

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@tables
def test_envelopes_are_not_broadcast(spark):
    """an output and its profile are of one row, and warnings are joined by sorting, however few Spark takes them for."""
    shown = plan(Q.run_envelopes(spark, DIR))
    assert "Broadcast" not in shown and shown.count("SortMergeJoin") == 1


def test_runs_alike_are_not_taken_apart(spark, monkeypatch):
    """only outputs that changed are taken apart."""
    taken = []
    whole = compare.leaves
    monkeypatch.setattr(compare, "leaves", lambda df, *a: taken.append(df.count()) or whole(df, *a))
    a = spark.range(100).select(F.col("id").alias("entity_id"), F.lit('{"a":1}').alias("output_json"))
    b = a.withColumn("output_json", F.when(F.col("entity_id") == 7, '{"a":2}').otherwise(F.col("output_json")))
    assert [tuple(r) for r in compare.compare(a, b).collect()] == [(7, "$.a", "differs", "1", "2")] and taken == [1, 1]


@tables
def test_dates_are_read_once(spark):
    """a day is read once, however many orders are of it; null is a day as any other."""
    shown = Q.date_spellings(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert shown.index("Join") < shown.index("regexp_replace") and "Aggregate" in shown
    asked = spark.sparkContext.accumulator(0)

    def ask(v):
        asked.add(1)
        return f"<{v}>"

    df = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("v"))
    got = session.once_each(df, "v", F.udf(ask)("v").alias("w")).collect()
    assert len(got) == 300 and {(r.v, r.w) for r in got} == {(None, "<None>"), (1, "<1>"), (2, "<2>")} and asked.value == 3


@tables
def test_runs_are_read_back_without_broadcast(spark):
    """F4."""
    assert "Broadcast" not in plan(Q.run_sinks(spark, DIR))


@tables
@pytest.mark.parametrize("name", ["project_missing", "project_default_output", "project_public"])
def test_small_files_are_dealt_out(spark, name):
    """customers go to many tasks before they become evidence, and no grouping deals them out again."""
    shown = Q.QUERIES[name](spark, DIR)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert Q.customer_evidence(spark, DIR).rdd.getNumPartitions() >= 4
    assert "entity_id" not in "".join(x for x in shown.splitlines() if "Exchange hash" in x)


@tables
def test_profiles_are_read_once(spark):
    """a payload is read where it is, not for each link that leads to it."""
    shown = Q.enrich_left_join(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert shown.index("Join") < shown.index("parseJson")


@tables
def test_configs_side_by_side_are_not_joined(spark):
    """F8: two configs' outputs come from one pass over the profiles."""
    assert "Join" not in plan(Q.config_key_diff(spark, DIR))


def test_python_holds_pieces_of_files():
    """what a task's Python gives back at a time is bounded by characters, not by rows alone."""
    batch = pa.RecordBatch.from_pylist([{"file": "f", "row": n, "delimiter": ",", "head": ["name", "note"], "text": f"{n},{'x' * 10_000}"} for n in range(1, 1001)])
    out = list(csv_splits._facts(iter([batch])))
    assert sum(b.num_rows for b in out) == 2000 and max(sum(map(len, b.column("raw_value").to_pylist())) for b in out) <= csv_splits.MOST_CHARACTERS + 20_000
