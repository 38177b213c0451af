"""Results as JSON, nulls kept; and whole runs, which are there entirely or not at all."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of a run, and where it is told that they are complete.
TABLES = {"output": "entity_id string, output_json string, errors array<string>", "canonical": "entity_id string, profile string", "warnings": "entity_id string, kind string, message string"}
COMMITS, COMMIT = "_commits", "run string, attempt string, at timestamp"


def json_lines(df: DataFrame) -> DataFrame:
    """One column ``json``, an object a row, with nulls."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str, column: str | None = None) -> None:
    """JSON lines; column: one that holds objects as text already."""
    (df.select(column) if column else json_lines(df)).write.mode("overwrite").text(path)


def envelope(result) -> DataFrame:
    """A row for each entity of a run: its output, canonical profile, warnings and errors, as JSON."""
    own = result.warnings.groupBy("entity_id").agg(F.array_sort(F.collect_list("message")).alias("warnings"))
    rows = result.told.select("entity_id", F.col("output_json").alias("output"), "errors", F.col("profile").alias("canonical"))
    # Never broadcast: by the size of the files that profiles are kept in, packed, Spark takes the warnings of any number of entities for few.
    return rows.join(own.hint("merge"), "entity_id", "left")


@dataclass
class Written:
    """A run that was written: its tables as DataFrames (entity_id, output_json, errors), (entity_id, profile) and (entity_id, kind, message)."""

    output: DataFrame
    canonical: DataFrame
    warnings: DataFrame


def _commits(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(COMMIT).json(f"{folder}/{COMMITS}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def _attempt(spark: SparkSession, folder: str, run: str) -> str | None:
    """The attempt that counts: the first that was committed, whoever else came later."""
    first = _commits(spark, folder).where(F.col("run") == run).agg(F.min_by("attempt", F.struct("at", "attempt")).alias("a")).first()
    return first["a"]


def write_run(result, folder: str, run: str | None = None) -> str:
    """Writes output, canonical profiles and warnings of a run as JSON lines below folder, and returns its name.

    Each attempt has folders of its own. Only when all are written a line in _commits says that the attempt is the run, so readers see all of it or nothing, whatever was killed;
    the line's file is moved into place by Spark's committer. A run of a name that is there already is not written again, and of two that race the first to commit counts.
    """
    spark = result.output.sparkSession
    run, attempt, folder = run or uuid.uuid4().hex, uuid.uuid4().hex, folder.rstrip("/")
    if _attempt(spark, folder, run):
        return run
    profile = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    tables = {"output": result.output.select("entity_id", "output_json", "errors"), "canonical": result.canonical.select("entity_id", profile.alias("profile")), "warnings": result.warnings.select("entity_id", "kind", "message")}
    for name, df in tables.items():
        df.write.option("ignoreNullFields", "false").json(f"{folder}/{attempt}/{name}")
    spark.range(1).select(F.lit(run).alias("run"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("at")).write.mode("append").json(f"{folder}/{COMMITS}")
    return run


def read_run(spark: SparkSession, folder: str, run: str) -> Written:
    """A run that write_run() has committed; KeyError if none is."""
    folder = folder.rstrip("/")
    attempt = _attempt(spark, folder, run)
    if attempt is None:
        raise KeyError(run)
    return Written(**{name: spark.read.schema(kind).json(f"{folder}/{attempt}/{name}") for name, kind in TABLES.items()})
