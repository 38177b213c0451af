"""The optional last step: a model's remarks on each output, by a function that the caller provides."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.text import unfenced
from tributary.session import new_folder, ship

#: Keys of the remarks, with the other names that models give them, and what errors are told as: fixed values.
KEYS = {"summary": "recruiter_summary", "strengths": None, "recommended_roles": None, "missing_information": "missing_info", "potential_concerns": "concerns"}
ERRORS = (
    (("429", "quota", "exhausted"), "API quota exceeded across all fallback models."),
    (("api_key", "unauthorized", "401"), "Invalid API key provided."),
    (("503", "unavailable"), "All models are currently overloaded. Please try again later."),
)


def parsed(answer: Column) -> Column:
    """A struct of the keys from a model's answer; null if it isn't JSON. Lists are arrays of strings, what is absent is empty."""
    v = F.try_parse_json(unfenced(answer))

    def get(key: str, kind: str, empty: Column) -> Column:
        names = [key, *([KEYS[key]] if KEYS[key] else [])]
        return F.coalesce(*[F.try_variant_get(v, f"$.{n}", kind) for n in names], empty)

    none = F.array().cast("array<string>")
    fields = [get(k, "string", F.lit("")).alias(k) if k == "summary" else get(k, "array<string>", none).alias(k) for k in KEYS]
    return F.when(v.isNotNull(), F.struct(*fields))


def error_message(error: Column) -> Column:
    out, low = None, F.lower(error)
    for words, message in ERRORS:
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
        out = F.when(hit, message) if out is None else out.when(hit, message)
    return out.otherwise(F.concat(F.lit("Model error: "), error))


#: Texts that a task asks about: what is asked again if it is lost.
TASK = 200
MEMO = "id string, answer string, error string"


def _known(spark: SparkSession, memo: str) -> DataFrame:
    try:
        return spark.read.schema(MEMO).parquet(memo)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MEMO)


def ask_all(texts: DataFrame, ask: Callable[[str], str], memo: str, attempts: int = 3) -> DataFrame:
    """(id, answer, error) of each text of texts (text), by its SHA-256. Texts that the memo, a folder, has an answer for aren't asked about again, equal ones once.

    Each is tried so often at most; what then has no answer has its last error, which isn't remembered beyond this call. Answers are written as tasks end, so a lost
    executor costs the questions of its running tasks.
    """
    spark = texts.sparkSession
    ship(spark)
    own = f"{memo.rstrip('/')}/call={uuid.uuid4().hex}"

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            answers, errors = [], []
            for text in batch["text"]:
                answer, error = None, None
                for _ in range(attempts):
                    try:
                        answer, error = ask(text), None
                        break
                    except Exception as e:  # noqa: BLE001  the remarks are optional
                        error = str(e)
                answers.append(answer)
                errors.append(error)
            yield batch[["id"]].assign(answer=answers, error=errors)

    known = _known(spark, memo).where("answer is not null").dropDuplicates(["id"])
    asked = texts.where("text is not null").select(F.sha2("text", 256).alias("id"), "text").dropDuplicates(["id"])
    asked = asked.join(known.select("id"), "id", "left_anti")
    n = asked.count()
    if n:
        asked.repartition(-(-n // TASK), "id").mapInPandas(run, MEMO).write.parquet(own)
    told = _known(spark, memo)
    return told.groupBy("id").agg(F.max("answer").alias("answer"), F.max("error").alias("error")).select("id", "answer", F.when(F.col("answer").isNull(), F.col("error")).alias("error"))


def with_insights(output: DataFrame, ask: Callable[[str], str] | None, memo: str | None = None, attempts: int = 3) -> DataFrame:
    """output with ``insights`` and ``insights_error``; ask gives a model's answer for an output's JSON text. Without it, both are null.

    memo: the folder that answers are kept in, from one run to the next; one of this call's own if none is given. The output is read once for the questions and
    joined with the answers by what was asked, so outputs without text have neither.
    """
    if ask is None:
        return output.withColumn("insights", parsed(F.lit(None).cast("string"))).withColumn("insights_error", F.lit(None).cast("string"))
    told = ask_all(output.select(F.col("output_json").alias("text")), ask, memo or new_folder(output.sparkSession, "insights"), attempts)
    told = told.select(F.col("id").alias("_id"), parsed(F.col("answer")).alias("insights"), F.when(F.col("error").isNotNull(), error_message(F.col("error"))).alias("insights_error"))
    return output.join(told, F.sha2("output_json", 256) == F.col("_id"), "left").drop("_id")
