"""A corpus pipeline of five of the training-data operators: from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the shared folder
and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import line_dedup, mixing, near_docs, packing, quality
from tributary.llm.common import durable, table
from tributary.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified threshold go (operator 4).

    Each row goes by its own verdict, also where ids are null or shared; equal rows share theirs. Null, empty and short texts fail the base rules;
    a text of any length is read whole. Cutoffs are inclusive, so ties go together. An empty table gives none. Other columns stay, whatever their names.
    """
    return quality.keep_rows(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or nearly, go; n_chars follows (operator 9).

    Earlier is by id, null first, then by the text's hash and place. Documents of which nothing is left go, equal rows are one document; null texts, and
    blank ones, have no lines to lose and stay. A text of any length is cut into all its lines. An empty table gives none. Other columns stay, whatever their names.
    """
    return line_dedup.without_repeats(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by 5-word shingles of Jaccard similarity 0.8 or more, stays (operator 7).

    Candidates come from SimHash balls, and from MinHash bands for what balls don't reach; each is verified. The first by id, null last, then by the
    text's hash stays; of equal rows one. Texts without words, nulls among them, are one group. A text of any length is read whole. An empty table gives none.
    Other columns stay, whatever their names.
    """
    return near_docs.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (operator 1).

    A null source is one of its own, a null or blank text has no words and stays once if its turn comes; null ids are ordered by their text. Ties of
    virtual time go by source and hash, equal rows stand for one another. A very long document is taken as a whole or not. An empty table gives none.
    Other columns stay, whatever their names.
    """
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 4096 tokens (operator 6).

    Null and empty texts are their end id alone, null ids stay null, repeated rows are packed each for itself; a long text is cut into full sequences and a rest. Among
    equal lengths the earlier row, among equal costs the earlier sequence comes first. An empty table gives no pieces. Other columns are not read.
    """
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", repeated_lines), ("SimHash near-dedup", near_duplicates), ("source mix", source_mix), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs


#: Tokens and shingles' XXH64 are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None
