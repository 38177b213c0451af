"""Sections, names and experience in the lines of extracted document text, by windows over (doc, pos)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.functions import dicts as D
from tributary.functions import text as X


def lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, pos, line) of texts, pos from 0."""
    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))


def _so_far(upto: int = 0) -> W:
    return W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, upto)


def sections(rows: DataFrame) -> DataFrame:
    """The lines of each section that is the first of its kind in its document: doc, section, pos, line (trimmed, not blank)."""
    rows = rows.withColumn("head", X.header(F.col("line"))).withColumn("section", F.last("head", ignorenulls=True).over(_so_far())).withColumn("began", F.last(F.when(F.col("head").isNotNull(), F.col("pos")), ignorenulls=True).over(_so_far()))
    rows = rows.withColumn("first", F.min("began").over(W.partitionBy("doc", "section")))
    body = rows.where(F.col("section").isNotNull() & F.col("head").isNull() & (F.col("began") == F.col("first"))).select("doc", "section", "pos", X.strip(F.col("line")).alias("line"))
    return body.where(F.col("line") != "")


def names(rows: DataFrame) -> DataFrame:
    """(doc, name, score): the line, blank ones not counted, that looks most like a name, above the first header if there is one, else anywhere."""
    rows = rows.where(X.strip(F.col("line")) != "").withColumn("pos", F.row_number().over(W.partitionBy("doc").orderBy("pos")) - 1)
    cut = F.min(F.when(X.header(F.col("line")).isNotNull(), F.col("pos"))).over(W.partitionBy("doc"))
    likely = rows.withColumn("cut", cut).where(X.is_name_line(F.col("line")))
    above = F.col("cut").isNull() | (F.col("pos") < F.col("cut"))
    likely = likely.withColumn("above", above).withColumn("any_above", F.max("above").over(W.partitionBy("doc"))).where(F.col("above") | ~F.col("any_above"))
    line = X.strip(F.col("line"))
    score = X.name_score(line, F.col("pos"), F.when(F.col("above"), 6).otherwise(3))
    return likely.select("doc", F.struct((-score).alias("s"), "pos", (-F.length(line)).alias("l"), line.alias("name")).alias("c")).groupBy("doc").agg(F.min("c").alias("c")).select("doc", F.col("c.name").alias("name"), (-F.col("c.s")).alias("score"))


def experience(body: DataFrame, split_dates: bool = False) -> DataFrame:
    """(doc, company, title, start, end, summary) from the lines (doc, pos, line) of experience sections: one block a document.

    The first plain line is the company, the second the title, unless it names a place only. From the first bullet or line of dates on, all
    other lines are summary. split_dates: any dash separates the dates, and what stands before it is the start.
    """
    raw, text = F.col("line"), X.without_bullets(F.col("line"))
    bullet = F.rlike(raw, F.lit("^[\\s••·\\-*]+"))
    rows = body.withColumns({"text": text, "date": X.is_date_line(text), "bullet": bullet}).where(F.col("text") != "")
    begun = F.coalesce(F.max(F.col("date") | F.col("bullet")).over(_so_far(-1)), F.lit(False))
    rows = rows.withColumn("begun", begun)
    place = X.any_hint(F.lower("text"), D.LOCATION_HINTS) & ~X.is_company(F.col("text")) & ~X.is_job_title(F.col("text"))
    role = ~F.col("date") & ~F.col("bullet") & ~F.col("begun") & ~place
    rows = rows.withColumn("role", role).withColumn("nth", F.sum(F.col("role").cast("int")).over(_so_far()))
    match = F.regexp_extract("text", D.DATE_LINE, 0)
    if split_dates:
        start = X.strip(F.regexp_extract(match, r"^(.*?)\s*[-–—]", 1))
        end = X.strip(F.regexp_extract(match, r"^.*?[-–—]\s*(.*)$", 1))
    else:
        start = X.strip(F.call_function("substring_index", F.col("text"), match, F.lit(1)))
        end = X.strip(F.when(F.contains(match, F.lit("-")), F.regexp_extract(match, r"^[^-]*-(.*)$", 1)).otherwise(match))
    rows = rows.withColumns({"start": F.when(F.col("date"), X.or_null(start)), "end": F.when(F.col("date"), end)})
    told = ~F.col("date") & (F.col("bullet") | F.col("begun"))
    summary = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(told, F.struct("pos", "text")))), lambda x: x["text"]), " ")
    return rows.groupBy("doc").agg(F.max(F.when(F.col("role") & (F.col("nth") == 1), F.col("text"))).alias("company"), F.max(F.when(F.col("role") & (F.col("nth") == 2), F.col("text"))).alias("title"), F.max_by("start", F.when(F.col("start").isNotNull(), F.col("pos"))).alias("start"), F.max_by("end", F.when(F.col("end").isNotNull(), F.col("pos"))).alias("end"), X.or_null(summary).alias("summary"))


def skills(body: DataFrame) -> DataFrame:
    return body.select("doc", "pos", F.posexplode(X.skill_parts(F.col("line"))).alias("at", "skill"))


def education(body: DataFrame) -> DataFrame:
    return body.where(X.is_education(F.col("line")))


def resume_evidence(docs: DataFrame, entity_id: Column, source_id: Column, source_seq: Column, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """All that is read from extracted text, as evidence: name, first e-mail address and phone number, skills, experience and the role in it, education."""
    from tributary.operators.evidence import evidence, union

    keys = docs.select(F.col(doc).alias("doc"), entity_id.alias("entity"), source_id.alias("source"), source_seq.cast("int").alias("seq"))
    rows = lines(docs, doc, text)
    body = sections(rows)
    kind = F.lit("unstructured")

    def made(found: DataFrame, field: str, raw: Column, at: Column, method: str, payload: Column | None = None) -> DataFrame:
        there = found.where((raw if payload is None else payload).isNotNull()).join(keys, "doc")
        return evidence(there, F.col("entity"), F.lit(field), raw, F.col("source"), kind, F.lit(method), F.col("seq"), at, value_json=payload)

    one = docs.select(F.col(doc).alias("doc"), X.first_email(F.col(text)).alias("email"), X.first_phone(F.col(text)).alias("phone"))
    block = experience(body.where("section = 'experience'"))
    whole = F.to_json(F.struct("company", "title", "start", "end", "summary"), {"ignoreNullFields": "false"})
    has = F.coalesce("company", "title", "summary").isNotNull()
    block = block.where(has)
    learnt = education(body.where("section = 'education'"))
    return union(
        made(names(rows), "full_name", F.col("name"), F.lit(0), "heuristic:smart_first_line"),
        made(one, "emails", F.col("email"), F.lit(1), "regex:email"),
        made(one, "phones", F.col("phone"), F.lit(2), "regex:phone"),
        made(skills(body.where("section = 'skills'")), "skills", F.col("skill"), 10 + F.col("pos") * 1000 + F.col("at"), "heuristic:skills_multi_split"),
        made(block, "experience", F.lit(None).cast("string"), F.lit(3), "heuristic:experience_block", whole),
        made(block, "current_title", F.col("title"), F.lit(4), "heuristic:experience_block"),
        made(block, "current_company", F.col("company"), F.lit(5), "heuristic:experience_block"),
        made(learnt, "education", F.lit(None).cast("string"), F.col("pos") + 6, "heuristic:education_keyword", F.to_json(F.struct(F.col("line").alias("description")))),
    )
