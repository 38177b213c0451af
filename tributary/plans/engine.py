"""Runs: evidence in, profiles, outputs and diagnostics out, for any number of entities at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import dicts as D
from tributary.functions import links as L
from tributary.functions.text import normalizers
from tributary.operators import evidence as E
from tributary.operators import profile
from tributary.operators.enrich import enrich
from tributary.operators.sections import resume_evidence
from tributary.plans.projection import outputs, project, project_default
from tributary.session import kept
from tributary.sources import readers as R
from tributary.sources.csv_splits import csv_facts_of


@dataclass
class RunResult:
    """output: typed columns, output_json, errors, ok by entity. canonical: the profiles. warnings: (entity_id, kind, message).
    skipped: what was rejected. sources: how each source went. links: (entity_id, kind, url). told: output_json, errors and the profile as JSON, by entity."""

    output: DataFrame
    canonical: DataFrame
    warnings: DataFrame
    skipped: DataFrame
    sources: DataFrame
    links: DataFrame
    told: DataFrame | None = None


def resolve(ev: DataFrame, config: dict | None = None, sources: DataFrame | None = None, links: DataFrame | None = None, distinct_sources: bool = False, country: str = D.COUNTRY_CODE, policies: dict[str, str] = D.POLICIES) -> RunResult:
    """From evidence on. country: the calling code of national phone numbers. policies: how fields are merged.

    Normalized evidence and profiles have several readers; they are kept in the folder of spark.checkpoint.dir, where one is set.
    """
    spark = ev.sparkSession
    if sources is None:
        sources = ev.select("entity_id", "source_seq", "source_id", "source_type", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.array().cast("array<string>").alias("warnings")).distinct()
    good = kept(E.normalized(ev, normalizers(country)))
    profiles = kept(profile.canonical(good, sources.select("entity_id"), distinct_sources, policies))
    output = project(profiles, config) if config else project_default(profiles)
    skipped = E.rejected(good)
    dropped = skipped.select("entity_id", F.lit("dropped").alias("kind"), F.concat(F.lit("dropped unparseable "), "field", F.lit(" value '"), "raw_value", F.lit("' from "), "source_id").alias("message"))
    failed = sources.where("not ok").select("entity_id", F.lit("skipped").alias("kind"), F.concat(F.lit("source '"), "source_id", F.lit("' skipped: "), "error").alias("message"))
    said = sources.select("entity_id", F.lit("source").alias("kind"), F.explode("warnings").alias("message"))
    shown = F.try_parse_json("output_json")
    has = [F.coalesce(~F.try_variant_get(shown, f"$.{k}", "string").isin("", "[]"), F.lit(False)) for k in ("emails", "phones", "skills")]
    bare = output.where(F.col("output_json").isNotNull() & ~(has[0] | has[1] | has[2])).select("entity_id", F.lit("incomplete").alias("kind"), F.lit("Profile incomplete: missing email, phone, skills").alias("message"))
    warnings = failed.union(dropped).union(said).union(profile.conflicts(profiles)).union(bare)
    none = spark.createDataFrame([], "entity_id string, kind string, url string")
    profile_json = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("profile")
    told = outputs(profiles, {"out": config}, profile_json).select("entity_id", "out.output_json", "out.errors", "profile")
    return RunResult(output, profiles, warnings, skipped, sources, none if links is None else links, told)


def discover(texts: DataFrame) -> DataFrame:
    """(entity_id, kind, url) of texts (entity_id, source_seq, text): of each kind the surest form's first, by the order of sources. Each text is searched for itself, so none of them meet in one task."""
    each = texts.select("entity_id", "source_seq", F.explode(L.found_links(F.col("text"))).alias("x")).select("entity_id", "source_seq", "x.*")
    return each.groupBy("entity_id", "kind").agg(F.min_by("url", F.struct("form", "source_seq", "url")).alias("url"))


def link_evidence(links: DataFrame, source_seq: int = 999) -> DataFrame:
    per = links.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "url")))).alias("m"))
    return E.evidence(per, F.col("entity_id"), F.lit("links"), F.lit(None), F.lit("url_discovery"), F.lit("unstructured"), F.lit("regex:url_discovery"), F.lit(source_seq), F.lit(0), value_map=F.col("m"))


def run(spark: SparkSession, paths: list[str], config: dict | None = None, extract: Callable[[bytes], str] | None = None, profiles: DataFrame | None = None, entity: str = "entity", text_as_document: bool = False, country: str = D.COUNTRY_CODE) -> RunResult:
    """All files are about one entity, unless there is one table alone with several rows: then each row is an entity.

    extract: text of a PDF's bytes, for those that pdf_text() can't read. country: the calling code of national phone numbers. profiles: (url, payload) to enrich from. text_as_document: .txt files are read as documents, not as tables.
    """
    one = F.lit(entity)
    if len(paths) == 1 and paths[0].lower().endswith(".csv"):
        rows = csv_facts_of(spark, paths)
        n = rows.where("field_name is null").select("source_seq", F.col("row").alias("n"))
        ev = R.to_evidence(rows.join(n, "source_seq"), F.when(F.col("n") > 1, F.col("source_id")).otherwise(one))
        cases = ev.select(F.col("entity_id").alias("case"), F.regexp_replace("source_id", r"#row\d+$", "").alias("file")).distinct()
        states = R.to_sources(rows, one).join(cases, F.col("source_id") == F.col("file"), "left").withColumn("entity_id", F.coalesce("case", "entity_id")).drop("case", "file")
        return resolve(ev, config, states, country=country)
    found = R.files(spark, paths)
    if text_as_document:
        found = found.withColumn("ext", F.when(F.col("ext") == ".txt", ".text").otherwise(F.col("ext")))
    rows = R.facts(found)
    rows = rows.where(F.col("field_name").isNull() | (F.col("row") <= 1))
    ev = R.to_evidence(rows, one)
    documents = R.document_texts(found, extract)
    states = R.to_sources(rows, one).unionByName(documents.select(one.alias("entity_id"), "source_seq", "source_id", F.lit("unstructured").alias("source_type"), F.col("error").isNull().alias("ok"), "error", F.array().cast("array<string>").alias("warnings")))
    ev = E.union(ev, resume_evidence(documents.where("text is not null"), F.lit(entity), F.col("source_id"), F.col("source_seq"), "source_seq", "text"))
    links = discover(R.raw_texts(found, documents).withColumn("entity_id", F.lit(entity)))
    ev = E.union(ev, link_evidence(links))
    if profiles is not None:
        ev = E.union(ev, enrich(links, profiles))
    out = resolve(ev, config, states, links, country=country)
    known = links if profiles is None else links.join(profiles.select("url"), "url", "left_anti")
    names = F.when(F.col("kind") == "linkedin", "LinkedIn").when(F.col("kind") == "github", "GitHub")
    missed = known.where(names.isNotNull()).select("entity_id", F.lit("enrichment").alias("kind"), F.concat(names, F.lit(" enrichment unavailable")).alias("message"))
    out.warnings = out.warnings.union(missed)
    return out
