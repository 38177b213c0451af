"""Evidence from provided profiles of the two networks, by a left join on the discovered address instead of a remote call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.text import or_null
from tributary.operators.evidence import evidence

GITHUB_FIELDS = ["username", "followers", "organization", "websites", "linkedin", "pinned_repos", "achievements", "readme"]


def _get(v: Column, *keys: str) -> Column:
    return F.coalesce(*[or_null(F.try_variant_get(v, f"$.{k}", "string")) for k in keys])


def _items(v: Column, key: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))


def parse_experience(v: Column) -> Column:
    """array of struct(company, title, start, end, summary) from a variant's experience; entries with neither company nor title go."""
    item = lambda x: F.struct(_get(x, "companyName", "company").alias("company"), _get(x, "title").alias("title"), _get(x, "start", "startDate").alias("start"), _get(x, "end", "endDate").alias("end"), _get(x, "description", "summary").alias("summary"))
    return F.filter(F.transform(_items(v, "experience"), item), lambda x: x["company"].isNotNull() | x["title"].isNotNull())


def parse_education(v: Column) -> Column:
    """array of struct(school, degree, field, start, end, description) from a variant's education; entries that describe nothing go."""

    def item(x: Column) -> Column:
        school, degree, field = _get(x, "schoolName", "school", "university", "college"), _get(x, "degreeName", "degree", "qualification"), _get(x, "fieldOfStudy", "field")
        start, end = _get(x, "start", "startDate"), _get(x, "end", "endDate")
        empty = F.lit("")
        dates = F.when(start.isNotNull() | end.isNotNull(), F.concat(F.lit(" ("), F.coalesce(start, empty), F.lit(" - "), F.coalesce(end, empty), F.lit(")")))
        told = F.concat(F.coalesce(degree, empty), F.coalesce(F.concat(F.lit(" in "), field), empty), F.coalesce(F.concat(F.lit(" at "), school), empty), F.coalesce(dates, empty))
        return F.struct(school.alias("school"), degree.alias("degree"), field.alias("field"), start.alias("start"), end.alias("end"), F.trim(told).alias("description"))

    return F.filter(F.transform(_items(v, "education"), item), lambda x: x["description"] != "")


def enrich(links: DataFrame, profiles: DataFrame, source_seq: int = 1000) -> DataFrame:
    """Evidence for the entities of links (entity_id, kind, url) from profiles (url, payload: JSON text). Entities without a profile give none. A payload is read once, however many links lead to it."""
    v = F.col("v")
    found: dict[str, list[Column]] = {"linkedin": [], "github": []}

    def fact(kind: str, field: str, value: Column, method: str, payload: Column | None = None, entries: Column | None = None) -> None:
        there = (payload if payload is not None else entries if entries is not None else value).isNotNull()
        none, at = F.lit(None), sum(map(len, found.values()))
        found[kind].append(F.when(there, F.struct(F.lit(at).alias("at"), F.lit(field).alias("field"), value.cast("string").alias("value"), (payload if payload is not None else none).cast("string").alias("payload"), (entries if entries is not None else none).cast("map<string,string>").alias("entries"), F.lit(method).alias("method"))))

    no = F.lit(None).cast("string")
    exp, edu = parse_experience(v), parse_education(v)
    listed = lambda a: F.when(F.size(a) > 0, F.to_json(a, {"ignoreNullFields": "false"}))
    attribute = lambda key, name: F.when(_get(v, key).isNotNull(), F.create_map(F.lit(name), _get(v, key)))
    fact("linkedin", "full_name", _get(v, "fullName"), "apify:linkedin_fullname")
    fact("linkedin", "headline", _get(v, "headline"), "apify:linkedin_headline")
    fact("linkedin", "extra_attributes", no, "apify:linkedin_about", entries=attribute("about", "linkedin_about"))
    fact("linkedin", "location", _get(v, "location"), "apify:linkedin_location")
    fact("linkedin", "experience", no, "apify:linkedin_experience", payload=listed(exp))
    fact("linkedin", "current_company", F.get(exp, 0)["company"], "apify:linkedin_experience_company")
    fact("linkedin", "current_title", F.get(exp, 0)["title"], "apify:linkedin_experience_title")
    fact("linkedin", "education", no, "apify:linkedin_education", payload=listed(edu))
    for key in ("certifications", "projects", "languages"):
        fact("linkedin", "extra_attributes", no, f"apify:linkedin_{key}", entries=attribute(key, f"linkedin_{key}"))
    name = _get(v, "name")
    fact("github", "full_name", F.when(~F.contains(F.lower(name), F.lit("http")) & ~F.contains(F.lower(name), F.lit("github.com")), name), "apify:github_name")
    fact("github", "headline", _get(v, "bio"), "apify:github_bio")
    fact("github", "location", _get(v, "location"), "apify:github_location")
    for key in GITHUB_FIELDS:
        fact("github", "extra_attributes", no, f"apify:github_{key}", entries=attribute(key, f"github_{key}"))
    skills = F.transform(_items(v, "skills"), lambda s: F.trim(F.coalesce(F.try_variant_get(s, "$.name", "string"), F.try_variant_get(s, "$", "string"))))
    skills = F.transform(F.filter(skills, lambda s: (s != "") & (F.length(s) <= 45)), lambda s, k: F.struct((k + 1000).alias("at"), F.lit("skills").alias("field"), s.alias("value"), no.alias("payload"), F.lit(None).cast("map<string,string>").alias("entries"), F.lit("apify:linkedin_skills").alias("method")))
    said = {kind: F.filter(F.array(*xs), lambda x: x.isNotNull()) for kind, xs in found.items()}
    told = profiles.select("url", F.try_parse_json("payload").alias("v")).where("v is not null").select("url", F.concat(said["linkedin"], skills).alias("_linkedin"), said["github"].alias("_github"))
    of_kind = F.when(F.col("kind") == "linkedin", F.col("_linkedin")).when(F.col("kind") == "github", F.col("_github"))
    out = links.join(told, "url").select("entity_id", "kind", F.explode(of_kind).alias("x"))
    return evidence(out, F.col("entity_id"), F.col("x.field"), F.col("x.value"), F.concat("kind", F.lit("_apify")), F.lit("semistructured"), F.col("x.method"), F.lit(source_seq), F.col("x.at"), value_map=F.col("x.entries"), value_json=F.col("x.payload"))
