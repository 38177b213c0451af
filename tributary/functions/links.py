"""Discovery of profile and portfolio addresses in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.functions import dicts as D
from tributary.functions.text import or_null

NAME = r"([\w\-%.]+)"


def _trim_end(v: Column) -> Column:
    return F.regexp_replace(v, r"[/.,!?;:]+$", "")


def reserved(segment: Column) -> Column:
    """Whether the first segment of a path is the network's own and no name."""
    return F.lower(segment).isin(D.RESERVED_SEGMENTS)


def linkedin_forms(text: Column) -> list[Column]:
    """What each form gives, the surest first: an address with /in/, a labelled name, an address without /in/ whose first segment isn't reserved."""
    full = or_null(F.regexp_extract(text, rf"(?i)linkedin\.com\s*/\s*in\s*/\s*{NAME}", 1))
    label = or_null(F.regexp_extract(text, rf"(?i)linkedin\s*[:/]\s*(?:in/)?(?!https?\b){NAME}", 1))
    short = or_null(_trim_end(F.regexp_extract(text, r"(?i)linkedin\.com\s*/\s*([A-Za-z0-9_.%-]+)", 1)))
    return [F.concat(F.lit("https://linkedin.com/in/"), x) for x in (_trim_end(full), _trim_end(label), F.when(~reserved(short), short))]


def github_forms(text: Column) -> list[Column]:
    full = or_null(F.regexp_extract(text, rf"(?i)github\.com\s*/\s*{NAME}", 1))
    label = or_null(F.regexp_extract(text, rf"(?i)github\s*[:/]\s*@?(?!https?\b){NAME}", 1))
    return [F.concat(F.lit("https://github.com/"), _trim_end(x)) for x in (full, label)]


def linkedin(text: Column) -> Column:
    return F.coalesce(*linkedin_forms(text))


def github(text: Column) -> Column:
    return F.coalesce(*github_forms(text))


def portfolio(text: Column) -> Column:
    """The first other web address whose host is neither social nor a mail or script host."""
    url = r"((?:https?://|www\.)[\w\-]+\.[\w\-]+(?:\.[\w\-]+)*(?:/[\w\-./]*)?)"
    low = F.lower
    found = F.regexp_extract_all(text, F.lit(f"(?i){url}"), 1)
    social = rf"^(?:https?://|www\.)(?:www\.)?(?:{'|'.join(D.SOCIAL_HOSTS)})\.com"
    skip = "|".join(h.replace(".", r"\.") for h in ["linkedin.com", "github.com", *D.SKIPPED_HOSTS])
    good = F.filter(found, lambda u: ~F.rlike(low(u), F.lit(social)) & ~F.rlike(low(u), F.lit(skip)))
    u = F.regexp_replace(F.get(good, F.lit(0)), "/+$", "")
    return F.when(F.startswith(u, F.lit("http")), u).otherwise(F.concat(F.lit("https://"), u))


def all_links(text: Column) -> Column:
    """map of what is found; a kind that isn't is no key."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("linkedin", linkedin(text)), ("github", github(text)), ("portfolio", portfolio(text)))])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def found_links(text: Column) -> Column:
    """array of struct(kind, form, url): of each form that the text has, its first; form: its place, the surest first."""
    forms = [("linkedin", linkedin_forms(text)), ("github", github_forms(text)), ("portfolio", [portfolio(text)])]
    cells = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("form"), x.alias("url")) for kind, each in forms for i, x in enumerate(each)])
    return F.filter(cells, lambda x: x["url"].isNotNull())
