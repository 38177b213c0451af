"""Scores. They are rounded from binary doubles, which Spark's round() isn't, so they come from tables made with Python's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.functions import dicts as D

BONUS, CAP, PARTIAL, UNKNOWN = 0.15, 0.98, 0.85, 0.9
KINDS = {"agreement": None, "partial": PARTIAL, "unknown": UNKNOWN}
MOST = 5


def score(base: float, n: int, kind: str = "agreement") -> float:
    """Of n rows of evidence, the best of weight base."""
    agreed = round(min(CAP, base + BONUS * (n - 1)), 2)
    return agreed if KINDS[kind] is None else round(agreed * KINDS[kind], 2)


def weight(source_type: Column) -> Column:
    out = None
    for name, w in D.BASE_WEIGHTS.items():
        out = F.when(source_type == name, F.lit(w)) if out is None else out.when(source_type == name, F.lit(w))
    return out.otherwise(F.lit(D.OTHER_WEIGHT))


def confidence(base: Column, n: Column, kind: str = "agreement") -> Column:
    """score() by table; 0 if there is no evidence."""
    at = F.least(n, F.lit(MOST)).cast("int") - 1
    out = None
    for w in sorted(set(D.BASE_WEIGHTS.values()) | {D.OTHER_WEIGHT}):
        value = F.get(F.array(*[F.lit(score(w, k, kind)) for k in range(1, MOST + 1)]), at)
        out = F.when(base == w, value) if out is None else out.when(base == w, value)
    return F.coalesce(out, F.lit(0.0))


def tier(name: Column, title: Column, contact: Column) -> Column:
    """Of a whole profile: contact says whether there is an e-mail address or a phone number."""
    has = lambda v: v.isNotNull() & (v != "")
    return F.when(has(name) & has(title) & contact, 0.9).when(has(name) & has(title), 0.6).when(has(name), 0.3).otherwise(0.1)


def source_rank(source_id: Column, at: Column, compat: bool = False) -> Column:
    """How much a source's word counts in ties, least first; at: its place in the order of sources, null if it has none.
    compat: a row's number behind a file's name hides the file's kind."""
    s = F.lower(source_id)
    s = s if compat else F.regexp_replace(s, r"#row\d+$", "")
    return (
        F.when(F.endswith(s, F.lit(".pdf")) | F.contains(s, F.lit("resume")), 0)
        .when(F.contains(s, F.lit("linkedin_apify")), 1)
        .when(F.contains(s, F.lit("github_apify")), 2)
        .when(F.endswith(s, F.lit(".json")), 3)
        .when(F.endswith(s, F.lit(".csv")), 4)
        .when(F.endswith(s, F.lit(".txt")), 5)
        .otherwise(F.coalesce(at, F.lit(1_000_000)) + 10)
    )


def entity_hash(email: Column, phone: Column, name: Column) -> Column:
    """The profile's id, from the first e-mail address, else the first phone number, else the name."""
    has = lambda v: F.when(v != "", v)
    basis = F.coalesce(F.concat(F.lit("email:"), has(email)), F.concat(F.lit("phone:"), has(phone)), F.concat(F.lit("name:"), F.lower(has(name))), F.lit("unknown"))
    return F.concat(F.lit("cand_"), F.substring(F.sha1(basis), 1, 10))
