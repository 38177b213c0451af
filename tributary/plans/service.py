"""A run as one JSON-ready answer: what a command or a web handler around the engine gives back."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.plans import config as C
from tributary.plans.engine import run

ALLOWED = (".csv", ".json", ".pdf", ".txt")
#: Entities that an answer may hold; larger runs are written by writers.envelope().
MOST = 10_000


def health() -> dict:
    return {"status": "ok"}


def refused(names: list[str]) -> str | None:
    """Why files of these names aren't taken, or None."""
    if not names:
        return "At least one file is required"
    bad = next((n for n in names if Path(n).suffix.lower() not in ALLOWED), None)
    return f"Unsupported file type: {bad}. Allowed: {', '.join(ALLOWED)}" if bad else None


def answer(spark: SparkSession, paths: list[str], config_name: str | None = None, config_json: str | None = None, folder: str | None = None, extract: Callable[[bytes], str] | None = None, profiles: DataFrame | None = None) -> dict:
    """ok, warnings, validation_errors, canonical, output, discovered_urls, enrichment_status, candidate_outputs of one run. One entity, or one table's rows: MOST at most, as all of it goes to the driver."""
    config = C.load(config_name, config_json, folder)
    result = run(spark, paths, config, extract, profiles)
    if result.output.limit(MOST + 1).count() > MOST:
        raise ValueError(f"more than {MOST} entities: write the run's envelope instead")
    warnings: dict[str, list[str]] = {}
    for r in result.warnings.collect():
        warnings.setdefault(r["entity_id"], []).append(r["message"])
    profile = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    canonical = {r["entity_id"]: json.loads(r["p"]) for r in result.canonical.select("entity_id", profile.alias("p")).collect()}
    rows = [r.asDict() for r in result.output.select("entity_id", "output_json", "errors").orderBy(F.regexp_extract("entity_id", r"#row(\d+)$", 1).try_cast("long"), "entity_id").collect()]
    outputs = [{"source_id": r["entity_id"], "canonical": canonical.get(r["entity_id"]), "output": json.loads(r["output_json"]) if r["output_json"] else None, "warnings": sorted(warnings.get(r["entity_id"], [])), "validation_errors": r["errors"]} for r in rows]
    first = outputs[0] if outputs else {"canonical": None, "output": None, "warnings": [], "validation_errors": []}
    found = {r["kind"]: r["url"] for r in result.links.collect()}
    urls = {k: found.get(k) for k in ("linkedin", "github", "portfolio")}
    missed = {w.split(" ")[0].lower() for w in first["warnings"] if w.endswith("enrichment unavailable")}
    status = {k: bool(urls[k]) and k not in missed for k in ("linkedin", "github")}
    top = {k: first[k] for k in ("warnings", "validation_errors", "canonical", "output")}
    return {"ok": not first["validation_errors"], **top, "discovered_urls": urls, "enrichment_status": status, "candidate_outputs": outputs if len(outputs) > 1 else []}
