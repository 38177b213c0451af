"""The projection language compiled to columns over canonical profiles.

A path is looked up while the plan is made; only whether an index is out of bounds depends on the row. Rows of one
DataFrame have one schema, so the result is both typed columns, null where omitted, and ``output_json``, where omitted keys are absent.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions import dicts as D
from tributary.functions.text import format_hint, years
from tributary.operators.merge import provenance
from tributary.plans.config import TYPES, checked

#: What a path can reach: the fields of profiles that have a confidence, sources and methods, and three that don't.
FIELDS = [*D.SINGLE_FIELDS, *D.MULTI_FIELDS, "skills"]
PLAIN = ["candidate_id", "overall_confidence", "extra_attributes"]
VIEWS = ("value", "confidence", "sources", "methods")


@dataclass
class Found:
    """missing: whether a row lacks it. many: a list by way of []."""

    column: Column | None
    missing: Column
    many: bool = False
    kind: T.DataType | None = None


class PathError(ValueError):
    pass


def _view(field: str, view: str) -> Column:
    """A field, a plain value or a list, as a view shows it."""
    if field in D.SINGLE_FIELDS:
        return F.col(f"{field}.{view}")
    if field == "skills":
        if view == "value":
            return F.transform("skills", lambda s: F.struct(s["name"].alias("name")))
        return F.transform("skills", lambda s: F.struct(s[view].alias("name")))
    return F.transform(field, lambda x: x[view])


def segments(path: str) -> list[tuple[str, str | None]]:
    out = []
    for part in path.split("."):
        m = re.fullmatch(D.PATH_SEGMENT, part)
        if not m:
            raise PathError(f"invalid path segment '{part}' in '{path}'")
        out.append((m[1], m[3] if m[2] else None))
    return out


def resolve(path: str, view: str = "value") -> Found:
    """A path such as full_name, emails[0], skills[].name, in a view."""
    parts = segments(path)
    wildcard = any(index == "" for _, index in parts)
    nothing = Found(F.array().cast("array<string>") if wildcard else None, F.lit(not wildcard), wildcard)
    (field, index), rest = parts[0], parts[1:]
    if field in PLAIN and view == "value":
        if index is not None or (rest and field != "extra_attributes"):
            return nothing
        if rest:
            if len(rest) > 1 or rest[0][1] is not None:
                return nothing
            key = rest[0][0]
            return Found(F.try_element_at(field, F.lit(key)), ~F.map_contains_key(field, F.lit(key)))
        return Found(F.col(field), F.lit(False))
    if field not in FIELDS:
        return nothing
    column, is_list = _view(field, view), field not in D.SINGLE_FIELDS
    if index is not None and not is_list and view == "value":
        return nothing
    if len(rest) > 1 or (rest and (field != "skills" or rest[0] != ("name", None))):
        return nothing
    if index == "":
        return Found(F.transform(column, lambda x: x["name"]) if rest else column, F.lit(False), True)
    if index is not None:
        i = int(index)
        at = F.get(column, i)
        return Found(at["name"] if rest else at, F.size(column) <= i)
    return Found(None, F.lit(True)) if rest else Found(column, F.lit(False))


def _json(value: Column) -> Column:
    """Any value as JSON text; null is 'null'."""
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.coalesce(F.get(F.transform(F.array(whole), lambda t: t.substr(F.lit(6), F.length(t) - 6)), 0), F.lit("null"))


def _object(pairs: list[tuple[str, Column, Column]]) -> Column:
    """Of (key, JSON text, whether it is there), an object."""
    cells = F.array(*[F.when(there, F.concat(F.lit(f'"{key}":'), text)) for key, text, there in pairs]) if pairs else F.array().cast("array<string>")
    return F.concat(F.lit("{"), F.array_join(F.filter(cells, lambda x: x.isNotNull()), ","), F.lit("}"))


def _each_formatted(values: Column, hint: str) -> Column:
    return F.transform(values, lambda v: format_hint(v, hint))


def _is_blank(found: Found, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(found.column) == 0, F.lit(True))
    if isinstance(kind, T.StringType):
        return F.coalesce(found.column == "", F.lit(True))
    return found.column.isNull()


def _kind(shape: DataFrame, column: Column) -> T.DataType:
    return shape.select(column.alias("c")).schema["c"].dataType


def _type_errors(key: str, declared: str | None, kind: T.DataType, value: Column, there: Column) -> list[Column]:
    """Messages of what the config's schema would find; a type is known before any row is."""
    name = {"string": T.StringType, "string[]": T.ArrayType, "number": (T.DoubleType, T.LongType, T.IntegerType), "boolean": T.BooleanType}.get(declared or "", T.DataType)
    if declared is None:
        return []
    got = "list" if isinstance(kind, T.ArrayType) else "dict" if isinstance(kind, (T.MapType, T.StructType)) else "str" if isinstance(kind, T.StringType) else "boolean" if isinstance(kind, T.BooleanType) else "float"
    if not isinstance(kind, name):
        return [F.when(there & value.isNotNull(), F.lit(f"$.{key}: expected {TYPES[declared]}, got {got}"))]
    if declared == "string[]" and not isinstance(kind.elementType, T.StringType):
        inner = "dict" if isinstance(kind.elementType, T.StructType) else "float"
        return [F.when(there & value.isNotNull() & (F.size(value) > 0), F.lit(f"$.{key}[0]: expected string, got {inner}"))]
    return []


def _projected(profiles: DataFrame, config: dict) -> tuple[list[Column], Column, Column]:
    """Of a config its fields' columns, the output's JSON text and the errors (of projection, then of validation), all over the profiles."""
    config = checked(config)
    policy = config.get("on_missing", "null")
    shape = profiles.sparkSession.createDataFrame([], profiles.schema)  # columns, without the plan that makes them, to ask for types
    columns, cells, wrong, invalid, traced = [], [], [], [], []
    for field in config["fields"]:
        key, path, required = field["path"], field.get("from", field["path"]), bool(field.get("required"))
        try:
            found = resolve(path)
        except PathError as e:
            wrong.append(F.lit(str(e)))
            continue
        value, missing = found.column, found.missing
        kind = _kind(shape, value) if value is not None else T.StringType()
        if value is not None and isinstance(kind, T.StringType):
            value = format_hint(value, field.get("normalize"))
        elif value is not None and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType) and field.get("normalize"):
            value = _each_formatted(value, field["normalize"])
        if value is not None and required:
            missing = missing | _is_blank(found, kind)
        value = F.lit(None).cast("string") if value is None else F.when(~missing, value)
        there = ~missing
        if policy == "error":
            wrong.append(F.when(missing, F.lit(f"field '{key}' (from '{path}') is missing")))
        columns.append(value.alias(key))
        cells.append((key, _json(value), there if policy == "omit" else F.lit(True)))
        if required and policy != "omit":
            invalid.append(F.when(value.isNull(), F.lit(f"$: missing required field '{key}'")))
        invalid += _type_errors(key, field.get("type"), kind, value, there)
        views = {v: resolve(path, v).column for v in VIEWS[1:]}
        null = F.lit(None).cast("string")
        if config.get("include_confidence"):
            conf = null if views["confidence"] is None else F.when(there, views["confidence"])
            columns.append(conf.alias(f"{key}_confidence"))
            cells.append((f"{key}_confidence", _json(conf), there))
        if config.get("include_provenance"):
            both = [null if views[v] is None else F.when(there, views[v]) for v in VIEWS[2:]]
            for name, v in zip(VIEWS[2:], both):
                columns.append(v.alias(f"{key}_{name}"))
                cells.append((f"{key}_{name}", _json(v), there))
            if views["sources"] is not None and _kind(shape, views["sources"]) == T.ArrayType(T.StringType()):
                traced.append(F.coalesce(provenance(*both, F.lit(key)), F.array().cast("array<struct<field:string,source:string,method:string>>")))
    if config.get("include_provenance"):
        trace = F.array_distinct(F.concat(*traced)) if traced else F.array().cast("array<struct<field:string,source:string,method:string>>")
        columns.append(trace.alias("provenance"))
        cells.append(("provenance", _json(trace), F.lit(True)))
    listed = lambda xs: F.filter(F.array(*xs) if xs else F.array().cast("array<string>"), lambda x: x.isNotNull())
    prefixed = lambda xs, p: F.transform(listed(xs), lambda x: F.concat(F.lit(p), x))
    failed = F.size(listed(wrong)) > 0
    errors = F.when(failed, prefixed(wrong, "projection: ")).otherwise(prefixed(invalid, "validation: "))
    return columns, F.when(~failed, _object(cells)), errors


def project(profiles: DataFrame, config: dict) -> DataFrame:
    """entity_id, a column for each field of the config, output_json, errors (of projection, then of validation), ok."""
    columns, output, errors = _projected(profiles, config)
    return profiles.select("entity_id", *columns, output.alias("output_json"), errors.alias("errors"), (F.size(errors) == 0).alias("ok"))


#: Of the default output, what must not be null.
REQUIRED = ("candidate_id", "full_name", "overall_confidence")


def default_provenance() -> Column:
    """Where the default output's values come from: distinct (field, source, method), in the output's order."""
    single = [provenance(F.col(f"{f}.sources"), F.col(f"{f}.methods"), F.lit(f)) for f in ("full_name", "current_company", "current_title", "location", "headline", "years_experience")]

    def of_items(field: str) -> Column:
        return F.flatten(F.transform(field, lambda x: provenance(x["sources"], x["methods"], F.lit(field))))

    lists = [of_items(f) for f in ("emails", "phones", "skills")]
    return F.array_distinct(F.concat(*single, *lists))


def _default(profiles: DataFrame) -> tuple[list[Column], Column, Column]:
    """The same of the default output, with its 15 columns."""
    company, title = F.col("current_company.value"), F.col("current_title.value")
    role = F.array(F.struct(company.alias("company"), title.alias("title"), *[F.lit(None).cast("string").alias(n) for n in ("start", "end", "summary")]))
    known = (F.coalesce(company, F.lit("")) != "") | (F.coalesce(title, F.lit("")) != "")
    jobs = F.when(F.size("experience") > 0, F.col("experience")).when(known, role).otherwise(F.slice(role, 1, 0))
    out = {
        "candidate_id": F.col("candidate_id"), "full_name": F.col("full_name.value"), "emails": F.transform("emails", lambda x: x["value"]), "phones": F.transform("phones", lambda x: x["value"]),
        "current_company": company, "current_title": title, "location": F.col("location.value"), "headline": F.col("headline.value"), "years_experience": years(F.col("years_experience.value")),
        "links": F.col("links"), "education": F.col("education"), "skills": F.transform("skills", lambda s: F.struct(s["name"].alias("name"), s["confidence"].alias("confidence"), s["sources"].alias("sources"))),
        "experience": jobs, "overall_confidence": F.col("overall_confidence"), "provenance": default_provenance(),
    }
    missing = F.filter(F.array(*[F.when(out[k].isNull(), F.lit(f"validation: $: missing required field '{k}'")) for k in REQUIRED]), lambda x: x.isNotNull())
    named = [v.alias(k) for k, v in out.items()]
    return named, F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), missing


def project_default(profiles: DataFrame) -> DataFrame:
    """entity_id, the 15 columns of the default output, output_json, errors, ok."""
    named, _, missing = _default(profiles)
    shown = profiles.select("entity_id", *named, missing.alias("errors"))
    out = shown.columns[1:-1]
    return shown.withColumn("output_json", F.to_json(F.struct(*out), {"ignoreNullFields": "false"})).withColumn("ok", F.size("errors") == 0).select("entity_id", *out, "output_json", "errors", "ok")


def outputs(profiles: DataFrame, configs: dict[str, dict | None], *more: Column) -> DataFrame:
    """entity_id, more, and by each name of configs a struct of output_json and errors, of the default output where the config is None. One pass over the profiles: no join brings together what is of one row."""
    told = []
    for name, config in configs.items():
        _, output, errors = _projected(profiles, config) if config else _default(profiles)
        told.append(F.struct(output.alias("output_json"), errors.alias("errors")).alias(name))
    return profiles.select("entity_id", *more, *told)
