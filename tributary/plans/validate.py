"""A subset of JSON schema, checked against JSON text by a column expression: the schema is walked while the plan is made."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = {"string": "str", "number": "float", "integer": "int", "boolean": "bool", "array": "list", "object": "dict", "null": "NoneType"}


def kind_of(v: Column) -> Column:
    """The JSON kind of a variant."""
    s = F.schema_of_variant(v)
    return F.when(v.isNull() | (s == "VOID"), "null").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer").when(F.startswith(s, F.lit("ARRAY")), "array").when(F.startswith(s, F.lit("OBJECT")), "object").otherwise("number")


def _name(kind: Column) -> Column:
    return F.get(F.array(*map(F.lit, KINDS.values())), F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int") - 1)


def errors(v: Column, schema: dict, path: str | Column = "$") -> Column:
    """array of messages for a variant."""
    at = F.lit(path) if isinstance(path, str) else path
    found: list[Column] = []
    want, kind = schema.get("type"), kind_of(v)
    none = F.array().cast("array<string>")
    if want == "null":
        found.append(F.when(kind != "null", F.array(F.concat(at, F.lit(": expected null, got "), _name(kind)))))
    elif want in KINDS:
        fits = kind.isin("integer", "number") if want == "number" else kind == want
        got = F.when(kind == "boolean", "boolean").otherwise(_name(kind)) if want in ("number", "integer") else _name(kind)
        found.append(F.when((kind != "null") & ~fits, F.array(F.concat(at, F.lit(f": expected {want}, got "), got))))
    if want == "object":
        for key in schema.get("required", []):
            part = F.try_variant_get(v, f"$['{key}']", "variant")
            found.append(F.when((kind == "object") & (kind_of(part) == "null"), F.array(F.concat(at, F.lit(f": missing required field '{key}'")))))
        for key, sub in schema.get("properties", {}).items():
            if sub:
                part = F.try_variant_get(v, f"$['{key}']", "variant")
                found.append(F.when((kind == "object") & part.isNotNull(), errors(part, sub, F.concat(at, F.lit(f".{key}")))))
    if want == "array" and schema.get("items"):
        items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
        found.append(F.when(kind == "array", F.flatten(F.transform(items, lambda x, i: errors(x, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))))))
    return F.concat(*[F.coalesce(x, none) for x in found]) if found else none


def json_errors(text: Column, schema: dict) -> Column:
    return errors(F.try_parse_json(text), schema)


def has_keys(text: Column, keys: list[str]) -> Column:
    """Whether a JSON object has all of the keys."""
    return F.size(F.array_except(F.array(*map(F.lit, keys)), F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")))) == 0
