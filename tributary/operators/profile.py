"""One canonical profile an entity: merged fields, score and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions import dicts as D
from tributary.functions.confidence import entity_hash, tier
from tributary.operators import merge as M
from tributary.operators.evidence import accepted
from tributary.operators.policies import Policy, merged_fields

EXPERIENCE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("company", "title", "start", "end", "summary")]))
EDUCATION = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("school", "degree", "field", "start", "end", "description")]))
FIELD = "struct<value:string,confidence:double,sources:array<string>,methods:array<string>,conflict:boolean,conflicting_values:map<string,array<string>>>"
ITEMS = "array<struct<value:string,confidence:double,sources:array<string>,methods:array<string>>>"
SKILLS = "array<struct<name:string,confidence:double,sources:array<string>,methods:array<string>>>"


def _none() -> Column:
    """A field that no source knows."""
    return F.from_json(F.lit('{"confidence":0.0,"sources":[],"methods":[],"conflict":false}'), FIELD)


def _list(payload: Column, schema: T.ArrayType) -> Column:
    """Payloads of one source, each an object or a list of them, as one list."""
    each = F.transform(payload, lambda p: F.coalesce(F.from_json(F.when(F.startswith(F.ltrim(p), F.lit("[")), p).otherwise(F.concat(F.lit("["), p, F.lit("]"))), schema), F.array().cast(schema)))
    return F.flatten(each)


#: The slot of a policy's result.
SLOTS = {"single": "f", "own": "f", "multi": "i", "skills": "s", "first_source": "p", "map_priority": "m", "map_first": "m"}


def canonical(ev: DataFrame, entities: DataFrame | None = None, distinct_sources: bool = False, policies: dict[str, str | Policy] = D.POLICIES) -> DataFrame:
    """A profile for each entity of normalized evidence; entities (entity_id): those that must have one even without.

    policies: what each field is merged by, a word of SLOTS or a Policy, which stands where "single" does; those of D.POLICIES may be changed only within their slot, others may be added.

    The evidence is read for values, for payloads and for maps; each reading groups by (entity, field, key) and by (entity, field).
    All results are then grouped by entity once.
    """
    own = {f: p for f, p in policies.items() if isinstance(p, Policy)}
    policies = {f: "own" if f in own else p for f, p in policies.items()}
    if wrong := {f: p for f, p in policies.items() if p not in SLOTS} or {f: p for f, p in D.POLICIES.items() if SLOTS.get(policies.get(f)) != SLOTS[p]}:
        raise ValueError(f"no such policies: {wrong}")
    of = lambda policy: [f for f, p in policies.items() if p == policy]
    ev = accepted(ev)
    field = F.col("field_name")
    shape = {"f": FIELD, "i": ITEMS, "s": SKILLS, "p": "array<string>", "m": "map<string,string>"}

    def part(df: DataFrame, name: Column, **slots: str) -> DataFrame:
        return df.select("entity_id", name.alias("name"), *[(F.col(slots[k]) if k in slots else F.lit(None)).cast(kind).alias(k) for k, kind in shape.items()])

    parts = [
        part(M.merge_values(ev, of("single"), of("multi"), distinct_sources, tuple(of("skills"))), field, f="single", i="items", s="skills"),
        part(M.first_source(ev.where(field.isin(*of("first_source"))), keep_all=True), field, p="payload"),
        part(M.merge_maps(ev.where(field.isin(*of("map_priority"), *of("map_first"))), of("map_priority")), field, m="entries"),
    ]
    if own:
        parts.append(part(merged_fields(ev, own), field, f="single"))
    if entities is not None:
        parts.append(part(entities.select("entity_id").distinct(), F.lit("")))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    pick = lambda name, slot: F.max_by(slot, F.when(F.col("name") == name, F.lit(1))).alias(name)
    slots = {f: SLOTS[p] for f, p in policies.items()}
    wide = long.groupBy("entity_id").agg(*[pick(name, slot) for name, slot in slots.items()])
    empty_map = F.create_map().cast("map<string,string>")
    blank = {"f": _none(), "i": F.array().cast(ITEMS), "s": F.array().cast(SKILLS), "p": F.array().cast("array<string>"), "m": empty_map}
    lists = {"experience": EXPERIENCE, "education": EDUCATION}
    filled = {name: F.coalesce(name, blank[slot]) for name, slot in slots.items()}
    wide = wide.select("entity_id", *[(_list(v, lists[name]) if name in lists else v).alias(name) for name, v in filled.items()])
    email, phone = (F.get(F.col(k), 0)["value"] for k in D.MULTI_FIELDS)
    name = F.col("full_name.value")
    contact = (F.size("emails") > 0) | (F.size("phones") > 0)
    return wide.select("entity_id", entity_hash(email, phone, name).alias("candidate_id"), *slots, tier(name, F.col("current_title.value"), contact).alias("overall_confidence"))


def conflicts(profiles: DataFrame) -> DataFrame:
    """(entity_id, kind, message) for each contested name, company and title."""
    shown = ("full_name", "current_company", "current_title")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.value").alias("value"), F.col(f"{f}.conflict").alias("conflict"), F.col(f"{f}.conflicting_values").alias("others")) for f in shown])
    rows = profiles.select("entity_id", F.explode(cells).alias("c")).where("c.conflict")
    text = F.concat(F.lit("conflict on '"), F.col("c.field"), F.lit("': resolved to "), F.coalesce(F.concat(F.lit("'"), F.col("c.value"), F.lit("'")), F.lit("None")), F.lit(" (other values seen: "), F.array_join(F.array_sort(F.map_keys("c.others")), ", "), F.lit(")"))
    return rows.select("entity_id", F.lit("conflict").alias("kind"), text.alias("message"))
