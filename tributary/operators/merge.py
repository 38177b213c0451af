"""Conflict-resolving aggregation: many facts about a field of an entity become one value, or a ranked list.

Every operator groups twice at most, on (entity, field, key) and then on (entity, field); the second
shuffle carries a row for each distinct value. Order is never that of arrival: places (source_seq, ev_seq) travel along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.confidence import confidence
from tributary.functions.text import canonical_skill, key_of, let
from tributary.operators.evidence import ranked

#: Fields in which a longer value that holds all the others word by word is no conflict but the fuller name.
CONTAINMENT = ("full_name",)


def place() -> Column:
    """A row's place; the rest settles rows that share one."""
    return F.struct("source_seq", "ev_seq", "source_id", "value")


def _each(rows: Column, name: str) -> Column:
    return F.transform(rows, lambda r: r[name])


#: Steps of a binary search in an array of any size.
HALVES = [1 << i for i in range(30, -1, -1)]
#: A name so many times as long as another is searched for its words, and else read through.
FAR = 16


def _read_through(a: Column, b: Column) -> Column:
    """Whether the words a are found in b in their order, in one pass over b."""
    return F.aggregate(b, F.lit(0), lambda i, t: F.when(F.get(a, i) == t, i + 1).otherwise(i)) == F.size(a)


def _searched(a: Column, places: Column, halves: Column) -> Column:
    """The same by the sorted (word, place) of b: each word of a is searched for behind the place of the one before."""

    def behind(last: Column, t: Column) -> Column:
        least = F.struct(t.alias("w"), (last + 1).alias("i"))
        at = F.aggregate(halves, F.lit(0), lambda lo, k: F.when(F.get(places, lo + k - 1) < least, lo + k).otherwise(lo))
        return let(F.get(places, at), lambda hit: F.when(hit["w"] == t, hit["i"]).otherwise(-2))

    return F.aggregate(a, F.lit(-1), lambda last, t: F.when(last == -2, last).otherwise(behind(last, t))) > -2


def is_token_subsequence(short: Column, long: Column) -> Column:
    """Whether the words of short, fewer, are found in long in their order."""
    return let(F.split(short, " "), lambda a: let(F.split(long, " "), lambda b: (F.size(a) < F.size(b)) & _read_through(a, b)))


def fuller(groups: Column) -> Column:
    """Of an array of structs with a key the one whose words hold those of all other keys, or null.

    Only the key of most words can, and only alone. Each other key costs its own words, or FAR times that, however long the fullest is.
    """

    def held(every: Column, b: Column) -> Column:
        far = lambda y: F.size(y["w"]) * FAR < F.size(b)
        places = F.when(F.exists(every, far), F.array_sort(F.transform(b, lambda t, i: F.struct(t.alias("w"), i.alias("i")))))
        inside = lambda p, h: F.forall(every, lambda y: (F.size(y["w"]) == F.size(b)) | F.when(far(y), _searched(y["w"], p, h)).otherwise(_read_through(y["w"], b)))
        return let(places, lambda p: let(F.filter(F.array(*map(F.lit, HALVES)), lambda k: k <= F.size(b)), lambda h: inside(p, h)))

    def of(every: Column) -> Column:
        most = F.array_max(F.transform(every, lambda x: F.size(x["w"])))
        return let(let(most, lambda n: F.filter(every, lambda x: F.size(x["w"]) == n)), lambda top: F.when(F.size(top) == 1, let(F.get(top, 0), lambda x: F.when(held(every, x["w"]), x["g"]))))

    return let(F.transform(groups, lambda x: F.struct(x.alias("g"), F.split(x["key"], " ").alias("w"))), of)


def value_groups(ev: DataFrame, by: list[str] = ["entity_id", "field_name"], rows: bool = True) -> DataFrame:
    """A row for each distinct key of a field: n, first, weight, longest value, rows in order. Without rows nothing of it grows with n, and all of it is combined before the shuffle."""
    at = place()
    row = F.struct(at.alias("at"), F.col("source_id").alias("source"), "method", F.col("raw_value").alias("raw"))
    keyed = ranked(ev.where(F.col("value") != "") if rows else ev).withColumn("key", key_of(F.col("value")))
    groups = keyed.groupBy(*by, "key").agg(
        F.count("*").alias("n"),
        F.min(at).alias("first"),
        F.max("weight").alias("weight"),
        F.min(F.struct((-F.length("value")).alias("l"), at.alias("at"))).alias("longest"),
        (F.array_sort(F.collect_list(row)) if rows else F.lit(None).cast("array<int>")).alias("rows"),
    ).withColumn("longest", F.col("longest.at.value"))
    return groups.where(F.col("longest") != "")  # here, as a filter of the rows would compute their values another time


def single_counts(ev: DataFrame, by: list[str] = ["entity_id", "field_name"], containment: tuple[str, ...] = CONTAINMENT) -> DataFrame:
    """value, confidence, conflict, n_values as merge_single has them, without sources: a field of very many rows costs one row for each distinct value."""
    return decisions(ev, by, containment).select(*by, "value", "confidence", "conflict", "n_values")


def decisions(ev: DataFrame, by: list[str] = ["entity_id", "field_name"], containment: tuple[str, ...] = CONTAINMENT) -> DataFrame:
    """What single_counts() has, the case (agreed, contained, plurality, tie), and the key that wins; a tie's is null."""
    one = value_groups(ev, by, rows=False).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "first", "key", "n", "weight", "longest"))).alias("g"))
    g = F.col("g")
    top, second = F.get(g, 0), F.get(g, 1)
    fields = F.col("field_name").isin(*containment) if "field_name" in by and containment else F.lit(False)
    one = one.withColumn("whole", F.when(fields & (F.size(g) > 1), fuller(g)))
    alone, whole, plural = F.size(g) == 1, F.col("whole").isNotNull(), top["n"] > second["n"]
    best, total = F.array_max(_each(g, "weight")), F.aggregate(_each(g, "n"), F.lit(0).cast("long"), lambda a, x: a + x)
    value = F.when(alone, top["longest"]).when(whole, F.col("whole.longest")).when(plural, top["longest"])
    conf = F.when(alone, confidence(top["weight"], top["n"])).when(whole, confidence(best, total, "partial")).when(plural, confidence(top["weight"], top["n"], "partial")).otherwise(F.lit(0.0))
    case = F.when(alone, "agreed").when(whole, "contained").when(plural, "plurality").otherwise("tie")
    key = F.when(whole & ~alone, F.col("whole.key")).when(alone | plural, top["key"])
    return one.select(*by, value.alias("value"), conf.alias("confidence"), (~alone).alias("conflict"), F.size(g).alias("n_values"), case.alias("case"), key.alias("key"))


def single_of(one: DataFrame, g: str, contained: Column | None, distinct_sources: bool = False) -> tuple[DataFrame, dict[str, Column]]:
    """What a field's groups (n, first, key, weight, longest, rows) come to, as columns over the DataFrame that is returned with them.

    contained: whether a fuller name may win.
    """
    sorted_ = F.array_sort(F.transform(g, lambda x: F.struct((-x["n"]).alias("minus"), x["first"].alias("first"), x["key"].alias("key"), x["n"].alias("n"), x["weight"].alias("weight"), x["longest"].alias("longest"), x["rows"].alias("rows"))))
    one = one.withColumn("_g", sorted_)
    g_ = F.col("_g")
    top, second = F.get(g_, 0), F.get(g_, 1)
    if contained is not None:
        whole = F.when(contained & (F.size(g_) > 1), fuller(g_))
    else:
        whole = F.lit(None).cast(one.schema["_g"].dataType.elementType)
    one = one.withColumn("_whole", whole)
    case = F.when(F.size(g_) == 1, "agreed").when(F.col("_whole").isNotNull(), "contained").when(top["n"] > second["n"], "plurality").otherwise("tie")
    one = one.withColumn("_case", case).withColumn("_win", F.coalesce(F.col("_whole"), top))
    win, c = F.col("_win"), F.col("_case")
    rows_all = F.array_sort(F.flatten(F.transform(g_, lambda x: x["rows"])))
    rows_win = F.array_sort(win["rows"])
    count = (lambda rows: F.size(F.array_distinct(_each(rows, "source")))) if distinct_sources else F.size
    best = F.array_max(F.transform(g_, lambda x: x["weight"]))
    conf = F.when(c == "agreed", confidence(win["weight"], count(rows_win))).when(c == "contained", confidence(best, count(rows_all), "partial")).when(c == "plurality", confidence(win["weight"], count(rows_win), "partial")).otherwise(F.lit(0.0))
    losers = F.when(c == "tie", g_).otherwise(F.filter(g_, lambda x: x["key"] != win["key"]))
    other = F.map_from_entries(F.transform(losers, lambda x: F.struct(x["key"], _each(F.array_sort(x["rows"]), "raw"))))
    return one, {
        "value": F.when(c != "tie", win["longest"]),
        "confidence": conf,
        "sources": F.when(c.isin("contained", "tie"), _each(rows_all, "source")).otherwise(_each(rows_win, "source")),
        "methods": F.when(c == "tie", _each(rows_all, "method")).otherwise(_each(rows_win, "method")),
        "conflict": c != "agreed",
        "conflicting_values": F.when(c != "agreed", other),
        "n_values": F.size(g_),
    }


def merge_single(ev: DataFrame, by: list[str] = ["entity_id", "field_name"], containment: tuple[str, ...] = CONTAINMENT, distinct_sources: bool = False) -> DataFrame:
    """value, confidence, sources, methods, conflict, conflicting_values, n_values of each field of each entity.

    One distinct value is agreed on. A fuller name wins over its parts, the most frequent value over the others, both
    for less confidence; a tie at the top has no value, no confidence. distinct_sources: a source corroborates once, however many rows it has.
    """
    one = value_groups(ev, by).groupBy(*by).agg(F.collect_list(F.struct("key", "n", "first", "weight", "longest", "rows")).alias("g"))
    one, columns = single_of(one, "g", F.col("field_name").isin(*containment) if "field_name" in by and containment else None, distinct_sources)
    return one.select(*by, *[v.alias(k) for k, v in columns.items()])


def merge_values(ev: DataFrame, singles: list[str], multis: list[str], distinct_sources: bool = False, skills: tuple[str, ...] = ("skills",)) -> DataFrame:
    """(entity_id, field_name, single, items, skills) of all fields of these kinds at once: what merge_single, merge_multi and merge_skills give, in two shuffles of one reading."""
    field = F.col("field_name")
    is_single, is_multi, is_skill = field.isin(singles), field.isin(multis), field.isin(*skills)
    rows = ranked(ev.where(is_single | is_multi | is_skill)).withColumn("_s", F.when(is_skill, canonical_skill(F.col("raw_value"))))
    key = F.when(is_single, key_of(F.col("value"))).when(is_multi, F.col("value")).otherwise(F.col("_s.name"))
    rows = rows.withColumn("key", key).where((F.col("key") != "") & (is_skill | (F.col("value") != "")))
    at = place()
    row = F.struct(at.alias("at"), F.col("source_id").alias("source"), "method", F.col("raw_value").alias("raw"), "rank")
    by = ["entity_id", "field_name"]
    groups = rows.groupBy(*by, "key").agg(
        F.count("*").alias("n"), F.max("weight").alias("weight"), F.min("rank").alias("rank"), F.bool_or(F.col("_s.known")).alias("known"), F.min(at).alias("first"),
        F.min(F.struct((-F.length("value")).alias("l"), at.alias("at"))).alias("longest"), F.array_sort(F.collect_list(row)).alias("rows"),
    ).withColumn("longest", F.col("longest.at.value"))
    one = groups.groupBy(*by).agg(F.collect_list(F.struct("key", "n", "weight", "rank", "known", "first", "longest", "rows")).alias("g"))
    one, single = single_of(one, "g", field.isin(*CONTAINMENT), distinct_sources)
    single.pop("n_values")

    def ranked_list(conf, order, name: str, sources) -> Column:
        items = F.transform("g", lambda x: F.struct((-conf(x)).alias("minus"), order(x).alias("rank"), x["key"].alias("key"), conf(x).alias("confidence"), sources(x).alias("sources"), _each(x["rows"], "method").alias("methods")))
        return F.transform(F.array_sort(items), lambda x: F.struct(x["key"].alias(name), x["confidence"].alias("confidence"), x["sources"].alias("sources"), x["methods"].alias("methods")))

    def best_first(x: Column) -> Column:
        return F.array_distinct(_each(F.array_sort(F.transform(x["rows"], lambda r: F.struct(r["rank"].alias("rank"), r["at"]["source_seq"].alias("seq"), r["source"].alias("source")))), "source"))

    agreed = lambda x: confidence(x["weight"], x["n"])
    by_name = lambda x: F.when(x["known"], agreed(x)).otherwise(confidence(x["weight"], x["n"], "unknown"))
    return one.select(
        *by,
        F.when(is_single, F.struct(*[v.alias(k) for k, v in single.items()])).alias("single"),
        F.when(is_multi, ranked_list(agreed, lambda x: x["rank"], "value", lambda x: _each(x["rows"], "source"))).alias("items"),
        F.when(is_skill, ranked_list(by_name, lambda x: F.lit(0), "name", best_first)).alias("skills"),
    )


def multi_values(ev: DataFrame, by: list[str] = ["entity_id", "field_name"]) -> DataFrame:
    """A row for each distinct value: confidence, rank (of its best source), sources, methods, n."""
    row = F.struct(place().alias("at"), F.col("source_id").alias("source"), "method")
    rows = ranked(ev.where(F.col("value") != ""))
    out = rows.groupBy(*by, "value").agg(F.count("*").alias("n"), F.max("weight").alias("weight"), F.min("rank").alias("rank"), F.array_sort(F.collect_list(row)).alias("rows"))
    return out.select(*by, "value", confidence(F.col("weight"), F.col("n")).alias("confidence"), "rank", _each(F.col("rows"), "source").alias("sources"), _each(F.col("rows"), "method").alias("methods"), "n")


def merge_multi(ev: DataFrame, by: list[str] = ["entity_id", "field_name"]) -> DataFrame:
    """items: all distinct values of a field by confidence, best source and value."""
    item = F.struct((-F.col("confidence")).alias("minus"), "rank", "value", "confidence", "sources", "methods")
    one = multi_values(ev, by).groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("i"))
    return one.select(*by, F.transform("i", lambda x: F.struct(x["value"].alias("value"), x["confidence"].alias("confidence"), x["sources"].alias("sources"), x["methods"].alias("methods"))).alias("items"))


def skill_values(ev: DataFrame, by: list[str] = ["entity_id"]) -> DataFrame:
    """A row for each skill, by its canonical name: confidence (less if no mention is a known name), sources (distinct, best first), methods, n."""
    named = ranked(ev).withColumn("_s", canonical_skill(F.col("raw_value"))).where("_s is not null").withColumns({"name": F.col("_s.name"), "known": F.col("_s.known")})
    source = F.struct("rank", "source_seq", F.col("source_id").alias("source"))
    method = F.struct("source_seq", "ev_seq", "source_id", "method")
    out = named.groupBy(*by, "name").agg(F.count("*").alias("n"), F.max("weight").alias("weight"), F.bool_or("known").alias("known"), F.array_sort(F.collect_set(source)).alias("s"), F.array_sort(F.collect_list(method)).alias("m"))
    conf = F.when(F.col("known"), confidence(F.col("weight"), F.col("n"))).otherwise(confidence(F.col("weight"), F.col("n"), "unknown"))
    return out.select(*by, "name", conf.alias("confidence"), F.array_distinct(_each(F.col("s"), "source")).alias("sources"), _each(F.col("m"), "method").alias("methods"), "known", "n")


def merge_skills(ev: DataFrame, by: list[str] = ["entity_id"]) -> DataFrame:
    item = F.struct((-F.col("confidence")).alias("minus"), "name", "confidence", "sources", "methods")
    one = skill_values(ev, by).groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("i"))
    return one.select(*by, F.transform("i", lambda x: F.struct(x["name"].alias("name"), x["confidence"].alias("confidence"), x["sources"].alias("sources"), x["methods"].alias("methods"))).alias("items"))


def first_source(ev: DataFrame, payload: str = "value_json", by: list[str] = ["entity_id", "field_name"], keep_all: bool = False) -> DataFrame:
    """The payload of the best source: its last one, or with keep_all the list of all, in order."""
    rows = ranked(ev.where(F.col(payload).isNotNull()))
    at = F.struct("source_seq", "ev_seq")
    value = _each(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col(payload).alias("v")))), "v") if keep_all else F.max_by(payload, at)
    per = rows.groupBy(*by, "source_id").agg(value.alias("payload"), F.min(F.struct("rank", at)).alias("best"))
    return per.groupBy(*by).agg(F.min_by("payload", F.struct("best", "source_id")).alias("payload"))


def map_entries(ev: DataFrame, order: Column, by: list[str] = ["entity_id", "field_name"]) -> DataFrame:
    """(key, value) of each key's first entry by order; blank values don't count."""
    entries = ranked(ev.where(F.col("value_map").isNotNull())).select("*", F.explode("value_map").alias("k", "v")).where(F.col("v").isNotNull() & (F.col("v") != ""))
    return entries.groupBy(*by, "k").agg(F.min_by("v", F.struct(order, F.col("v"))).alias("v"))


def _entries(ev: DataFrame, order: Column, by: list[str]) -> DataFrame:
    return map_entries(ev, order, by).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("entries"))


def _link_order() -> Column:
    return F.struct(F.col("rank").cast("long").alias("a"), (-F.col("source_seq")).cast("long").alias("b"), (-F.col("ev_seq")).cast("long").alias("c"))


def _first_order() -> Column:
    return F.struct(F.lit(0).cast("long").alias("a"), F.col("source_seq").cast("long").alias("b"), F.col("ev_seq").cast("long").alias("c"))


def merge_links(ev: DataFrame, by: list[str] = ["entity_id", "field_name"]) -> DataFrame:
    """entries: of each kind of link, the best source's; among sources of one rank the last one's."""
    return _entries(ev, _link_order(), by)


def merge_attributes(ev: DataFrame, by: list[str] = ["entity_id", "field_name"]) -> DataFrame:
    """entries: of each attribute, what was said first."""
    return _entries(ev, _first_order(), by)


def merge_maps(ev: DataFrame, priority: list[str] = ["links"]) -> DataFrame:
    """entries of all map fields at once, those of priority as merge_links has them, others as merge_attributes."""
    return _entries(ev, F.when(F.col("field_name").isin(*priority), _link_order()).otherwise(_first_order()), ["entity_id", "field_name"])


def ordered_text(df: DataFrame, by: list[str], order: Column, text: Column, sep: str = "\n") -> DataFrame:
    """The texts of a group, in order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return df.where(text.isNotNull()).groupBy(*by).agg(F.array_join(_each(rows, "t"), sep).alias("text"))


def provenance(sources: Column, methods: Column, field: Column) -> Column:
    """Distinct (field, source, method), in order; the shorter of the two lists sets the length."""
    n = F.least(F.size(sources), F.size(methods))
    pairs = F.zip_with(F.slice(sources, 1, n), F.slice(methods, 1, n), lambda s, m: F.struct(field.alias("field"), s.alias("source"), m.alias("method")))
    return F.array_distinct(pairs)
