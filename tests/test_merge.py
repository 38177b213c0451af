import random
import time

from pyspark.sql import functions as F

from tributary.operators import evidence as E
from tributary.operators import merge as M
from tributary.operators import policies as Q
from tributary.operators import provenance as P
from tributary.operators.profile import canonical
from tributary.functions import dicts as D


def rows(spark, field, *facts):
    """facts: (value, source, type?)"""
    data = [("e", i, i, field, f[0], f[1], f[2] if len(f) > 2 else "structured") for i, f in enumerate(facts)]
    df = spark.createDataFrame(data, "entity string, s int, n int, f string, v string, source string, kind string")
    return E.normalized(E.evidence(df, F.col("entity"), F.col("f"), F.col("v"), F.col("source"), F.col("kind"), F.lit("m"), F.col("s"), F.col("n")))


def single(spark, field, *facts, **options):
    ev = rows(spark, field, *facts)
    found = M.merge_single(ev, **options).collect()
    if not options.get("distinct_sources"):  # the same without sources
        columns = ("value", "confidence", "conflict", "n_values")
        assert [[r[c] for c in columns] for r in M.single_counts(ev).collect()] == [[r[c] for c in columns] for r in found]
    return found[0].asDict() if found else None


def test_unanimous(spark):
    x = single(spark, "current_company", ("Google", "a"), ("Google", "b"))
    assert (x["value"], x["confidence"], x["conflict"], x["conflicting_values"]) == ("Google", 0.8, False, None)


def test_nothing(spark):
    assert single(spark, "current_company", ("  ", "a"), (None, "b")) is None


def test_containment(spark):
    x = single(spark, "full_name", ("Mira Castell", "a"), ("Mira Castell Ono", "b"), ("Mira Castell Ono", "c"))
    assert (x["value"], x["confidence"], x["conflict"], x["sources"], x["methods"]) == ("Mira Castell Ono", 0.81, True, ["a", "b", "c"], ["m", "m"])
    assert x["conflicting_values"] == {"mira castell": ["Mira Castell"]}


def test_tie_is_null(spark):
    x = single(spark, "current_company", ("Google", "a"), ("Microsoft", "b"), ("Amazon", "c"))
    assert (x["value"], x["confidence"], x["conflict"], len(x["conflicting_values"])) == (None, 0.0, True, 3)


def test_plurality(spark):
    x = single(spark, "current_title", ("Software Engineer", "a"), ("software  engineer", "b"), ("Software Engineer II", "c"))
    assert (x["value"], x["confidence"], list(x["conflicting_values"])) == ("Software Engineer", 0.68, ["software engineer ii"])


def test_distinct_sources_corroborate_once(spark):
    assert single(spark, "current_company", ("G", "a"), ("G", "a"), distinct_sources=True)["confidence"] == 0.65


def test_ranked_values(spark):
    items = M.merge_multi(rows(spark, "emails", ("a@x", "l.json"), ("a@x", "r.csv"), ("b@x", "r.csv"))).collect()[0]["items"]
    assert [(i["value"], i["confidence"]) for i in items] == [("a@x", 0.8), ("b@x", 0.65)]


def test_skills_unify(spark):
    items = M.merge_skills(rows(spark, "skills", ("ReactJS", "linkedin"), ("React", "resume"), ("weird thing", "linkedin"))).collect()[0]["items"]
    assert [(i["name"], i["confidence"], i["sources"]) for i in items] == [("React", 0.8, ["resume", "linkedin"]), ("Weird Thing", 0.59, ["linkedin"])]


def test_order_of_rows_and_partitions_does_not_matter(spark):
    ev = rows(spark, "current_title", *[(f"v{i % 4}", f"s{i % 3}") for i in range(40)])
    want = M.merge_single(ev).collect()
    for n in (1, 7):
        assert M.merge_single(ev.repartition(n).orderBy(F.rand(n))).collect() == want


def slow_fuller(keys):
    def within(a, b):
        words = iter(b)
        return len(a) < len(b) and all(w in words for w in a)

    cut = [k.split(" ") for k in keys]
    return next((k for k, b in zip(keys, cut) if all(a == b or within(a, b) for a in cut)), None)


def test_fuller_names_against_all_pairs(spark):
    r = random.Random(1)
    groups = []
    for _ in range(400):
        full = [r.choice("abcde") for _ in range(r.choice((3, 8, 40)))]
        keys = {" ".join(w for w in full if r.random() < 0.5) or "a" for _ in range(r.randrange(1, 4))} | {" ".join(full)}
        groups.append(sorted(keys | ({r.choice("abcdef")} if r.random() < 0.7 else set())))
    df = spark.createDataFrame([(i, [(k,) for k in g]) for i, g in enumerate(groups)], "i int, g array<struct<key:string>>")
    got = {x.i: x.key for x in df.select("i", M.fuller(F.col("g"))["key"].alias("key")).collect()}
    want = {i: slow_fuller(g) for i, g in enumerate(groups)}
    assert got == want and 50 < sum(v is not None for v in want.values()) < 350


def test_fuller_names_of_many_words(spark):
    """16,000 words, beside parts that are nearly as long and hundreds that are short."""
    words = [f"w{i}" for i in range(16_000)]
    keys = [" ".join(words), " ".join(words[1:]), *(f"w{i} w{i + 5000} w{i + 9000}" for i in range(500))]
    df = spark.createDataFrame([([(k,) for k in g],) for g in (keys, [*keys, "w7 w3"])], "g array<struct<key:string>>").repartition(1)
    df.select(M.fuller(F.col("g"))["key"]).collect()
    began = time.time()
    assert [x[0] and len(x[0]) for x in df.select(M.fuller(F.col("g"))["key"]).collect()].count(None) == 1
    assert time.time() - began < 5


def test_long_provenance_says_what_the_arrays_say(spark):
    r = random.Random(7)
    names = ["Ann", "Ann Bo", "ann  bo", "Ann Cy Bo", "Dee", None, " "]
    data = [(r.choice("abcdefgh") if r.random() < 0.9 else None, r.randrange(4), i % 97, r.choice(["full_name", "current_title"]), r.choice(names), f"s{r.randrange(3)}", f"m{r.randrange(2)}") for i in range(160)]
    df = spark.createDataFrame(data + data[:5], "e string, s int, n int, f string, v string, source string, m string").repartition(5)
    ev = E.normalized(E.evidence(df, F.col("e"), F.col("f"), F.col("v"), F.col("source"), F.lit("structured"), F.col("m"), F.col("s"), F.col("n")))
    want = {(x.entity_id, x.field_name): x for x in M.merge_single(ev).withColumn("p", M.provenance(F.col("sources"), F.col("methods"), F.col("field_name"))).collect()}
    told = P.facts(ev)
    got, keys, said = {}, {}, {}
    for x in sorted(P.provenance_rows(told).collect(), key=lambda x: x.at):
        got.setdefault((x.entity_id, x.field_name), []).append((x.source, x.method))
    assert got == {k: [(y.source, y.method) for y in v.p] for k, v in want.items()}
    for x in sorted(P.conflicting(told).collect(), key=lambda x: (x.source_seq, x.ev_seq, x.source_id, x.value)):
        keys.setdefault((x.entity_id, x.field_name), {}).setdefault(x.key, []).append(x.raw_value)
    assert keys == {k: v.conflicting_values for k, v in want.items() if v.conflicting_values}
    for x in P.conflict_counts(ev).collect():
        said.setdefault((x.entity_id, x.field_name), {})[x.key] = x.n
    assert said == {k: {a: len(b) for a, b in v.conflicting_values.items()} for k, v in want.items() if v.conflicting_values}
    for x in P.sources(told).groupBy("entity_id", "field_name").count().collect():
        assert x["count"] == len(want[x.entity_id, x.field_name].sources)
    assert {v.conflict for v in want.values()} == {True, False} and any(v.value is None for v in want.values()) and any(len(v.sources) > len(v.methods) for v in want.values())


def test_numbers_of_a_hot_group(spark):
    df = spark.range(20_000).select(F.when(F.col("id") < 15_000, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.xxhash64("id").alias("x"))
    rows = P.numbered(df, ["k"], ["x"])
    assert [r.number for r in rows.where("k = 'hot'").orderBy("x").collect()] == list(range(15_000)) and rows.where("k <> 'hot' and number > 0").count() == 0


def by_policy(spark, policy, *facts):
    found = Q.merge_by(rows(spark, "current_title", *facts), {"current_title": policy}).collect()
    return [(r["value"], r["confidence"], r["n_values"]) for r in found]


def test_weighted_plurality(spark):
    weak, strong = "unstructured", "structured"
    assert by_policy(spark, Q.weighted_plurality(), ("a", "x", weak), ("b", "y", strong)) == [("b", 0.65 / 1.15, 2)]
    assert by_policy(spark, Q.weighted_plurality(), ("a", "x", weak), ("B", "y", strong), ("A ", "z", weak)) == [("a", 1.0 / 1.65, 2)]
    assert by_policy(spark, Q.weighted_plurality(), ("b", "x"), ("a", "y")) == [("b", 0.5, 2)]  # said first
    assert by_policy(spark, Q.weighted_plurality(F.lit(0)), ("b", "x")) == [("b", 0.0, 1)]
    assert by_policy(spark, Q.weighted_plurality(), (None, "x"), (" ", "y")) == []


def test_latest(spark):
    assert by_policy(spark, Q.latest(), ("a", "x", "structured"), ("b", "y"), ("A", "z", "unstructured")) == [("A", 0.5, 2)]
    assert by_policy(spark, Q.latest(-F.col("ev_seq")), ("a", "x", "structured"), ("b", "y")) == [("a", 0.65, 2)]
    assert by_policy(spark, Q.latest(), ("a", "x"), ("a", "x")) == [("a", 0.65, 1)]


def test_policy_without_partial(spark):
    most = Q.Policy(lambda p: F.max(p["key"]), lambda p: F.max(p["weight"]), {}, key=lambda v: F.substring(v, 1, 1))
    assert by_policy(spark, most, ("ab", "x"), ("ac", "y"), ("b", "z")) == [("b", 0.65, 2)]


def test_profile_by_own_policies(spark):
    ev = rows(spark, "current_title", ("a", "x", "unstructured"), ("b", "y"), ("c", "z", "unstructured")).unionByName(rows(spark, "team", ("u", "x"), ("v", "y")))
    title = canonical(ev, policies=D.POLICIES | {"current_title": Q.weighted_plurality(), "team": Q.latest()}).first().asDict(True)
    assert title["team"]["value"] == "v" and title["full_name"]["value"] is None
    title = title["current_title"]
    assert (title["value"], title["conflict"], title["sources"], title["conflicting_values"]) == ("b", True, ["x", "y", "z"], {"a": ["a"], "c": ["c"]})
