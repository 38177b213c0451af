import json
import time

import pytest
from pyspark.sql import functions as F

from tests.test_engine import PROFILE, RECRUITER, RESUME, files  # noqa: F401
from tributary.__main__ import main
from tributary.plans import config as C
from tributary.plans.compare import compare, key_difference
from tributary.plans.engine import RunResult, resolve, run
from tributary.plans.insights import with_insights
from tributary.plans.service import answer, refused
from tributary.sources.writers import envelope, read_run, write_json, write_run
from tributary.streaming.evidence import value_counts


def test_command(spark, files, tmp_path, capsys):  # noqa: F811
    paths = files(recruiter__csv=RECRUITER, linkedin__json=json.dumps(PROFILE))
    assert main(["--sources", *paths, "--show-canonical"], spark) == 0
    out, err = capsys.readouterr()
    assert json.loads(out)["full_name"] == "Mira Castell Ono" and "[warn] conflict on 'full_name'" in err and "canonical profile" in err
    config = tmp_path / "c.json"
    config.write_text('{"fields": [{"path": "years_of_experience"}], "on_missing": "error"}')
    assert main(["--sources", *paths, "--config", str(config)], spark) == 1
    assert main(["--sources", *paths, "--out", str(tmp_path / "o.json")], spark) == 0 and json.loads((tmp_path / "o.json").read_text())["overall_confidence"] == 0.3


def test_answer(spark, files):  # noqa: F811
    got = answer(spark, files(resume__txt="x", r__pdf=RESUME), config_json='{"fields": [{"path": "full_name"}]}', extract=lambda b: b.decode())
    assert got["ok"] and got["output"] == {"full_name": "MIRA CASTELL ONO"} and got["discovered_urls"]["linkedin"] == "https://linkedin.com/in/mira"
    assert {"LinkedIn enrichment unavailable", "Profile incomplete: missing email, phone, skills", "source 'resume.txt' skipped: CSV has no data rows"} <= set(got["warnings"])
    rows = answer(spark, files(b__csv="name,email\nA,a@x.com\nB,b@x.com\n"))
    assert [c["output"]["full_name"] for c in rows["candidate_outputs"]] == ["A", "B"] and rows["output"]["full_name"] == "A"
    assert refused([]) and refused(["a.doc"]) and refused(["a.CSV", "b.txt"]) is None


def test_text_as_document(spark, files):  # noqa: F811
    r = run(spark, files(notes__txt=RESUME), text_as_document=True)
    assert r.output.first()["current_title"] == "AI Intern"


def test_presets(tmp_path):
    (tmp_path / "b.json").write_text('{"fields": []}')
    assert C.presets(tmp_path) == ["default", "b", "minimal", "public_profile", "strict_required"] and all(C.load(n) == C.PRESETS[n] for n in C.PRESETS) and C.load("b", folder=tmp_path) == {"fields": []} and C.load("default") is None
    assert C.output_schema({"fields": [{"path": "a", "type": "string[]", "required": True}, {"path": "b"}]}) == {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "string"}}, "b": {}}, "required": ["a"]}


def test_configs_in_a_column(spark):
    cases = [{"fields": [{"path": "a", "type": "string[]", "required": True}, {"path": "b"}]}, [], {"on_missing": "none"}, {"fields": [{"path": " ", "type": "text"}, 1], "include_confidence": 1}, {"fields": [], "on_missing": None}, 5, "x", None, {}]
    cases += [{"fields": [{"path": "a", "from": 3, "required": "x", "normalize": "lower"}, {"path": None}], "include_provenance": True, "on_missing": "omit"}, {"fields": {"a": 1}}, {"fields": [{"path": "a", "type": "number", "required": True}, {"path": "a"}], "on_missing": "omit"}]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)] + [(98, "{"), (99, None)], "i int, c string")
    for r in df.select("i", C.column_errors(F.col("c")).alias("errors"), C.column_schema(F.col("c")).alias("shape")).collect():
        want = C.config_errors(cases[r.i]) if r.i < len(cases) else ["config must be a JSON object"]
        assert r.errors == want
        assert (json.loads(r.shape) if r.shape else None) == (None if want else C.output_schema(cases[r.i]))


def test_two_runs_compared(spark):
    a = spark.createDataFrame([(1, '{"a":1,"b":{"c":[1,{"d":"x"}],"e":{}},"n":null,"l":[]}'), (2, '{"a":1}'), (3, None), (4, "[1]"), (None, '{"q":1}'), (6, '{"a":{"b":{"c":1}}}')], "entity_id int, output_json string")
    b = spark.createDataFrame([(1, '{"a":2,"b":{"c":[1]},"n":null}'), (2, '{"a":1}'), (3, '{"z":1}'), (None, '{"q":2}'), (6, '{"a":{"b":{"c":2}}}')], "entity_id int, output_json string")
    want = {(1, "$.a", "differs", "1", "2"), (1, "$.b.c[1].d", "only_left", '"x"', None), (1, "$.b.e", "only_left", "{}", None), (1, "$.l", "only_left", "[]", None), (3, "$.z", "only_right", None, "1"), (4, "$[0]", "only_left", "1", None), (None, "$.q", "differs", "1", "2"), (6, "$.a.b.c", "differs", "1", "2")}
    assert set(map(tuple, compare(a, b).collect())) == want and compare(a, a).count() == 0
    shallow = {tuple(r) for r in compare(a, b, depth=1).collect() if r.entity_id == 6}
    assert shallow == {(6, "$.a", "differs", '{"b":{"c":1}}', '{"b":{"c":2}}')}
    keys = spark.createDataFrame([('{"a":1,"b":2}', '{"b":1,"c":1}'), ("[1]", '{"c":1}'), (None, None)], "a string, b string")
    assert [(r.x, r.y) for r in keys.select(*[k.alias(n) for k, n in zip(key_difference(F.col("a"), F.col("b")), "xy")]).collect()] == [(["a"], ["c"]), ([], ["c"]), ([], [])]


def test_sinks_and_insights(spark, files, tmp_path):  # noqa: F811
    r = run(spark, files(recruiter__csv=RECRUITER))
    write_json(r.output, str(tmp_path / "o"), "output_json")
    assert json.loads(spark.read.text(str(tmp_path / "o")).first()[0])["current_company"] == "Google"
    assert envelope(r).count() == 1
    told = with_insights(r.output, lambda t: '```json\n{"recruiter_summary": "s", "strengths": ["a"], "concerns": ["c"]}\n```').first()
    assert told["insights"].asDict() == {"summary": "s", "strengths": ["a"], "recommended_roles": [], "missing_information": [], "potential_concerns": ["c"]}

    def broken(text):
        raise RuntimeError("429 quota")

    assert with_insights(r.output, broken).first()["insights_error"].startswith("API quota") and with_insights(r.output, None).first()["insights"] is None


def test_stream(spark, tmp_path):
    from tributary.operators.evidence import evidence

    rows = spark.createDataFrame([("e", "v", "s1", "2024-01-01 00:00:00"), ("e", " V ", "s2", "2024-01-01 01:00:00")], "e string, v string, s string, t string")
    ev = evidence(rows, F.col("e"), F.lit("current_company"), F.col("v"), F.col("s"), F.lit("structured"), F.lit("m")).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    ev.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = value_counts(stream, "at").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("counts").first()
    assert (got["key"], got["n"], got["confidence"]) == ("v", 2, 0.8)
    assert resolve(ev.drop("at")).output.count() == 1


def test_touched_entities_are_resolved_again(spark, tmp_path):
    from tributary.operators.evidence import evidence
    from tributary.streaming.evidence import resolve_touched

    def arrive(n, *facts):
        rows = spark.createDataFrame(list(facts), "e string, v string, s string")
        evidence(rows, F.col("e"), F.lit("current_company"), F.col("v"), F.col("s"), F.lit("structured"), F.lit("m"), ev_seq=F.lit(n)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    got = []
    take = lambda result, number: got.append({r.entity_id: r.current_company for r in result.output.collect()})
    arrive(0, ("a", "X", "s1"), ("b", "Y", "s1"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = resolve_touched(stream, str(tmp_path / "store"), take, str(tmp_path / "check"))
    q.processAllAvailable()
    arrive(1, ("a", "Z", "s2"))
    q.processAllAvailable()
    q.stop()
    assert got == [{"a": "X", "b": "Y"}, {"a": None}]


def test_a_run_is_there_entirely_or_not_at_all(spark, tmp_path):
    from tributary.operators.evidence import evidence

    facts = spark.createDataFrame([("a", "full_name", "Ann\nBo"), ("a", "emails", "A@x.org"), ("b", "current_company", "X")], "e string, f string, v string")
    result = resolve(evidence(facts, F.col("e"), F.col("f"), F.col("v"), F.lit("s"), F.lit("structured"), F.lit("m")))
    folder = f"file://{tmp_path}/runs"
    with pytest.raises(KeyError):
        read_run(spark, folder, "one")
    broken = RunResult(result.output, result.canonical, result.warnings.select("entity_id", "kind", F.raise_error(F.lit("killed")).cast("string").alias("message")), None, None, None)
    with pytest.raises(Exception, match="killed"):
        write_run(broken, folder, "one")
    with pytest.raises(KeyError):  # what was written of it isn't seen
        read_run(spark, folder, "one")
    assert write_run(result, folder, "one") == "one"
    before = sorted(p.name for p in (tmp_path / "runs").iterdir())
    assert write_run(result, folder, "one") == "one" and sorted(p.name for p in (tmp_path / "runs").iterdir()) == before
    back = read_run(spark, folder, "one")
    for name in ("output", "warnings"):
        got, want = getattr(back, name), getattr(result, name)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    assert {json.loads(r.profile)["entity_id"] for r in back.canonical.collect()} == {"a", "b"}


def test_nothing_is_asked_twice(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def ask(text):
        (asked / f"{text[1:4]}-{time.time_ns()}").write_text(text)
        if "bad" in text:
            raise RuntimeError("503")
        return '{"summary": "s"}'

    outputs = spark.createDataFrame([(i, t) for i, t in enumerate(['"x1"', '"x1"', '"x2"', '"bad"', None])], "entity_id long, output_json string").repartition(3)
    memo = f"file://{tmp_path}/memo"
    for n in (2 + 2, 2 + 2 + 2):  # two texts and two attempts; later only those that had no answer
        got = {r.entity_id: (r.insights and r.insights.summary, r.insights_error) for r in with_insights(outputs, ask, memo, attempts=2).collect()}
        assert got == {0: ("s", None), 1: ("s", None), 2: ("s", None), 3: (None, "All models are currently overloaded. Please try again later."), 4: (None, None)}
        assert len(list(asked.iterdir())) == n
