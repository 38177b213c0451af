import json
import zlib

import pytest
from pyspark.sql import functions as F

from tributary.operators import sections as S
from tributary.plans import config as C
from tributary.plans.engine import run
from tributary.plans.validate import json_errors
from tributary.sources.pdf import pdf_text

RECRUITER = 'name,email,phone,current_company,title,skills\nMira Castell,mira@example.org,9876543210,Google,Software Engineer,"Java,Python,React,SQL"\n'
PROFILE = {"full_name": "Mira Castell Ono", "email": "mira.castell@example.org", "phone": "+91 98765 43210", "company": "Google", "position": "Software Engineer II", "skills": ["Java", "Python", "ReactJS", "SQL"]}


@pytest.fixture
def files(tmp_path):
    def write(**named):
        out = []
        for name, text in named.items():
            p = tmp_path / name.replace("__", ".")
            p.write_bytes(text if isinstance(text, bytes) else text.encode())
            out.append(str(p))
        return out

    return write


def output(result):
    r = result.output.collect()
    assert len(r) == 1
    return (json.loads(r[0]["output_json"]) if r[0]["output_json"] else None), r[0]["errors"]


def test_two_sources(spark, files):
    out, errors = output(r := run(spark, files(recruiter__csv=RECRUITER, linkedin__json=json.dumps(PROFILE))))
    assert errors == [] and out["candidate_id"] == "cand_3398677689" and out["full_name"] == "Mira Castell Ono"
    assert out["emails"] == ["mira@example.org", "mira.castell@example.org"] and out["phones"] == ["+919876543210"]
    assert out["current_title"] is None and out["overall_confidence"] == 0.3
    assert [s["name"] for s in out["skills"]] == ["Java", "Python", "React", "SQL"] and {s["confidence"] for s in out["skills"]} == {0.8}
    assert sorted(w["message"].split(":")[0] for w in r.warnings.collect()) == ["conflict on 'current_title'", "conflict on 'full_name'"]


def test_batch(spark, files):
    text = "name,email,phone,current_company,title,skills\nAlice,alice@x.com,1111111111,A,Dev,Python;SQL\nBob,bob@x.com,2222222222,B,Lead,Java;Leadership\n"
    r = run(spark, files(batch__csv=text))
    got = {x["entity_id"]: json.loads(x["output_json"]) for x in r.output.collect()}
    assert {k: v["full_name"] for k, v in got.items()} == {"batch.csv#row1": "Alice", "batch.csv#row2": "Bob"}
    assert [(s["name"], s["confidence"]) for s in got["batch.csv#row2"]["skills"]] == [("Java", 0.65), ("Leadership", 0.59)]
    assert "CSV contains 2 rows; batch mode enabled." in {w["message"] for w in r.warnings.collect()}


def test_bad_sources(spark, files):
    paths = files(broken__json="{", empty__csv="", head__csv="a,b\n", list__json="[1]", x__docx="?", r__pdf=b"junk") + ["/nowhere/none.csv"]
    out, errors = output(r := run(spark, paths))
    assert out["full_name"] is None and errors == ["validation: $: missing required field 'full_name'"]
    told = {s["source_id"]: s["error"] for s in r.sources.collect()}
    assert told["empty.csv"] == "CSV has no header row" and told["head.csv"] == "CSV has no data rows" and told["list.json"] == "expected a JSON object at the top level"
    assert told["broken.json"].startswith("invalid JSON") and told["x.docx"] == "unsupported file type '.docx'" and told["none.csv"] == "file not found" and told["r.pdf"].startswith("could not read PDF")


RESUME = """MIRA CASTELL ONO
Hyderabad, Telangana
t@x.org | +91 98765 43210 | linkedin.com/in/mira
Ski lls:
Languages: Python, SQL
Exp erience
Stefanini India Pvt. Ltd.
AI Intern
May 2026 - June 2026
remote
• Architected things
• Developed more
Education
Bachelor of Science, X University
"""


def pdf(text, deflate=True):
    """A PDF of one page whose lines are these, as simple as they come."""
    show = " T*\n".join("(" + x.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)") + ") Tj" if i % 2 else "[" + f"({x[:2]}) -20 ({x[2:]})" + "] TJ" for i, x in enumerate(text.split("\n")))
    body = f"BT /F1 12 Tf 14 TL 72 700 Td\n{show}\nET".encode("cp1252", "replace")
    body = zlib.compress(body) if deflate else body
    head = f"<< /Length {len(body)}{' /Filter /FlateDecode' if deflate else ''} >>".encode()
    return b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog >>\nendobj\n4 0 obj\n" + head + b"\nstream\n" + body + b"\nendstream\nendobj\n%%EOF"


@pytest.mark.parametrize("deflate", [True, False])
def test_pdf_text(deflate):
    lines = "One line\nTwo (with signs) \\ é\nThree"
    assert pdf_text(pdf(lines, deflate)) == lines
    with pytest.raises(ValueError):
        pdf_text(b"junk")
    assert pdf_text(b"%PDF-1.4\nnothing") == ""


def test_pdf_file(spark, files):
    out, errors = output(run(spark, files(resume__pdf=pdf(RESUME.replace("•", "\x95")))))
    assert errors == [] and out["full_name"] == "MIRA CASTELL ONO" and out["current_title"] == "AI Intern" and out["emails"] == ["t@x.org"]


def test_many_files_are_one_scan(spark, tmp_path):
    from tributary.sources.readers import files as listed

    paths = [str(tmp_path / f"f{i} {{a}},b[{i}].csv") for i in range(450)]
    for p in paths[::3]:
        open(p, "w").write("name\n" + p[-8:] if p != paths[3] else "")
    got = {r.source_seq: (r.source_id, r.error, r.content) for r in listed(spark, paths).collect()}
    assert len(got) == 450 and all((e is None) == (i % 3 == 0) and (c is None) == (i % 3 > 0) for i, (_, e, c) in got.items()) and bytes(got[3][2]) == b""
    plan = listed(spark, paths)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_escaped_addresses_are_found(spark, files):
    r = run(spark, files(a__json='{"name": "A B", "page": "https:\\/\\/linkedin.com\\/in\\/ab"}', b__json='{"page": "linkedin: other"}'))
    assert {(x.kind, x.url) for x in r.links.collect()} == {("linkedin", "https://linkedin.com/in/ab")}


def test_country_and_policies(spark, files):
    out, _ = output(run(spark, files(a__csv="name,phone\nA B,2025550123\n"), country="1"))
    assert out["phones"] == ["+12025550123"]
    from tributary.functions import dicts as D
    from tributary.operators import evidence as E
    from tributary.operators.profile import canonical

    rows = spark.createDataFrame([("e", "team", "x", "a"), ("e", "team", "x", "b"), ("e", "team", "y", "b")], "e string, f string, v string, s string")
    ev = E.normalized(E.evidence(rows, F.col("e"), F.col("f"), F.col("v"), F.col("s"), F.lit("structured"), F.lit("m")))
    assert canonical(ev, policies=D.POLICIES | {"team": "single"}).first()["team"]["value"] == "x"
    assert [x["value"] for x in canonical(ev, policies=D.POLICIES | {"team": "multi"}).first()["team"]] == ["x", "y"]
    with pytest.raises(ValueError):
        canonical(ev, policies=D.POLICIES | {"team": "best"})


def test_document(spark, files):
    out, errors = output(run(spark, files(resume__pdf=RESUME), extract=lambda b: b.decode()))
    assert errors == [] and out["full_name"] == "MIRA CASTELL ONO" and out["emails"] == ["t@x.org"] and out["phones"] == ["+919876543210"]
    assert out["current_company"] == "Stefanini India Pvt. Ltd." and out["current_title"] == "AI Intern"
    assert out["experience"] == [{"company": "Stefanini India Pvt. Ltd.", "title": "AI Intern", "start": None, "end": "June 2026", "summary": "remote Architected things Developed more"}]
    assert out["links"] == {"linkedin": "https://linkedin.com/in/mira"} and [e["description"] for e in out["education"]] == ["Bachelor of Science, X University"]


def test_enrichment(spark, files):
    found = spark.createDataFrame([("https://linkedin.com/in/mira", json.dumps({"headline": "Builder", "skills": ["sql", {"name": "x" * 50}], "education": [{"degree": "BSc", "school": "X", "start": "2019"}]}))], "url string, payload string")
    out, _ = output(run(spark, files(resume__pdf=RESUME), extract=lambda b: b.decode(), profiles=found))
    assert out["headline"] == "Builder" and {s["name"]: s["confidence"] for s in out["skills"]} == {"SQL": 0.75, "Python": 0.5}
    assert out["education"][0]["description"] == "Bachelor of Science, X University"


CONFIGS = [
    ({"fields": [{"path": "full_name"}, {"path": "primary_email", "from": "emails[0]"}]}, {"full_name": "Mira Castell", "primary_email": "mira@example.org"}, []),
    ({"fields": [{"path": "x"}, {"path": "emails[3]"}], "on_missing": "omit"}, {}, []),
    ({"fields": [{"path": "x"}, {"path": "headline"}]}, {"x": None, "headline": None}, []),
    ({"fields": [{"path": "headline", "required": True}]}, {"headline": None}, ["validation: $: missing required field 'headline'"]),
    ({"fields": [{"path": "headline"}], "on_missing": "omit"}, {"headline": None}, []),
    ({"fields": [{"path": "years_of_experience"}], "on_missing": "error"}, None, ["projection: field 'years_of_experience' (from 'years_of_experience') is missing"]),
    ({"fields": [{"path": "a..b"}]}, None, ["projection: invalid path segment '' in 'a..b'"]),
    ({"fields": [{"path": "s", "from": "skills[].name", "type": "string[]", "normalize": "upper"}], "include_confidence": True}, {"s": ["JAVA", "PYTHON", "REACT", "SQL"], "s_confidence": [0.65] * 4}, []),
    ({"fields": [{"path": "p", "from": "phones[0]", "normalize": "national"}, {"path": "c", "from": "overall_confidence", "type": "number"}]}, {"p": "9876543210", "c": 0.9}, []),
]


@pytest.mark.parametrize("config, want, errors", CONFIGS)
def test_projection(spark, files, config, want, errors):
    assert output(run(spark, files(recruiter__csv=RECRUITER), config)) == (want, errors)


def test_bad_config():
    assert C.config_errors({"fields": [{}], "on_missing": "explode"}) == ["config.on_missing must be one of ['error', 'null', 'omit']", "config.fields[0].path must be a non-empty string"]
    assert C.config_errors([]) == ["config must be a JSON object"]
    with pytest.raises(C.ConfigError):
        C.load(text='{"fields": 3}')


def test_validator(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "l": {"type": "array", "items": {"type": "object", "required": ["x"]}}, "n": {"type": "null"}}}
    cases = {'{"a": 1, "l": [{"x": 1}]}': [], '{"a": "s"}': ["$.a: expected integer, got str"], "{}": ["$: missing required field 'a'"], '{"a": 1, "l": [{}], "n": 2}': ["$.l[0]: missing required field 'x'", "$.n: expected null, got int"], "[]": ["$: expected object, got list"]}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(json_errors(F.col("t"), schema)).collect()] == list(cases.values())


def test_sections_keep_the_first(spark):
    docs = spark.createDataFrame([(1, "x\nSkills\na\n\nEducation\nu\nSkills\nb")], "doc_id int, text string")
    assert [(r.section, r.line) for r in S.sections(S.lines(docs)).orderBy("pos").collect()] == [("skills", "a"), ("education", "u")]
