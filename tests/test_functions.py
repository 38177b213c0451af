import datetime
import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from tributary.functions import confidence as C
from tributary.functions import links as L
from tributary.functions import text as X


def values(spark, cases, f):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v string")
    return [r["out"] for r in rows.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


CASES = {
    X.normalize_phone: {"9876543210": "+919876543210", "+91 98765 43210": "+919876543210", "09876543210": "+919876543210", "919876543210": "+919876543210", "91987654321": "+91987654321", "call me maybe": None, "": None, None: None, "+1234567": None, "+12345678": "+12345678", "12345": None},
    X.normalize_date: {"Jan 2023": "2023-01", "January 2023": "2023-01", "Present": "present", "current": "present", "sometime, idk": None, "": None, None: None, "2023-02": "2023-02", "12/2020": "2020-12", "3 Mar 2021": "2021-03", "2019": "2019-01", "Sept 2021": "2021-09", "2021-3": "2021-03", "March, 2020": "2020-03", "2020-05-01T10:00:00": "2020-05", "May 3rd, 2020": "2020-05", "Mon, 4 May 2020 10:00": "2020-05", "13/02/2020": "2020-02", "02/13/2020": "2020-02", "20200501": "2020-05", "2020 June": "2020-06", "Feb 30 2020": None, "Foo 2020": None, "14/2020": None, "2020-13": None},
    X.normalize_email: {"  Mira@Example.org ": "mira@example.org", "not-an-email": None, None: None},
    X.normalize_skill: {" REACTJS ": "React", "  some niche framework  ": "Some Niche Framework", "GraphQL": "GraphQL", "• k8s.": "Kubernetes", "-": None, None: None, "3d": "3D", "rest-api": "Rest-Api", "ETL": "ETL"},
    X.normalize_text: {"  Google   LLC ": "Google LLC", "  ": None, "a  b": "a b", None: None},
    X.key_of: {" Straße  X ": "strasse x"},
    X.header: {"Ski lls:": "skills", "Exp erience": "experience", "Hon ors & Awards": "awards", "TECHNNICAL SKILLS": "skills", "Other": None},
    X.title_case: {"o'neil 3d": "O'Neil 3D"},
    X.is_date_line: {"May 2026– June 2026": True, "2019 - Present": True, "no dates": False},
    X.is_company: {"Stefanini India Pvt. Ltd.": True, "some words here": False},
    X.is_job_title: {"AI Intern": True, "Hyderabad": False},
    X.unfenced: {'```json\n{"a":1}\n```': '{"a":1}'},
    X.initials: {"jane q public": "JQ", None: "?"},
    lambda v: X.education_label(v, F.lit("Physics")): {"BSc": "BSc in Physics", None: "Physics"},
    lambda v: X.education_label(v, F.lit(""), F.lit("told")): {"BSc": "BSc", "": "told"},
    lambda v: X.date_range(v, F.lit(None)): {"2019": "2019 — Present", None: None},
    lambda v: X.date_range(F.lit(""), v, F.lit("2001")): {"2020": "? — 2020", "": "2001"},
    X.base_name: {"a/b.csv": "b.csv", "b.csv": "b.csv"},
    X.extension: {"a.b/c.PDF": ".pdf", "none": ""},
    X.source_label: {"a/b.csv": "Structured", "x.JSON": "Semi-structured", "r.pdf": "Unstructured"},
    lambda v: X.format_hint(v, "national"): {"+919876543210": "9876543210", "+123": "123", "987": "987"},
    L.linkedin: {"linkedin.com/in/johndoe": "https://linkedin.com/in/johndoe", "linkedin.com / in / jane-doe-123": "https://linkedin.com/in/jane-doe-123", "https://linkedIn.com/miracastello": "https://linkedin.com/in/miracastello", "linkedin: joe.": "https://linkedin.com/in/joe", "linkedin.com/company": None, "linkedin: https://linkedin.com/abc": "https://linkedin.com/in/abc", "none": None},
    L.github: {"github.com/johndoe": "https://github.com/johndoe", "GitHub: @joe": "https://github.com/joe", "x": None},
    L.portfolio: {"www.johndoe.dev/portfolio": "https://www.johndoe.dev/portfolio", "https://www.facebook.com/x https://a.dev/": "https://a.dev", "https://mail.gmail.com": None},
}


@pytest.mark.parametrize("f", CASES, ids=lambda f: f.__name__)
def test_scalars(spark, f):
    assert values(spark, list(CASES[f]), f) == list(CASES[f].values())


def test_skill_parts(spark):
    assert values(spark, ["• Languages: Python, Java | C++.", "a", "tools:"], X.skill_parts) == [["Python", "Java", "C++"], [], ["tools"]]


def test_scores_are_pythons():
    assert [C.score(0.65, n) for n in range(1, 6)] == [0.65, 0.8, 0.95, 0.98, 0.98]
    assert [C.score(0.5, n, "partial") for n in range(1, 6)] == [0.42, 0.55, 0.68, 0.81, 0.83]
    assert [C.score(0.6, n, "unknown") for n in range(1, 5)] == [0.54, 0.68, 0.81, 0.88]


def test_source_rank(spark):
    ids = ["Resume.pdf", "my resume", "x_linkedin_apify", "github_apify", "a.json", "a.csv#row3", "a.txt", "other"]
    assert values(spark, ids, lambda v: C.source_rank(v, F.lit(2))) == [0, 0, 1, 2, 3, 4, 5, 12]
    assert values(spark, ["a.csv#row3"], lambda v: C.source_rank(v, F.lit(2), compat=True)) == [12]


def test_case_folding_is_pythons(spark):
    """On every code point that Python's Unicode data knows, alone, among letters and at a word's end; the JVM may know newer ones."""
    known = [c for c in map(chr, range(1, sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cn", "Cs")]
    df = spark.createDataFrame([(c,) for c in known], "c string")
    made = df.select("c", X.casefold(F.col("c")).alias("a"), X.casefold(F.concat(F.lit("A"), "c", F.lit("Sß"))).alias("b"), X.casefold(F.concat(F.lit("Σ"), "c")).alias("d")).collect()
    assert [r["c"] for r in made if (r["a"], r["b"], r["d"]) != (r["c"].casefold(), f"A{r['c']}Sß".casefold(), f"Σ{r['c']}".casefold())] == []


def test_keys(spark):
    assert values(spark, ["  Straße  ﬁn ", "STRASSE FIN", "ΟΔΟΣ", "οδος", "ŉ", "", None], X.key_of) == ["strasse fin", "strasse fin", "οδοσ", "οδοσ", "ʼn", "", None]


def test_dates_against_the_parser_of_the_box(spark):
    """Random days in random spellings; ours, by the same rules for years, against dateutil."""
    parser = pytest.importorskip("dateutil.parser")
    r, first = random.Random(7), datetime.datetime(2000, 1, 1)
    forms = ["%d %b %Y", "%b %d, %Y", "%B %Y", "%Y %B", "%m/%d/%Y", "%d/%m/%Y", "%m/%d/%y", "%y-%b-%d", "%d-%b-%y", "%Y-%m-%d", "%Y/%m/%d %H:%M", "%Y%m%d", "%y%m%d", "%Y%m%d%H%M%S", "%A, %d %B %Y at %I:%M %p",
             "%a %b %d %H:%M:%S %Y", "%d.%m.%Y", "%b-%Y-%d", "%d %Y %b", "%b %d", "%b %y", "%d", "%Y", "%m-%Y", "%m/%d", "%b", "%Y-%m-%dT%H:%M:%S+02:00", "%d%b%Y", "%B %dth, %Y", "%d of %B %Y", "%b %B %Y", "%Y %Y", "%bx %Y", "(%Y)"]
    said = []
    for _ in range(40):
        day = datetime.datetime(1980, 1, 1) + datetime.timedelta(days=r.randrange(20_000), minutes=r.randrange(1440))
        said += [day.strftime(f) for f in forms] + [f"{r.randrange(40)}{c}{r.randrange(40)}{c}{r.choice([r.randrange(100), r.randrange(1950, 2050)])}" for c in "-/ "]

    def theirs(s):
        try:
            return parser.parse(s, default=first).strftime("%Y-%m")
        except (ValueError, OverflowError):
            return None

    df = spark.createDataFrame([(s,) for s in said], "s string")
    got = {(x.s, x.m) for x in df.select("s", X.normalize_date(F.col("s"), default_year=2000).alias("m")).collect()}
    want = {(s, theirs(s)) for s in said}
    assert sorted(got - want) == sorted(want - got) == []
    assert df.where(F.col("s").rlike("^[A-Z][a-z]{2}$")).where(X.normalize_date(F.col("s")).isNotNull()).count() == 0


def test_long_texts_are_no_dates(spark):
    df = spark.createDataFrame([("1 " * 500_000,), ("jan" * 300_000,), ("-" * 1_000_000,)], "s string")
    assert [x.m for x in df.select(X.normalize_date(F.col("s")).alias("m")).collect()] == [None] * 3
