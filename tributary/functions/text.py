"""Normalizers, extractors and predicates on text. All are Column expressions: they stay in the JVM and null in gives null out."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.functions import dicts as D

#: White space as Unicode has it, not ASCII's alone; and what of it isn't a single space already.
SPACE, UNEVEN = r"(?U)\s+", r"(?U)[\s&&[^ ]]\s*| \s+"


def let(v: Column, body) -> Column:
    """body(v), with v computed once."""
    return F.get(F.transform(F.array(v), body), F.lit(0))


def or_null(v: Column) -> Column:
    """An empty string is no value."""
    return F.nullif(v, F.lit(""))


def collapse(v: Column) -> Column:
    return F.trim(F.regexp_replace(v, UNEVEN, " "))


def normalize_text(v: Column) -> Column:
    """Trimmed, white space collapsed; blank is null. Names are normalized so, too."""
    return or_null(collapse(v))


normalize_name = normalize_text


def strip(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)^\s+|\s+$", "")


def normalize_email(v: Column) -> Column:
    e = F.lower(strip(v))
    return F.when(F.contains(e, F.lit("@")), e)


def normalize_phone(v: Column, country: str = D.COUNTRY_CODE) -> Column:
    """E.164, or null: an explicit + is believed, a bare national number gets the country's code."""
    digits = F.regexp_replace(v, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(F.startswith(strip(v), F.lit("+")), F.when(n.between(8, 15), F.concat(F.lit("+"), digits)))
        .when(n == 10, F.concat(F.lit(f"+{country}"), digits))
        .when((n == 11) & F.startswith(digits, F.lit("0")), F.concat(F.lit(f"+{country}"), F.substring(digits, 2, 10)))
        .when(n.isin(11, 12) & F.startswith(digits, F.lit(country)), F.concat(F.lit("+"), digits))
    )


#: Forms of a date in lower case, with the places of year, month and day; a month by name or number. The first that fits counts.
#: What says nothing of day, month and year: times with their zones, the T before a time, ordinal endings, weekdays, words between.
NOISE = (
    r"(?<![\d.])\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:\s*[ap]\.?m\b\.?)?(?:\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2})\b)*|\b\d{1,2}\s*[ap]\.?m\b\.?|(?<=\d)t(?=\d)|(?<=\d)(?:st|nd|rd|th)\b"
    r"|\b(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\b|\b(?:at|on|of|and|ad)\b"
)
#: Digits in a row: years, months and days, and perhaps a time.
PACKED = r"^\s*(\d{4}|\d{2}(?=\d{4}\s*$))(\d{2})(\d{2})(?:[t ]?\d{4}(?:\d{2})?z?)?\s*$"
DATE_TOKENS, DATE_SHAPE = r"\d+|[a-z]+", r"^[\s,;./'-]*(?:(?:\d+|[a-z]+)[\s,;./'-]*)+$"


def normalize_date(v: Column, default_year: int | None = None, this_year: int | None = None) -> Column:
    """'yyyy-MM', or 'present'; null if it is no date.

    What says nothing of the date is taken out; up to three numbers, or two and a month's name, must be left. Which of them is the year is told by its digits or by being beyond 31, else by
    the order: month, day, year; day, month, year if the first is beyond 12 or the name is second; year first if it is known to be. A year alone is its January. Years
    of two digits are the nearest to this_year, by default the current one. A date without a year is null unless there is a default_year.
    """
    months = F.create_map(*[F.lit(x) for pair in D.MONTHS.items() for x in pair])

    def parts(tokens: Column) -> Column:
        """Of each token its value, whether it is a month's name, and whether it is a year by its digits."""
        return F.transform(tokens, lambda x: F.struct(F.coalesce(F.try_element_at(months, x), x.try_cast("int")).alias("v"), F.rlike(x, F.lit("^[a-z]")).alias("name"), F.rlike(x, F.lit(r"^\d{3,}$")).alias("long")))

    def assigned(t: Column) -> Column:
        """(y, m, d) of one to three tokens."""
        value, name = lambda i: F.get(t, i)["v"], lambda i: F.coalesce(F.get(t, i)["name"], F.lit(False))
        year = lambda i: ~name(i) & (F.get(t, i)["long"] | (value(i) > 31))
        said = lambda y, m, d: F.struct(*[(F.lit(None).cast("int") if i is None else value(i)).alias(n) for n, i in (("y", y), ("m", m), ("d", d))])
        one = F.when(name(0), said(None, 0, None)).when(year(0), said(0, None, None)).otherwise(said(None, None, 0))
        two = F.when(name(0), F.when(year(1), said(1, 0, None)).otherwise(said(None, 0, 1))).when(name(1), F.when(year(0), said(0, 1, None)).otherwise(said(None, 1, 0)))
        two = two.when(year(0), said(0, 1, None)).when(year(1), said(1, 0, None)).otherwise(said(None, 0, 1))
        three = F.when(name(0), F.when(year(1), said(1, 0, 2)).otherwise(said(2, 0, 1))).when(name(1), F.when(year(0), said(0, 1, 2)).otherwise(said(2, 1, 0)))
        three = three.when(name(2), F.when(year(1), said(1, 2, 0)).otherwise(said(0, 2, 1))).when(year(0), said(0, 1, 2)).when(value(0) > 12, said(2, 1, 0)).otherwise(said(2, 0, 1))
        return F.when(F.size(t) == 1, one).when(F.size(t) == 2, two).when(F.size(t) == 3, three)

    def whole_year(y: Column, t: Column) -> Column:
        now = F.year(F.current_date()) if this_year is None else F.lit(this_year)
        near = let(now - now % 100 + y, lambda x: F.when(x >= now + 50, x - 100).when(x < now - 50, x + 100).otherwise(x))
        return F.when(F.exists(t, lambda x: x["long"]), y).otherwise(near)

    def month(t: Column) -> Column:
        fine = (F.size(F.filter(t, lambda x: x["name"])) <= 1) & (F.size(F.filter(t, lambda x: x["long"])) <= 1) & F.forall(t, lambda x: x["v"].isNotNull())
        stamp = lambda x: F.try_make_timestamp(F.coalesce(whole_year(x["y"], t), F.lit(default_year).cast("int")), F.coalesce(x["m"], F.lit(1)), F.coalesce(x["d"], F.lit(1)), F.lit(0), F.lit(0), F.lit(0))
        return F.when(fine & (F.size(t) <= 3), F.date_format(let(assigned(t), stamp), "yyyy-MM"))

    def read(s: Column) -> Column:
        rest = F.regexp_replace(F.regexp_replace(s, PACKED, "$1-$2-$3"), NOISE, " ")
        tokens = let(rest, lambda x: F.when(F.rlike(x, F.lit(DATE_SHAPE)), F.regexp_extract_all(x, F.lit(DATE_TOKENS), 0)))
        return F.when(s.isin("present", "current", "ongoing", "now"), F.lit("present")).otherwise(let(tokens, lambda x: let(parts(x), month)))

    # No date is longer, and no shorter text is searched for one at length.
    return let(F.lower(collapse(v)), lambda s: F.when(F.length(s) <= 100, read(s)))


def title_case(v: Column) -> Column:
    """Every run of letters begins with an upper case letter and goes on in lower case, unlike initcap also after digits and marks."""
    runs = F.regexp_extract_all(v, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def _synonyms() -> Column:
    return F.create_map(*[F.lit(x) for pair in D.SYNONYMS.items() for x in pair])


def clean_skill(v: Column) -> Column:
    return or_null(F.regexp_replace(F.regexp_replace(collapse(v), D.BULLETS, ""), "[.,;:]+$", ""))


def canonical_skill(v: Column) -> Column:
    """struct(name, known): the synonym's name; else the skill as it is if it has capitals of its own, else in title case."""
    s = clean_skill(v)
    known = F.try_element_at(_synonyms(), F.lower(s))
    own = ((F.upper(s) == s) & (F.lower(s) != s)) | (F.lower(F.substr(s, F.lit(2))) != F.substr(s, F.lit(2)))
    return F.when(s.isNotNull(), F.struct(F.coalesce(known, F.when(own, s).otherwise(title_case(s))).alias("name"), known.isNotNull().alias("known")))


def normalize_skill(v: Column) -> Column:
    return canonical_skill(v)["name"]


#: Lower case letters that case folding changes nevertheless, by Python's own Unicode data: final sigma, long s, ligatures, letters with iota below, Cherokee.
#: ß isn't among them, as it is common and goes its own way.
FOLDS = {c: c.casefold() for c in map(chr, range(128, sys.maxunicode + 1)) if c != "ß" and c.casefold() != c and c.lower() == c}


def _ranges(letters) -> str:
    """A pattern's class of these letters alone."""
    out = []
    for c in sorted(map(ord, letters)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


def casefold(v: Column) -> Column:
    """Full case folding, as str.casefold has it: letters may become several. Texts without letters of FOLDS, nearly all, cost a look for these."""
    one = {c: f for c, f in FOLDS.items() if len(f) == 1}
    more = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in FOLDS.items() if len(f) > 1])
    full = lambda s: F.aggregate(more, F.translate(s, "".join(one), "".join(one.values())), lambda t, x: F.replace(t, x["c"], x["f"]))
    special = rf"[\x{{80}}-\x{{10ffff}}&&{_ranges(FOLDS)}]"
    return let(F.replace(F.lower(v), F.lit("ß"), F.lit("ss")), lambda s: F.when(F.rlike(s, F.lit(special)), full(s)).otherwise(s))


def key_of(v: Column) -> Column:
    """What values are compared by: white space collapsed, case folded."""
    return casefold(collapse(v))


#: Of each field that isn't plain text; more can be added.
NORMALIZERS = {"emails": normalize_email, "phones": normalize_phone, "skills": normalize_skill, "experience_start_date": normalize_date, "experience_end_date": normalize_date}


def normalizers(country: str = D.COUNTRY_CODE) -> dict:
    """NORMALIZERS where national phone numbers are of another country, by its calling code."""
    return NORMALIZERS | {"phones": lambda v: normalize_phone(v, country)}


def normalize(field: Column, value: Column, normalizers: dict = NORMALIZERS) -> Column:
    """The value by its field's normalizer, plain text by default."""
    out = None
    for name, f in normalizers.items():
        out = F.when(field == name, f(value)) if out is None else out.when(field == name, f(value))
    return normalize_text(value) if out is None else out.otherwise(normalize_text(value))


def format_hint(v: Column, hint: str | None) -> Column:
    """What a projection may ask for: 'national', 'upper', 'lower', 'title'; others change nothing."""
    if hint == "national":
        return F.when(F.startswith(v, F.lit("+")), F.right(F.substr(v, F.lit(2)), F.lit(10))).otherwise(v)
    return {"upper": F.upper, "lower": F.lower, "title": title_case}.get(hint, lambda x: x)(v)


def first_email(text: Column) -> Column:
    return or_null(F.regexp_extract(text, D.EMAIL, 0))


def first_phone(text: Column) -> Column:
    return or_null(F.regexp_extract(text, D.PHONE, 0))


def any_hint(v: Column, hints: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(v, h))


def header(line: Column) -> Column:
    """The section that a line heads, or null. White space within it doesn't count, nor do colons behind it."""
    squeeze = lambda s: s.replace(" ", "")
    names = {squeeze(alias): section for section, aliases in D.SECTION_ALIASES.items() for alias in aliases}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, F.regexp_replace(F.regexp_replace(F.lower(line), SPACE, ""), ":+$", ""))


def is_date_line(line: Column) -> Column:
    return F.rlike(line, F.lit(D.DATE_LINE))


def without_bullets(line: Column) -> Column:
    return strip(F.regexp_replace(line, D.BULLETS, ""))


def is_job_title(line: Column) -> Column:
    s = without_bullets(line)
    return (s != "") & ~is_date_line(s) & header(s).isNull() & any_hint(F.lower(s), D.JOB_TITLE_HINTS)


def is_company(line: Column) -> Column:
    s = without_bullets(line)
    words = F.split(s, SPACE)
    capital = F.size(F.filter(words, lambda w: F.rlike(w, F.lit(r"^\p{Lu}"))))
    return (s != "") & ~is_date_line(s) & header(s).isNull() & (any_hint(F.lower(s), D.COMPANY_HINTS) | ((F.size(words) >= 2) & (capital >= F.greatest(F.lit(2), F.size(words) - 1))))


def is_title_case(s: Column) -> Column:
    return s == title_case(s)


def is_name_line(line: Column) -> Column:
    s = collapse(line)
    low, words = F.lower(s), F.split(s, " ")
    letters = F.regexp_count(s, F.lit(r"\p{L}"))
    upper = F.regexp_count(s, F.lit(r"\p{Lu}"))
    fine = (F.length(s) >= 3) & header(s).isNull() & ~low.isin("resume", "cv", "curriculum vitae") & ~F.contains(s, F.lit("@")) & ~F.rlike(s, F.lit(r"\d")) & ~F.rlike(s, F.lit(r"(?i)https?://|www\."))
    fine = fine & ~any_hint(low, D.NAME_BLACKLIST) & ~(F.contains(s, F.lit(",")) & any_hint(low, D.LOCATION_HINTS))
    fine = fine & F.size(words).between(2, 5) & F.forall(words, lambda w: F.rlike(w, F.lit("[A-Za-z]")))
    return F.coalesce(fine & ((upper / letters >= 0.6) | is_title_case(s)), F.lit(False))


def name_score(line: Column, at: Column, base: Column) -> Column:
    """How much a name line looks like a person's name; at: its place from 0; base: what the first place is worth."""
    s = strip(line)
    one = lambda cond, n: F.when(cond, F.lit(n)).otherwise(F.lit(0))
    return one(s == F.upper(s), 1) + one(F.size(F.split(s, SPACE)).isin(2, 3), 2) + one(at <= 3, 1) + one(~any_hint(F.lower(s), D.LOCATION_HINTS), 2) + one(is_title_case(s), 3) + F.greatest(base - at, F.lit(0))


def is_education(line: Column) -> Column:
    return any_hint(F.lower(line), D.EDUCATION_WORDS)


def skill_parts(line: Column) -> Column:
    """The skills of a line of a skills section: a label before a colon goes, bullets, bars and hyphens separate."""
    s = F.regexp_replace(without_bullets(line), "[.,;:]+$", "")
    after = strip(F.regexp_replace(s, r"^[^:]*:", ""))
    parts = F.split(F.when(after != "", after).otherwise(s), r"[,|•·\-*]")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(without_bullets(p), "[.,;:]+$", "")), lambda p: F.length(p) > 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def source_label(path: Column) -> Column:
    """How the viewer names a kind of source."""
    return F.when(extension(path) == ".csv", "Structured").when(extension(path) == ".json", "Semi-structured").otherwise("Unstructured")


def bucket(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "green").when(confidence >= 0.5, "amber").otherwise("red")


def initials(name: Column) -> Column:
    """Of the first two words; a question mark where there is no name."""
    return F.coalesce(F.upper(F.substring(F.array_join(F.transform(F.split(or_null(name), " "), lambda w: F.substring(w, 1, 1)), ""), 1, 2)), F.lit("?"))


def education_label(degree: Column, field: Column, description: Column | None = None) -> Column:
    """'degree in field', or what there is of it, else the description."""
    d, f = or_null(degree), or_null(field)
    return F.coalesce(F.concat(d, F.lit(" in "), f), f, d, *([or_null(description)] if description is not None else []))


def date_range(start: Column, end: Column, year: Column | None = None) -> Column:
    """'start — end', open ends as ? and Present; else the year."""
    a, b = or_null(start), or_null(end)
    both = F.concat(F.coalesce(a, F.lit("?")), F.lit(" — "), F.coalesce(b, F.lit("Present")))
    return F.when(a.isNotNull() | b.isNotNull(), both).otherwise(or_null(year) if year is not None else F.lit(None))


def years(v: Column) -> Column:
    return v.try_cast("double")


def unfenced(text: Column) -> Column:
    """JSON text of a model's answer, without the code fence around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
