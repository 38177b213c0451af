"""A query for each operator over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import confidence as C
from tributary.functions import dicts as D
from tributary.functions import links as L
from tributary.functions import text as X
from tributary.operators import evidence as E
from tributary.operators import merge as M
from tributary.operators import profile, provenance, sections
from tributary.operators.enrich import enrich, parse_education
from tributary.operators.policies import latest, merge_by, weighted_plurality
from tributary.plans import compare, config
from tributary.plans.engine import discover, link_evidence, resolve, run
from tributary.plans.insights import with_insights
from tributary.plans.projection import outputs, project, project_default
from tributary.plans.validate import has_keys, json_errors
from tributary.session import dealt, new_folder, once_each
from tributary.sources.csv_splits import csv_facts_of
from tributary.sources.datasource import register
from tributary.sources.readers import alias_column, facts, files, header_key_column, json_column, wide_table
from tributary.sources.writers import envelope, read_run, write_run

QUERIES, SQL = {}, {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def flat(items: Column, *fields: str) -> Column:
    """A list of structs as text, for results that hash alike anywhere."""
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ";")


#: Base weight, rows of evidence, and what they are worth agreed on, as a part of what was said, and of an unknown name: min(0.98, base + 0.15 (n - 1)), times 0.85 and 0.9, each
#: rounded to two digits by hand, halves as their binary values fall.
SCORES = """
0.50 1 0.50 0.42 0.45
0.50 2 0.65 0.55 0.59
0.50 3 0.80 0.68 0.72
0.50 4 0.95 0.81 0.85
0.50 5 0.98 0.83 0.88
0.60 1 0.60 0.51 0.54
0.60 2 0.75 0.64 0.68
0.60 3 0.90 0.77 0.81
0.60 4 0.98 0.83 0.88
0.60 5 0.98 0.83 0.88
0.65 1 0.65 0.55 0.59
0.65 2 0.80 0.68 0.72
0.65 3 0.95 0.81 0.85
0.65 4 0.98 0.83 0.88
0.65 5 0.98 0.83 0.88
"""


def scores_sql() -> str:
    rows = ["({}::DOUBLE, {}, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE)".format(*x.split()) for x in SCORES.strip().splitlines()]
    return f"scores(base, k, agreed, part, unknown) AS (VALUES {', '.join(rows)})"


WEIGHT_SQL = "CASE {} WHEN 'structured' THEN 0.65::DOUBLE WHEN 'semistructured' THEN 0.60::DOUBLE ELSE 0.50::DOUBLE END"


# -- evidence ------------------------------------------------------------------------------------


def order_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as statements about their customer's priority; the status tells the kind of source."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "structured").when(F.col("o_orderstatus") == "O", "semistructured").otherwise("unstructured")
    return E.normalized(E.evidence(o, F.col("o_custkey"), F.lit("current_title"), F.col("o_orderpriority"), F.concat(F.lit("orders#"), "o_orderkey"), kind, F.lit("column:o_orderpriority"), ev_seq=F.col("o_orderkey")))


ORDERS_SQL = f"""ev AS (SELECT o_custkey::VARCHAR AS entity_id, o_orderpriority AS value, lower(o_orderpriority) AS key, o_orderkey AS seq, 'orders#' || o_orderkey AS source,
  {WEIGHT_SQL.format("CASE o_orderstatus WHEN 'F' THEN 'structured' WHEN 'O' THEN 'semistructured' ELSE 'unstructured' END")} AS w FROM orders),
g AS (SELECT entity_id, key, count(*) AS n, max(w) AS w, min(seq) AS first, arg_min(value, seq) AS value FROM ev GROUP BY ALL),
r AS (SELECT *, row_number() OVER o AS k, lead(n) OVER o AS second, count(*) OVER (PARTITION BY entity_id) AS groups FROM g WINDOW o AS (PARTITION BY entity_id ORDER BY n DESC, first)),
{scores_sql()},
m AS (SELECT entity_id, groups, n, key, CASE WHEN groups = 1 OR n > second THEN value END AS value,
  CASE WHEN groups = 1 THEN agreed WHEN n > second THEN part ELSE 0 END::DOUBLE AS confidence FROM r JOIN scores ON base = w AND scores.k = least(n, {C.MOST}) WHERE r.k = 1)"""


@query(f"WITH {ORDERS_SQL} SELECT entity_id, value, confidence, groups > 1 AS conflict, groups::BIGINT AS n_values FROM m")
def merge_single_plurality(spark, sf_dir):
    out = M.single_counts(order_evidence(spark, sf_dir))
    return out.select("entity_id", "value", "confidence", "conflict", F.col("n_values").cast("long").alias("n_values"))


@query(f"""WITH {ORDERS_SQL}, won AS (SELECT entity_id, CASE WHEN value IS NULL THEN '' ELSE key END AS key FROM m WHERE groups > 1)
SELECT g.entity_id, string_agg(g.key || '=' || g.n, ';' ORDER BY g.key) AS others FROM g JOIN won ON g.entity_id = won.entity_id AND g.key <> won.key GROUP BY g.entity_id""")
def merge_single_conflicts(spark, sf_dir):
    others = provenance.conflict_counts(order_evidence(spark, sf_dir))
    return others.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("key", F.lit("="), F.col("n").cast("string")))), ";").alias("others"))


@query(f"""WITH {ORDERS_SQL}, s AS (SELECT ev.entity_id, string_agg(ev.source, ',' ORDER BY seq) AS sources, count(*) AS n FROM ev JOIN m ON ev.entity_id = m.entity_id AND (m.value IS NULL OR ev.key = m.key) GROUP BY ALL)
SELECT entity_id, sources, n::BIGINT AS n_methods FROM s""")
def merge_single_sources(spark, sf_dir):
    out = M.merge_single(order_evidence(spark, sf_dir))
    return out.select("entity_id", F.array_join("sources", ",").alias("sources"), F.size("methods").cast("long").alias("n_methods"))


@query(f"WITH {ORDERS_SQL} SELECT confidence, CASE WHEN confidence >= 0.8 THEN 'green' WHEN confidence >= 0.5 THEN 'amber' ELSE 'red' END AS bucket, count(*)::BIGINT AS n FROM m GROUP BY ALL")
def merge_single_confidence(spark, sf_dir):
    return M.single_counts(order_evidence(spark, sf_dir)).groupBy("confidence", X.bucket(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents WHERE regexp_matches(text, '[^\\x20\\x09-\\x0D]')), {scores_sql()}
SELECT doc_id::VARCHAR AS entity_id, CASE WHEN doc_id % 3 = 0 THEN t WHEN doc_id % 3 = 1 THEN 'Dr ' || t || ' zz' END AS value, CASE doc_id % 3 WHEN 0 THEN agreed WHEN 1 THEN part ELSE 0 END::DOUBLE AS confidence, doc_id % 3 > 0 AS conflict
FROM w JOIN scores ON base = 0.65::DOUBLE AND k = 2""")
def name_containment(spark, sf_dir):
    """Whole texts as names: said twice, within a fuller one, and beside one that ends otherwise."""
    d = table(spark, sf_dir, "documents").where(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))
    k = F.col("doc_id") % 3
    names = F.when(k == 0, F.array("text", "text")).when(k == 1, F.array("text", F.concat(F.lit("Dr "), "text", F.lit(" zz")))).otherwise(F.array(F.concat("text", F.lit(" yy")), F.concat("text", F.lit(" zz"))))
    rows = d.select("doc_id", F.posexplode(names).alias("n", "name"))
    kind = F.when(F.col("n") == 0, "structured").otherwise("semistructured")
    ev = E.normalized(E.evidence(rows, F.col("doc_id"), F.lit("full_name"), F.col("name"), F.concat(F.lit("names#"), F.col("n")), kind, F.lit("words"), ev_seq=F.col("n")))
    return M.single_counts(ev).select("entity_id", "value", "confidence", "conflict")


def event_evidence(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "structured").when(F.col("event_id") % 3 == 1, "semistructured").otherwise("unstructured")
    ids = F.concat(F.lit("log"), (F.col("event_id") % 2).cast("string"), F.when(F.col("event_id") % 2 == 0, ".csv").otherwise(".json"))
    return E.normalized(E.evidence(e, F.col("user_id"), F.lit("tags"), F.col("event_type"), ids, kind, F.lit("column:event_type"), ev_seq=F.col("event_id")))


EVENTS_SQL = f"""ev AS (SELECT user_id::VARCHAR AS entity_id, event_type AS value, event_id, CASE event_id % 2 WHEN 0 THEN 4 ELSE 3 END AS rank, {WEIGHT_SQL.format("CASE event_id % 3 WHEN 0 THEN 'structured' WHEN 1 THEN 'semistructured' END")} AS w FROM events),
{scores_sql()},
v AS (SELECT entity_id, value, count(*) AS n, max(w) AS w, min(rank) AS rank FROM ev GROUP BY ALL),
s AS (SELECT entity_id, value, agreed AS confidence, rank, n FROM v JOIN scores ON base = w AND k = least(n, {C.MOST}))"""


@query(f"WITH {EVENTS_SQL} SELECT entity_id, value, confidence, rank::INTEGER AS rank, n::BIGINT AS n FROM s")
def multi_value_union(spark, sf_dir):
    return M.multi_values(event_evidence(spark, sf_dir)).select("entity_id", "value", "confidence", "rank", "n")


@query(f"WITH {EVENTS_SQL} SELECT entity_id, string_agg(value || ':' || confidence, ';' ORDER BY confidence DESC, rank, value) AS items FROM s GROUP BY entity_id")
def multi_value_rank(spark, sf_dir):
    return M.merge_multi(event_evidence(spark, sf_dir)).select("entity_id", flat(F.col("items"), "value", "confidence").alias("items"))


def skill_evidence(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    said = F.when(F.col("p_size") % 4 == 0, "  REACTJS ").when(F.col("p_size") % 4 == 1, "py.").when(F.col("p_size") % 4 == 2, F.col("p_name")).otherwise(F.col("p_type"))
    kind = F.when(F.col("p_partkey") % 2 == 0, "semistructured").otherwise("unstructured")
    return E.normalized(E.evidence(p, F.col("p_brand"), F.lit("skills"), said, F.concat(F.lit("parts#"), F.col("p_partkey") % 5), kind, F.lit("column"), ev_seq=F.col("p_partkey")))


SKILLS_SQL = f"""ev AS (SELECT p_brand AS entity_id, p_partkey % 5 AS src, CASE p_size % 4 WHEN 0 THEN 'React' WHEN 1 THEN 'Python' WHEN 2 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE p_type END AS name,
  p_size % 4 < 2 AS known, CASE WHEN p_partkey % 2 = 0 THEN 0.60::DOUBLE ELSE 0.50::DOUBLE END AS w FROM part),
{scores_sql()},
v AS (SELECT entity_id, name, count(*) AS n, max(w) AS w, bool_or(known) AS known, string_agg(DISTINCT 'parts#' || src, ',' ORDER BY 'parts#' || src) AS sources FROM ev GROUP BY ALL),
s AS (SELECT entity_id, name, CASE WHEN known THEN agreed ELSE unknown END AS confidence, sources, n FROM v JOIN scores ON base = w AND k = least(n, {C.MOST}))"""


@query(f"WITH {SKILLS_SQL} SELECT entity_id, name, confidence, sources, n::BIGINT AS n FROM s")
def skills_merge(spark, sf_dir):
    return M.skill_values(skill_evidence(spark, sf_dir)).select("entity_id", "name", "confidence", F.array_join("sources", ",").alias("sources"), "n")


@query(f"WITH {SKILLS_SQL} SELECT entity_id, string_agg(name || ':' || confidence, ';' ORDER BY confidence DESC, name) AS items FROM s GROUP BY entity_id")
def skills_rank(spark, sf_dir):
    return M.merge_skills(skill_evidence(spark, sf_dir)).select("entity_id", flat(F.col("items"), "name", "confidence").alias("items"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, CASE o_orderkey % 3 WHEN 0 THEN 'c.csv' WHEN 1 THEN 'b.json' ELSE 'a.pdf' END AS source, CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 0 END AS rank FROM orders),
s AS (SELECT o_custkey, source, rank, arg_max(o_orderkey, o_orderkey) AS last FROM r GROUP BY ALL)
SELECT o_custkey::VARCHAR AS entity_id, arg_min(last, rank)::VARCHAR AS payload FROM s GROUP BY o_custkey""")
def first_source_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    source = F.when(F.col("o_orderkey") % 3 == 0, "c.csv").when(F.col("o_orderkey") % 3 == 1, "b.json").otherwise("a.pdf")
    ev = E.evidence(o, F.col("o_custkey"), F.lit("experience"), F.lit(None), source, F.lit("structured"), F.lit("row"), ev_seq=F.col("o_orderkey"), value_json=F.col("o_orderkey"))
    return M.first_source(ev).select("entity_id", "payload")


HOST = r"^https?://([^/?#]+)"


@query(rf"""WITH p AS (SELECT regexp_extract(url, '{HOST}', 1) AS entity_id, page_id, url, CASE page_id % 2 WHEN 0 THEN 3 ELSE 4 END AS rank, ['home', 'blog', 'shop'][(page_id % 3 + 1)::BIGINT] AS kind FROM pages),
b AS (SELECT entity_id, kind, arg_min(url, (rank, -page_id)) AS url FROM p GROUP BY ALL)
SELECT entity_id, string_agg(kind || '=' || url, ';' ORDER BY kind) AS links FROM b GROUP BY entity_id""")
def links_priority(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    kind = F.get(F.array(*map(F.lit, ("home", "blog", "shop"))), (F.col("page_id") % 3).cast("int"))
    source = F.when(F.col("page_id") % 2 == 0, "b.json").otherwise("c.csv")
    ev = E.evidence(p, F.regexp_extract("url", HOST, 1), F.lit("links"), F.lit(None), source, F.lit("structured"), F.lit("column"), ev_seq=F.col("page_id"), value_map=F.create_map(kind, F.col("url")))
    return M.merge_links(ev).select("entity_id", F.array_join(F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("links"))


@query("""WITH b AS (SELECT user_id, event_type, arg_min(props, event_id) AS v FROM events GROUP BY ALL)
SELECT user_id::VARCHAR AS entity_id, string_agg(event_type || '=' || v, ';' ORDER BY event_type) AS attributes FROM b GROUP BY user_id""")
def extra_attrs_first(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ev = E.evidence(e, F.col("user_id"), F.lit("extra_attributes"), F.lit(None), F.lit("log.csv"), F.lit("structured"), F.lit("column"), ev_seq=F.col("event_id"), value_map=F.create_map("event_type", "props"))
    return M.merge_attributes(ev).select("entity_id", F.array_join(F.transform(F.map_entries("entries"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("attributes"))


@query("""SELECT c_custkey, 'cand_' || substr(sha1(CASE c_custkey % 3 WHEN 0 THEN 'email:' || lower(c_name) || '@x.com' WHEN 1 THEN 'phone:+91' || lpad(c_custkey::VARCHAR, 10, '9') ELSE 'name:' || lower(c_name) END), 1, 10) AS candidate_id FROM customer""")
def candidate_id(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 3
    email = F.when(k == 0, F.concat(F.lower("c_name"), F.lit("@x.com")))
    phone = F.when(k == 1, X.normalize_phone(F.lpad(F.col("c_custkey").cast("string"), 10, "9")))
    return c.select("c_custkey", C.entity_hash(email, phone, F.col("c_name")).alias("candidate_id"))


@query(f"""WITH {ORDERS_SQL} SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0.1 WHEN m.value IS NULL THEN 0.3 WHEN c_custkey % 2 = 0 THEN 0.9 ELSE 0.6 END::DOUBLE AS tier FROM customer LEFT JOIN m ON entity_id = c_custkey::VARCHAR""")
def overall_tier(spark, sf_dir):
    m = M.single_counts(order_evidence(spark, sf_dir)).select("entity_id", "value")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("name"))
    return c.join(m, F.col("c_custkey").cast("string") == F.col("entity_id"), "left").select("c_custkey", C.tier(F.col("name"), F.col("value"), F.col("c_custkey") % 2 == 0).alias("tier"))


@query("""WITH s AS (SELECT doc_id, source || CASE doc_id % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.json' WHEN 2 THEN '.csv#row' || doc_id WHEN 3 THEN '.txt' WHEN 4 THEN '_resume' WHEN 5 THEN '_linkedin_apify' ELSE '' END AS id FROM documents)
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 0 WHEN 5 THEN 1 ELSE doc_id + 10 END::BIGINT AS rank, id, regexp_extract(id, '(\\.[^./]*)$', 1) AS ext FROM s""")
def source_rank(spark, sf_dir):
    ends = (".pdf", ".json", None, ".txt", "_resume", "_linkedin_apify", "")
    end = F.lit("")
    for i, e in enumerate(ends):
        end = F.when(F.col("doc_id") % 7 == i, F.concat(F.lit(".csv#row"), F.col("doc_id").cast("string")) if e is None else F.lit(e)).otherwise(end)
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", end).alias("id"))
    return d.select("doc_id", C.source_rank(F.col("id"), F.col("doc_id")).cast("long").alias("rank"), "id", X.extension(F.col("id")).alias("ext"))


# -- scalar functions ----------------------------------------------------------------------------


@query(r"SELECT doc_id, nullif(trim(regexp_replace('  ' || text || chr(9), '\s+', ' ', 'g')), '') AS value FROM documents")
def norm_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_text(F.concat(F.lit("  "), "text", F.lit("\t"))).alias("value"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) || '@x.com' END AS email FROM customer")
def norm_email(spark, sf_dir):
    raw = F.concat(F.lit("  "), "c_name", F.when(F.col("c_custkey") % 2 == 0, "@X.com ").otherwise(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", X.normalize_email(raw).alias("email"))


@query("""WITH r AS (SELECT c_custkey, lpad(c_custkey::VARCHAR, 7 + (c_custkey % 7)::INTEGER, CASE c_custkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '91' ELSE '5' END) AS d, c_custkey % 4 = 0 AS plus FROM customer)
SELECT c_custkey, CASE WHEN plus THEN CASE WHEN len(d) BETWEEN 8 AND 15 THEN '+' || d END WHEN len(d) = 10 THEN '+91' || d WHEN len(d) = 11 AND d[1] = '0' THEN '+91' || d[2:] WHEN len(d) IN (11, 12) AND d[1:2] = '91' THEN '+' || d END AS phone FROM r""")
def norm_phone(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.normalize_phone(_digits()).alias("phone"))


def _digits() -> Column:
    k = F.col("c_custkey")
    pads = [F.rpad(F.lit(p), 20, p) for p in ("0", "91", "5")]
    n = (F.lit(7) + k % 7).cast("int")
    s = k.cast("string")
    pad = F.when(k % 3 == 0, pads[0]).when(k % 3 == 1, pads[1]).otherwise(pads[2])
    d = F.when(F.length(s) >= n, F.substr(s, F.lit(1), n)).otherwise(F.concat(F.substr(pad, F.lit(1), n - F.length(s)), s))
    return F.concat(F.when(k % 4 == 0, "+").otherwise(""), F.substr(d, F.lit(1), F.lit(4)), F.lit(" "), F.substr(d, F.lit(5)))


@query(r"""WITH p AS (SELECT doc_id, regexp_extract(text, '\+?\d[\d \-]{7,}\d') AS raw FROM documents), d AS (SELECT doc_id, raw, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM p WHERE raw <> '')
SELECT doc_id::VARCHAR AS entity_id, 'phones' AS field, raw AS raw_value, 'failed normalization' AS reason FROM d
WHERE NOT (CASE WHEN raw[1] = '+' THEN len(d) BETWEEN 8 AND 15 ELSE len(d) = 10 OR (len(d) = 11 AND d[1] = '0') OR (len(d) IN (11, 12) AND d[1:2] = '91') END)""")
def phone_reject(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("raw", X.first_phone(F.col("text"))).where("raw is not null")
    ev = E.normalized(E.evidence(d, F.col("doc_id"), F.lit("phones"), F.col("raw"), F.lit("documents"), F.lit("unstructured"), F.lit("regex:phone")))
    return E.rejected(ev).select("entity_id", "field", "raw_value", "reason")


@query(r"SELECT doc_id, nullif(regexp_extract(text, '[\w.+-]+@[\w-]+\.[\w.-]+'), '') AS email, nullif(regexp_extract(text, '\+?\d[\d \-]{7,}\d'), '') AS phone FROM documents")
def contact_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.first_email(F.col("text")).alias("email"), X.first_phone(F.col("text")).alias("phone"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'present' WHEN o_orderkey % 7 = 1 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS month FROM orders")
def norm_date(spark, sf_dir):
    k = F.col("o_orderkey") % 7
    said = F.when(k == 0, " Present").when(k == 1, "sometime, idk").when(k == 2, F.date_format("o_orderdate", "MMM yyyy")).when(k == 3, F.upper(F.date_format("o_orderdate", "MMMM yyyy"))).when(k == 4, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 5, F.date_format("o_orderdate", "MM/yyyy")).otherwise(F.date_format("o_orderdate", "d MMM yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.normalize_date(said).alias("month"))


#: A day in the patterns of date_format, so that the month can be told; each is said in a way of its own.
SPELLINGS = (
    "yyyy-MM-dd", "yyyy/M/d", "yyyy.MM.dd", "yyyyMMdd", "yyyyMMdd'T'HHmmss", "M/d/yyyy", "MM-dd-yyyy", "M.d.yyyy", "MMM yyyy", "MMMM, yyyy", "MM/yyyy", "d MMM yyyy", "d-MMM-yyyy", "dMMMyyyy", "MMMM d, yyyy",
    "EEEE, d MMMM yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy MMM d", "MMM-yyyy-d", "EEE MMM d HH:mm:ss yyyy", "d 'of' MMMM yyyy 'at' h:mm a", "M/d/yy",
)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS months FROM orders")
def date_spellings(spark, sf_dir):
    """Each order's date in all spellings; those of two digits a year are read from 1996."""
    said = F.array(*[F.date_format(F.col("o_orderdate").cast("timestamp"), p) for p in SPELLINGS])
    read = F.transform(said, lambda x: F.coalesce(X.normalize_date(x, this_year=1996), F.concat(F.lit("not read: "), x)))
    return once_each(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", F.array_join(F.array_sort(F.array_distinct(read)), ";").alias("months")).select("o_orderkey", "months")


SKILL_CASES = {"•  reactjs;": ("React", True), " K8S ": ("Kubernetes", True), "some niche  framework": ("Some Niche Framework", False), "GraphQL": ("GraphQL", False), "3d-rest api's": ("3D-Rest Api'S", False), " - ": (None, None), "ETL": ("ETL", False)}


@query("WITH c(i, name, known) AS (VALUES " + ", ".join(f"({i}, {'NULL' if n is None else chr(39) + n.replace(chr(39), chr(39) * 2) + chr(39)}, {'NULL' if k is None else k})" for i, (n, k) in enumerate(SKILL_CASES.values())) + f") SELECT p_partkey, name, coalesce(known, false) AS known FROM part JOIN c ON i = p_partkey % {len(SKILL_CASES)}")
def norm_skill(spark, sf_dir):
    said = F.get(F.array(*map(F.lit, SKILL_CASES)), (F.col("p_partkey") % len(SKILL_CASES)).cast("int"))
    return table(spark, sf_dir, "part").withColumn("s", X.canonical_skill(said)).select("p_partkey", F.col("s.name").alias("name"), F.coalesce("s.known", F.lit(False)).alias("known"))


@query("""WITH f AS (SELECT page_id, list_filter(regexp_extract_all(url || ' ' || url, '(?i)((?:https?://|www\\.)[\\w\\-]+\\.[\\w\\-]+(?:\\.[\\w\\-]+)*(?:/[\\w\\-./]*)?)', 1), lambda u: NOT regexp_matches(lower(u), '^(?:https?://|www\\.)(?:www\\.)?(?:linkedin|github|google|facebook|twitter|instagram|youtube)\\.com')) AS u FROM pages)
SELECT page_id, regexp_replace(u[1], '/+$', '') AS portfolio, CASE WHEN page_id % 2 = 0 THEN 'https://linkedin.com/in/p' || page_id END AS linkedin, CASE WHEN page_id % 3 = 0 THEN 'https://github.com/p' || page_id END AS github FROM f""")
def discovered_links(spark, sf_dir):
    k = F.col("page_id")
    name = F.concat(F.lit("p"), k.cast("string"), F.lit("."))
    denied = F.when(k % 5 == 0, "http://mail.gmail.com/a https://www.twitter.com/b, www.youtube.com/c ").otherwise("")
    text = F.concat(denied, F.when(k % 4 == 0, F.concat(F.lit("see LinkedIn.com / in / "), name)).when(k % 4 == 2, F.concat(F.lit("linkedin: "), name)).otherwise(""), F.lit("\n"), F.when(k % 6 == 0, F.concat(F.lit("www.github.com/"), name)).when(k % 6 == 3, F.concat(F.lit("GitHub: @"), name)).otherwise(""), F.lit("\n"), "url", F.lit(" "), "url")
    m = L.all_links(F.col("t"))
    return table(spark, sf_dir, "pages").select("page_id", text.alias("t")).select("page_id", *[F.try_element_at(m, F.lit(n)).alias(n) for n in ("portfolio", "linkedin", "github")])


HINTS = ("E164", "national", "upper", "lower", "title")


@query("""SELECT c_custkey, '+91' || lpad(c_custkey::VARCHAR, 10, '9') AS "E164", lpad(c_custkey::VARCHAR, 10, '9') AS national, upper(c_mktsegment) AS "upper", lower(c_mktsegment) AS "lower", upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS title FROM customer""")
def format_hints(spark, sf_dir):
    phone = X.normalize_phone(F.lpad(F.col("c_custkey").cast("string"), 10, "9"))
    return table(spark, sf_dir, "customer").select("c_custkey", *[X.format_hint(phone if h in ("E164", "national") else F.col("c_mktsegment"), h).alias(h) for h in HINTS])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || ' in ' || o_orderstatus ELSE o_orderstatus END AS label, strftime(o_orderdate, '%Y') || ' — ' || CASE WHEN o_orderkey % 3 = 0 THEN 'Present' ELSE o_orderstatus END AS dates,
upper(o_orderpriority[1]) || CASE WHEN o_orderpriority LIKE '% %' THEN upper(split_part(o_orderpriority, ' ', 2)[1]) ELSE '' END AS initials, CASE o_orderkey % 3 WHEN 0 THEN 'Structured' WHEN 1 THEN 'Semi-structured' ELSE 'Unstructured' END AS kind FROM orders""")
def display_texts(spark, sf_dir):
    k = F.col("o_orderkey")
    file = F.when(k % 3 == 0, "a/x.csv").when(k % 3 == 1, "x.JSON").otherwise("x.txt")
    label = X.education_label(F.when(k % 2 == 0, F.col("o_orderpriority")), F.col("o_orderstatus"))
    dates = X.date_range(F.date_format("o_orderdate", "yyyy"), F.when(k % 3 != 0, F.col("o_orderstatus")))
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"), dates.alias("dates"), X.initials(F.col("o_orderpriority")).alias("initials"), X.source_label(file).alias("kind"))


@query(f"WITH {scores_sql()} SELECT base, k AS n, agreed, part AS partial, unknown FROM scores, (SELECT count(*) AS c FROM region) WHERE c > 0")
def confidence_table(spark, sf_dir):
    k = table(spark, sf_dir, "region").agg(F.count("*").alias("c")).where("c > 0").select(F.explode(F.sequence(F.lit(1), F.lit(C.MOST))).alias("n"))
    k = k.withColumn("base", F.explode(F.array(*map(F.lit, sorted(D.BASE_WEIGHTS.values())))))
    return k.select("base", "n", *[C.confidence(F.col("base"), F.col("n"), kind).alias(name) for kind, name in (("agreement", "agreed"), ("partial", "partial"), ("unknown", "unknown"))])


# -- sources, unpivots, sets ---------------------------------------------------------------------


@query("""SELECT n_nationkey::VARCHAR AS entity_id, field, value FROM (SELECT n_nationkey, unnest(['extra_attributes', 'full_name', 'extra_attributes', 'skills', 'skills']) AS field, unnest(['n_nationkey=' || n_nationkey, n_name, 'n_regionkey=' || n_regionkey, 'a' || n_nationkey, 'b']) AS value FROM nation)""")
def csv_unpivot(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("Tech Stack", F.concat(F.lit("a"), F.col("n_nationkey").cast("string"), F.lit(" ; b |"))).withColumn("Candidate-Name", F.concat(F.lit(" "), "n_name")).drop("n_name").withColumn("blank", F.lit(" "))
    ev = wide_table(n, F.col("n_nationkey"), F.lit("nation.csv"))
    first = F.get(F.map_entries("value_map"), 0)
    return ev.select("entity_id", F.col("field_name").alias("field"), F.coalesce("raw_value", F.concat(first["key"], F.lit("="), first["value"])).alias("value"))


@query("""WITH h(i, h, field) AS (VALUES (0, ' E-mail Address', 'emails'), (1, 'Phone_Number', 'phones'), (2, 'Job Title', 'current_title'), (3, 'Pay Rate', NULL), (4, 'TECHNNICAL skills', 'skills'))
SELECT s_suppkey, regexp_replace(lower(h), '[^a-z0-9]', '', 'g') AS key, field FROM supplier JOIN h ON i = s_suppkey % 5""")
def header_alias(spark, sf_dir):
    h = F.get(F.array(*map(F.lit, (" E-mail Address", "Phone_Number", "Job Title", "Pay Rate", "TECHNNICAL skills"))), (F.col("s_suppkey") % 5).cast("int"))
    key = header_key_column(h)
    return table(spark, sf_dir, "supplier").select("s_suppkey", key.alias("key"), alias_column(key).alias("field"))


@query("""SELECT event_id::VARCHAR AS entity_id, field, value FROM (SELECT event_id, unnest(['full_name', 'current_title', 'skills', 'skills']) AS field, unnest([event_type, CASE WHEN event_id % 2 = 0 THEN 'k' || event_id ELSE 'h' END, 'sql', 'k' || event_id]) AS value FROM events)""")
def json_props(spark, sf_dir):
    k = F.concat(F.lit("k"), F.col("event_id").cast("string"))
    payload = F.concat(F.lit('{"fullName": " '), "event_type", F.lit('", "name": " ", "title": "'), F.when(F.col("event_id") % 2 == 0, k).otherwise(""), F.lit('", "headline": "h", "skills": ["sql", " ", "'), k, F.lit('"], "other": 1}'))
    ev = json_column(table(spark, sf_dir, "events"), F.col("event_id"), F.lit("events.json"), payload)
    return ev.select("entity_id", F.col("field_name").alias("field"), F.col("raw_value").alias("value"))


@query("""SELECT entity_id, string_agg(name, ',' ORDER BY name) AS names, count(*)::BIGINT AS n FROM (SELECT c_nationkey::VARCHAR AS entity_id, c_name AS name FROM customer UNION ALL SELECT s_nationkey::VARCHAR, s_name FROM supplier) GROUP BY entity_id""")
def evidence_union(spark, sf_dir):
    made = lambda t, p: E.evidence(table(spark, sf_dir, t), F.col(f"{p}_nationkey"), F.lit("full_name"), F.col(f"{p}_name"), F.lit(f"{t}.csv"), F.lit("structured"), F.lit("column"))
    both = E.accepted(E.normalized(E.union(made("customer", "c"), made("supplier", "s"))))
    return both.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("names"), F.count("*").alias("n"))


def one_file(df: DataFrame, kind: str) -> str:
    """The path of one file of that kind that Spark writes of df."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, "made")
    getattr(df.coalesce(1).write.option("header", True) if kind == "csv" else df.coalesce(1).write, kind)(folder)
    return spark.read.format("binaryFile").load(folder).inputFiles()[0]


@query("""SELECT row_number() OVER (ORDER BY s_suppkey) AS row, s_name AS name, 'm' || s_suppkey || '@x.org' AS email, 'SQL:0.65' AS skills, s_nationkey::VARCHAR AS region FROM supplier""")
def batch_rows(spark, sf_dir):
    """A CSV file of several rows: each row is an entity."""
    t = table(spark, sf_dir, "supplier").orderBy("s_suppkey").select(F.col("s_name").alias("Candidate Name"), F.concat(F.lit("M"), "s_suppkey", F.lit("@X.org")).alias("e-mail"), F.lit("sql").alias("Tech Stack"), F.col("s_nationkey").alias("region"))
    out = run(spark, [one_file(t, "csv")]).canonical
    row = F.regexp_extract("entity_id", r"#row(\d+)$", 1).cast("long").alias("row")
    return out.select(row, F.col("full_name.value").alias("name"), F.get("emails", 0)["value"].alias("email"), flat(F.col("skills"), "name", "confidence").alias("skills"), F.try_element_at("extra_attributes", F.lit("region")).alias("region"))


@query(r"""SELECT 'k' || doc_id % 16 AS file, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id)::INTEGER AS row, doc_id::VARCHAR AS doc_id, md5(nullif(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '')) AS said, lang || ' "' || source || '"' AS label FROM documents""")
def csv_splits(spark, sf_dir):
    """Files of whole texts with line feeds and quotes, written by Spark and read in splits: every row has its number in its file."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 16).alias("k"), "doc_id", "text", F.concat("lang", F.lit(' "'), "source", F.lit('"')).alias("label"))
    folder = new_folder(spark, "made")
    d.repartition(16, "k").sortWithinPartitions("k", "doc_id").write.partitionBy("k").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    paths = spark.read.format("binaryFile").load(folder).inputFiles()
    cells = csv_facts_of(spark, paths).where("field_name is not null")
    names = F.get(F.array(*[F.lit("k" + p.split("/k=")[1].split("/")[0]) for p in paths]), F.col("source_seq"))
    one = lambda key: F.max(F.when(F.col("key") == key, F.col("raw_value")))
    return cells.groupBy(names.alias("file"), "row").agg(one("doc_id").alias("doc_id"), F.md5(one("text")).alias("said"), one("label").alias("label"))


@query(r"""SELECT 'k' || doc_id % 64 AS file, row_number() OVER (PARTITION BY doc_id % 64 ORDER BY doc_id)::INTEGER AS row, doc_id::VARCHAR AS doc_id, md5(nullif(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '')) AS said, NULL AS error FROM documents
UNION ALL SELECT 'none', 0, NULL, NULL, 'file not found'""")
def source_scan(spark, sf_dir):
    """Whole texts in CSV files, written by Spark and read back through the data source; a file that isn't there is a row that says so."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 64).alias("k"), "doc_id", "text")
    folder = new_folder(spark, "made")
    d.repartition(64, "k").sortWithinPartitions("k", "doc_id").write.partitionBy("k").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    paths = spark.read.format("binaryFile").load(folder).inputFiles()
    register(spark)
    cells = spark.read.format("tributary").load([*paths, f"{folder}/none.json"])
    names = F.get(F.array(*[F.lit("k" + p.split("/k=")[1].split("/")[0]) for p in paths], F.lit("none")), F.col("source_seq"))
    one = lambda key: F.max(F.when(F.col("key") == key, F.col("raw_value")))
    return cells.where("field_name is not null or not ok").groupBy(names.alias("file"), "row").agg(one("doc_id").alias("doc_id"), F.md5(one("text")).alias("said"), F.max("error").alias("error"))


@query("""SELECT r_name AS full_name, 'T' AS title, 'a@x.org,r0@x.org' AS emails, 'SQL:0.8;Python:0.6' AS skills, 0.9::DOUBLE AS overall, 'https://linkedin.com/in/r0' AS linkedin, true AS ok FROM region WHERE r_regionkey = 0""")
def files_of_one_entity(spark, sf_dir):
    """A CSV file of one row, a JSON file and a text file are about one entity."""
    r = table(spark, sf_dir, "region").where("r_regionkey = 0")
    c = one_file(r.select(F.col("r_name").alias("name"), F.concat(F.lit("R"), "r_regionkey", F.lit("@x.org")).alias("email"), F.lit("sql").alias("skills")), "csv")
    j = one_file(r.select(F.lower("r_name").alias("fullName"), F.lit("a@x.org").alias("email"), F.lit("T").alias("position"), F.array(F.lit("SQL"), F.lit("py")).alias("skills"), F.concat(F.lit("https://linkedin.com/in/r"), "r_regionkey").alias("page")), "json")
    out = run(spark, [c, j]).output
    return out.select("full_name", F.col("current_title").alias("title"), F.array_join(F.array_sort("emails"), ",").alias("emails"), flat(F.col("skills"), "name", "confidence").alias("skills"), F.col("overall_confidence").alias("overall"), F.try_element_at("links", F.lit("linkedin")).alias("linkedin"), "ok")


@query("""SELECT 'broken' AS file, false AS ok, 'invalid JSON' AS error FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'head', false, 'CSV has no data rows' FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'list', false, 'expected a JSON object at the top level' FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'none', false, 'file not found' FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'good', true, '' FROM region WHERE r_regionkey = 0""")
def failed_sources(spark, sf_dir):
    """What becomes of sources that can't be read; the others count."""
    r = table(spark, sf_dir, "region").where("r_regionkey = 0")
    text = lambda t: r.select(F.lit(t).alias("value"))
    made = {"broken": one_file(text("{"), "text"), "head": one_file(text("a,b"), "text"), "list": one_file(text("[1]"), "text"), "good": one_file(r.select(F.col("r_name").alias("name")), "csv")}
    found = files(spark, [*made.values(), "/nowhere/none.json"])
    names = F.get(F.array(*map(F.lit, [*made, "none"])), F.col("source_seq"))
    told = facts(found.withColumn("ext", F.when(F.col("source_seq").isin(0, 2), ".json").otherwise(F.col("ext")))).where("field_name is null")
    return told.select(names.alias("file"), "ok", F.regexp_replace(F.coalesce("error", F.lit("")), "^(invalid JSON).*", "$1").alias("error"))


@query("""SELECT n_nationkey, 'https://linkedin.com/in/n' || n_nationkey AS linkedin, CASE WHEN n_nationkey % 2 = 0 THEN 'T' END AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'University of ' || n_name ELSE '' END AS education, 'n' || n_nationkey || '@x.org' AS email FROM nation""")
def resume_texts(spark, sf_dir):
    """All that is read from extracted text, of many documents at once: sections, education lines, contacts and addresses."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("string")
    more = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("\nExperience\nAcme Labs\nT\n- did things\nEducation\nClass of 1\nUniversity of "), "n_name")).otherwise("")
    docs = n.select("n_nationkey", F.concat(F.lit("cv\nn"), k, F.lit("@x.org LinkedIn: n"), k, more).alias("text"), F.lit(0).alias("seq"))
    ev = E.normalized(sections.resume_evidence(docs, F.col("n_nationkey"), F.lit("r.pdf"), F.col("seq"), "n_nationkey", "text"))
    links = discover(docs.select(F.col("n_nationkey").cast("string").alias("entity_id"), F.col("seq").alias("source_seq"), "text"))
    p = profile.canonical(E.union(ev, link_evidence(links)))
    return p.select(F.col("entity_id").cast("int").alias("n_nationkey"), F.try_element_at("links", F.lit("linkedin")).alias("linkedin"), F.col("current_title.value").alias("title"), F.array_join(F.transform("education", lambda e: e["description"]), ";").alias("education"), F.get("emails", 0)["value"].alias("email"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS full_name, 'B' || s_suppkey AS headline, s_suppkey::VARCHAR AS followers FROM supplier""")
def enrich_github(spark, sf_dir):
    """Names that are addresses are no names."""
    t = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    url = F.concat(F.lit("https://github.com/s"), k)
    links = t.select(k.alias("entity_id"), F.lit("github").alias("kind"), url.alias("url"))
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("https://github.com/s"), k)).otherwise(F.col("s_name"))
    profiles = t.select(url.alias("url"), F.to_json(F.struct(name.alias("name"), F.concat(F.lit("B"), k).alias("bio"), F.col("s_suppkey").alias("followers"))).alias("payload"))
    p = profile.canonical(E.normalized(enrich(links, profiles)))
    return p.select(F.col("entity_id").cast("long").alias("s_suppkey"), F.col("full_name.value").alias("full_name"), F.col("headline.value").alias("headline"), F.try_element_at("extra_attributes", F.lit("github_followers")).alias("followers"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'https://linkedin.com/in/c' || c_custkey WHEN 3 THEN 'https://linkedin.com/in/d' || c_custkey END AS linkedin, CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 0.5 END::DOUBLE AS years FROM customer""")
def path_segments(spark, sf_dir):
    """Addresses without /in/ whose first segment may be the network's own; numbers of years, or what isn't one."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("x linkedin.com/"), F.when(k % 4 == 0, "c").when(k % 4 == 1, "Jobs/").when(k % 4 == 2, "company/").otherwise("d"), k.cast("string"), F.lit("."))
    text = F.when((k % 4).isin(1, 2), F.regexp_replace(text, r"\d+", "")).otherwise(text)
    said = F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(".5"))).otherwise("some")
    return table(spark, sf_dir, "customer").select("c_custkey", L.linkedin(text).alias("linkedin"), X.years(said).alias("years"))


@query("""SELECT o_custkey::VARCHAR AS entity_id, max(o_orderpriority) AS best, count(DISTINCT o_orderstatus)::BIGINT AS n FROM orders WHERE o_orderkey IN (SELECT min(o_orderkey) FROM orders GROUP BY o_custkey) GROUP BY o_custkey""")
def merge_policies(spark, sf_dir):
    """Fields that a profile has by policies of its own."""
    o = table(spark, sf_dir, "orders")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    o = o.join(first, ["o_custkey", "o_orderkey"])
    made = lambda field, column: E.evidence(o, F.col("o_custkey"), F.lit(field), F.col(column), F.lit("o.csv"), F.lit("structured"), F.lit("m"), ev_seq=F.col("o_orderkey"))
    p = profile.canonical(E.normalized(E.union(made("priority", "o_orderpriority"), made("state", "o_orderstatus"))), policies=D.POLICIES | {"priority": "single", "state": "multi"})
    return p.select("entity_id", F.col("priority.value").alias("best"), F.size("state").cast("long").alias("n"))


@query(f"""WITH {ORDERS_SQL}, d AS (SELECT entity_id, key, sum(w::DECIMAL(18,6)) AS score, min(seq) AS first FROM ev GROUP BY ALL), t AS (SELECT o_custkey::VARCHAR AS entity_id, o_orderstatus, o_orderkey, {WEIGHT_SQL.format("CASE o_orderstatus WHEN 'F' THEN 'structured' WHEN 'O' THEN 'semistructured' ELSE 'unstructured' END")} AS w FROM orders)
SELECT d.entity_id, 'current_title' AS field_name, upper(arg_min(d.key, (-d.score, d.first))) AS value, max(d.score)::DOUBLE / sum(d.score)::DOUBLE AS confidence, count(*)::BIGINT AS n_values FROM d GROUP BY d.entity_id UNION ALL
SELECT entity_id, 'manager_name', arg_max(o_orderstatus, o_orderkey), arg_max(w, o_orderkey), count(DISTINCT o_orderstatus)::BIGINT FROM t GROUP BY entity_id""")
def own_policies(spark, sf_dir):
    """A customer's priority by weighted plurality and state by the latest order: two policies that a caller brings, in the groupings of one."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "structured").when(F.col("o_orderstatus") == "O", "semistructured").otherwise("unstructured")
    states = E.normalized(E.evidence(o, F.col("o_custkey"), F.lit("manager_name"), F.col("o_orderstatus"), F.lit("orders"), kind, F.lit("column:o_orderstatus"), ev_seq=F.col("o_orderkey")))
    out = merge_by(E.union(order_evidence(spark, sf_dir), states), {"current_title": weighted_plurality(), "manager_name": latest()})
    return out.select("entity_id", "field_name", F.upper("value").alias("value"), "confidence", "n_values")


@query("""SELECT c_custkey, '+1' || lpad(c_custkey::VARCHAR, 10, '2') AS phone FROM customer""")
def norm_phone_country(spark, sf_dir):
    phone = X.normalize(F.lit("phones"), F.lpad(F.col("c_custkey").cast("string"), 10, "2"), X.normalizers("1"))
    return table(spark, sf_dir, "customer").select("c_custkey", phone.alias("phone"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'config must be a JSON object' WHEN 2 THEN 'config.fields must be an array;config.on_missing must be one of [''error'', ''null'', ''omit'']'
WHEN 3 THEN 'config.include_confidence must be a boolean;config.fields[0].path must be a non-empty string;config.fields[0].type must be one of [''boolean'', ''number'', ''string'', ''string[]''];config.fields[1] must be an object'
ELSE CASE WHEN event_type IN ('lower', 'upper') THEN '' ELSE 'config.fields[0].normalize must be one of [''E164'', ''canonical'', ''lower'', ''national'', ''title'', ''upper'']' END END AS errors,
CASE WHEN event_id % 5 = 0 THEN '{"type":"object","properties":{"' || event_type || '":{"type":"array","items":{"type":"string"}},"u' || user_id || '":{},"n":{"type":"number"}},"required":[' || CASE WHEN event_id % 10 = 0 THEN '"' || event_type || '"' ELSE '' END || ']}' END AS shape FROM events""")
def config_faults(spark, sf_dir):
    """The check of a column of configs, and the schemas of the good ones' outputs."""
    k, quoted = F.col("event_id") % 5, F.to_json(F.array("event_type"))
    name = F.regexp_replace(quoted, r"^\[|\]$", "")
    good = F.concat(F.lit('{"on_missing": "'), F.when(F.col("event_id") % 10 == 0, "null").otherwise("omit"), F.lit('", "fields": [{"path": '), name, F.lit(', "type": "string[]", "required": true}, {"path": "u'), "user_id", F.lit('"}, {"path": "n", "type": "number", "required": false}]}'))
    text = F.when(k == 0, good).when(k == 1, F.concat(F.lit("["), name, F.lit("]"))).when(k == 2, F.concat(F.lit('{"on_missing": "none", '), name, F.lit(": 1}")))
    text = text.when(k == 3, '{"fields": [{"path": " ", "type": "text"}, 1], "include_confidence": 1}').otherwise(F.concat(F.lit('{"fields": [{"path": "a", "normalize": '), name, F.lit("}]}")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(config.column_errors(text), ";").alias("errors"), config.column_schema(text).alias("shape"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def text_concat(spark, sf_dir):
    return M.ordered_text(table(spark, sf_dir, "conversations"), ["conv_id"], F.col("turn"), F.col("text"))


@query("SELECT event_id, event_id % 4 < 2 AS has_k, event_id % 4 = 1 AS has_all, event_id % 4 < 3 AS parsed FROM events")
def subset_test(spark, sf_dir):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.col("props")).when(k == 1, F.lit('{"summary": null, "k": [1]}')).when(k == 2, F.lit('{"K": 1, "sum": 2}')).otherwise(F.regexp_replace("props", r"\}$", ""))
    fenced = F.concat(F.when(k % 2 == 0, "```json\n").otherwise("  ``` "), text, F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(has_keys(text, ["k"]), F.lit(False)).alias("has_k"), F.coalesce(has_keys(text, ["k", "summary"]), F.lit(False)).alias("has_all"), F.try_parse_json(X.unfenced(fenced)).isNotNull().alias("parsed"))


# -- sections ------------------------------------------------------------------------------------


def _resumes(spark, sf_dir) -> DataFrame:
    """Documents as the experience sections of résumés."""
    text = F.concat(F.lit("Exp erience:\n"), F.coalesce("text", F.lit("")), F.lit("\nTechnical Skills\nTools: "), "lang", F.lit(", "), "source", F.lit(" | x\nEducation\n\nUniversity of "), "lang", F.lit("\nskills\nlater"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), n AS (SELECT doc_id, count(*) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id)
SELECT doc_id AS doc, 'experience' AS section, n::BIGINT AS n FROM n UNION ALL SELECT doc_id, 'skills', 1 FROM documents UNION ALL SELECT doc_id, 'education', 1 FROM documents""")
def sections_ffill(spark, sf_dir):
    return sections.sections(sections.lines(_resumes(spark, sf_dir))).groupBy("doc", "section").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS doc, unnest([lang, source]) AS skill FROM documents")
def section_skills(spark, sf_dir):
    body = sections.sections(sections.lines(_resumes(spark, sf_dir)))
    return sections.skills(body.where("section = 'skills'")).select("doc", "skill")


@query("""SELECT conv_id AS doc, CASE WHEN conv_id % 3 < 2 THEN 'Acme Labs' END AS company, CASE WHEN conv_id % 3 = 0 THEN 'Data Engineer ' || conv_id END AS title, CASE conv_id % 3 WHEN 0 THEN 'Jan 2020 – Present' WHEN 1 THEN 'May 2021' END AS "end",
string_agg('turn ' || turn, ' ' ORDER BY turn) || CASE WHEN conv_id % 3 = 0 THEN ' Pune' ELSE '' END AS summary FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY conv_id""")
def experience_latch(spark, sf_dir):
    """Company and title; a company alone; bullets alone."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    bullets = F.array_join(F.transform("t", lambda x: F.concat(F.lit("• turn "), x.cast("string"))), "\n")
    k = F.col("conv_id") % 3
    head = F.when(k == 0, F.concat(F.lit("remote, near pune\nAcme Labs\nData Engineer "), F.col("conv_id").cast("string"), F.lit("\nJan 2020 – Present\n"))).when(k == 1, "Acme Labs\nApr 2020 - May 2021\n").otherwise("")
    text = F.concat(F.lit("Work Experience\n"), head, bullets, F.when(k == 0, "\nPune").otherwise(""))
    body = sections.sections(sections.lines(t.select("conv_id", text.alias("text")), "conv_id"))
    return sections.experience(body.where("section = 'experience'")).select("doc", "company", "title", "end", "summary")


@query("""SELECT c_custkey AS doc, CASE c_custkey % 4 WHEN 0 THEN 'JANE DOE ' WHEN 1 THEN 'Jane Doe ' ELSE 'Mary Major ' END || chr((65 + c_custkey % 26)::INTEGER) AS name, CASE c_custkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 12 ELSE 8 END::BIGINT AS score FROM customer WHERE c_custkey % 4 < 3""")
def name_line(spark, sf_dir):
    """A name in capitals, one in title case, one below a header only, none."""
    c = table(spark, sf_dir, "customer")
    k, end = F.col("c_custkey") % 4, F.char(65 + F.col("c_custkey") % 26)
    above = F.when(k == 0, F.concat(F.lit("jane@x.com\n\nJANE DOE "), end)).when(k == 1, F.concat(F.lit("jane@x.com\nJane Doe "), end)).otherwise("12 Main St")
    below = F.when(k < 3, F.concat(F.lit("Mary Major "), end)).otherwise("sql, 2020")
    text = F.concat(F.lit("Curriculum Vitae\n"), above, F.when(k < 2, "\nPune, India").otherwise(""), F.lit("\nSkills\n"), below)
    return sections.names(sections.lines(c.select("c_custkey", text.alias("text")), "c_custkey")).select("doc", "name", F.col("score").cast("long").alias("score"))


# -- profiles, projections -----------------------------------------------------------------------


def customer_evidence(spark, sf_dir, name: Column | None = None, mailed: Column | None = None, skills: Column | None = None) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    name, mailed = F.col("c_name") if name is None else name, F.lit(True) if mailed is None else mailed
    skills = F.when(F.col("c_custkey") % 4 == 0, "sql, py") if skills is None else skills
    digits = F.lpad(F.col("c_custkey").cast("string"), 10, "9")
    wide = c.select(F.col("c_custkey").cast("string").alias("key"), name.alias("name"), F.when((F.col("c_custkey") % 2 == 0) & mailed, F.concat("c_name", F.lit("@x.com"))).alias("email"), F.when(F.col("c_custkey") % 3 == 0, digits).alias("phone"), F.col("c_mktsegment").alias("role"), skills.alias("skills"))
    return wide_table(dealt(wide, "key"), F.col("key"), F.lit("c.csv"))


def customer_profiles(spark, sf_dir, **told: Column) -> DataFrame:
    return profile.canonical(E.normalized(customer_evidence(spark, sf_dir, **told)))


PROFILE_SQL = """p AS (SELECT c_custkey::VARCHAR AS entity_id, c_custkey % 2 = 0 AS m, c_custkey % 3 = 0 AS f, c_custkey % 4 = 0 AS s, c_name AS name, lower(c_name) || '@x.com' AS email, '+91' || lpad(c_custkey::VARCHAR, 10, '9') AS phone, c_mktsegment AS title FROM customer)"""


def _traced_sql(field: str, column: str) -> str:
    return f"""'{{"field":"{field}","source":"c.csv","method":"csv_column:{column}"}}'"""


@query(f"""WITH {PROFILE_SQL} SELECT entity_id, '{{"candidate_id":"cand_' || substr(sha1(CASE WHEN m THEN 'email:' || email WHEN f THEN 'phone:' || phone ELSE 'name:' || lower(name) END), 1, 10) || '","full_name":"' || name || '","emails":[' || CASE WHEN m THEN '"' || email || '"' ELSE '' END
|| '],"phones":[' || CASE WHEN f THEN '"' || phone || '"' ELSE '' END || '],"current_company":null,"current_title":"' || title || '","location":null,"headline":null,"years_experience":null,"links":{{}},"education":[],"skills":['
|| CASE WHEN s THEN '{{"name":"Python","confidence":0.65,"sources":["c.csv"]}},{{"name":"SQL","confidence":0.65,"sources":["c.csv"]}}' ELSE '' END || '],"experience":[{{"company":null,"title":"' || title || '","start":null,"end":null,"summary":null}}],"overall_confidence":'
|| CASE WHEN m OR f THEN '0.9' ELSE '0.6' END || ',"provenance":[' || concat_ws(',', {_traced_sql("full_name", "name")}, {_traced_sql("current_title", "role")}, CASE WHEN m THEN {_traced_sql("emails", "email")} END, CASE WHEN f THEN {_traced_sql("phones", "phone")} END,
CASE WHEN s THEN {_traced_sql("skills", "skills")} END) || ']}}' AS output_json, '' AS errors, true AS ok FROM p""")
def project_default_output(spark, sf_dir):
    return project_default(customer_profiles(spark, sf_dir)).select("entity_id", "output_json", F.array_join("errors", ";").alias("errors"), "ok")


PUBLIC = {"fields": [{"path": "full_name", "required": True, "type": "string"}, {"path": "mail", "from": "emails[0]"}, {"path": "phone", "from": "phones[0]", "normalize": "national"}, {"path": "skills", "from": "skills[].name", "normalize": "lower"}, {"path": "nothing"}], "include_confidence": True, "on_missing": "omit"}


@query(f"""WITH {PROFILE_SQL} SELECT entity_id, '{{"full_name":"' || name || '","full_name_confidence":0.65' || CASE WHEN m THEN ',"mail":"' || email || '","mail_confidence":0.65' ELSE '' END || CASE WHEN f THEN ',"phone":"' || phone[4:] || '","phone_confidence":0.65' ELSE '' END
|| CASE WHEN s THEN ',"skills":["python","sql"],"skills_confidence":[0.65,0.65]}}' ELSE ',"skills":[],"skills_confidence":[]}}' END AS output_json, true AS ok FROM p""")
def project_public(spark, sf_dir):
    return project(customer_profiles(spark, sf_dir), PUBLIC).select("entity_id", "output_json", "ok")


STRICT = {"fields": [{"path": "mail", "from": "emails[0]", "required": True}, {"path": "phones", "required": True}, {"path": "title", "from": "current_title", "type": "number"}], "on_missing": "error"}


@query(f"""WITH {PROFILE_SQL} SELECT entity_id, CASE WHEN m AND f THEN 'validation: $.title: expected number, got str' ELSE concat_ws(';', CASE WHEN NOT m THEN 'projection: field ''mail'' (from ''emails[0]'') is missing' END, CASE WHEN NOT f THEN 'projection: field ''phones'' (from ''phones'') is missing' END) END AS errors,
CASE WHEN m AND f THEN '{{"mail":"' || email || '","phones":["' || phone || '"],"title":"' || title || '"}}' END AS output_json FROM p""")
def project_missing(spark, sf_dir):
    return project(customer_profiles(spark, sf_dir), STRICT).select("entity_id", F.array_join("errors", ";").alias("errors"), "output_json")


TRACED = {"fields": [{"path": "n", "from": "full_name"}, {"path": "emails"}, {"path": "skills", "from": "skills[].name"}], "include_provenance": True}


@query(f"""WITH {PROFILE_SQL} SELECT entity_id, 'n:c.csv:csv_column:name' AS provenance, CASE WHEN m THEN email ELSE '' END AS emails, CASE WHEN s THEN 'Python,SQL' ELSE '' END AS skills FROM p""")
def project_provenance(spark, sf_dir):
    out = project(customer_profiles(spark, sf_dir), TRACED)
    return out.select("entity_id", flat(F.col("provenance"), "field", "source", "method").alias("provenance"), F.array_join(F.transform("emails", lambda e: e), ",").alias("emails"), F.array_join("skills", ",").alias("skills"))


@query(f"""WITH {ORDERS_SQL} SELECT ev.entity_id, string_agg('current_title:' || ev.source || ':column:o_orderpriority', ';' ORDER BY seq) AS provenance FROM ev JOIN m ON ev.entity_id = m.entity_id AND (m.value IS NULL OR ev.key = m.key) GROUP BY ev.entity_id""")
def provenance_zip(spark, sf_dir):
    rows = provenance.provenance_rows(provenance.facts(order_evidence(spark, sf_dir)))
    pair = F.struct("at", F.concat_ws(":", "field_name", "source", "method").alias("text"))
    return rows.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["text"]), ";").alias("provenance"))


SCHEMA = {"type": "object", "required": ["k", "name"], "properties": {"k": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}}, "on": {"type": "number"}}}


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '$: missing required field ''name'';$.k: expected string, got int;$.tags[1]: expected string, got int;$.on: expected number, got boolean' WHEN 1 THEN '' WHEN 2 THEN '$: expected object, got list' ELSE '$: missing required field ''k'';$.tags: expected array, got dict' END AS errors FROM events""")
def validate_errors(spark, sf_dir):
    k = F.col("event_id") % 4
    bad = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "tags": ["a", 1], "on": true}'))
    text = F.when(k == 0, bad).when(k == 1, F.lit('{"k": "s", "name": 1, "tags": [], "on": 2.5}')).when(k == 2, F.lit("[1]")).otherwise(F.lit('{"name": {}, "k": null, "tags": {"a": "b"}, "on": null}'))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(json_errors(text, SCHEMA), ";").alias("errors"))


@query(f"""WITH {PROFILE_SQL} SELECT c_custkey::VARCHAR AS entity_id, unnest(['full_name', 'headline', 'location', 'skills', 'experience', 'current_company', 'current_title']) AS field,
unnest([n_name, 'Nation ' || n_nationkey, 'R' || n_regionkey, 'sql', NULL, 'Co' || n_nationkey, 'T']) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def enrich_left_join(spark, sf_dir):
    url = lambda key: F.concat(F.lit("https://linkedin.com/in/"), F.col(key).cast("string"))
    links = dealt(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"), F.lit("linkedin").alias("kind"), url("c_nationkey").alias("url")), "entity_id")
    k = F.col("n_nationkey").cast("string")
    payload = F.concat(F.lit('{"fullName": "'), "n_name", F.lit('", "headline": "Nation '), k, F.lit('", "location": "R'), F.col("n_regionkey").cast("string"), F.lit('", "skills": [{"name": " sql "}], "experience": [{"companyName": "Co'), k, F.lit('", "title": "T"}, {"summary": "none"}], "about": ""}'))
    profiles = table(spark, sf_dir, "nation").select(url("n_nationkey").alias("url"), payload.alias("payload"))
    return enrich(links, profiles).select("entity_id", F.col("field_name").alias("field"), F.col("raw_value").alias("value"))


@query(f"""WITH {ORDERS_SQL} SELECT m.entity_id, 'conflict on ''current_title'': resolved to ' || coalesce('''' || any_value(m.value) || '''', 'None') || ' (other values seen: ' || string_agg(g.key, ', ' ORDER BY g.key) || ')' AS message
FROM m JOIN g ON g.entity_id = m.entity_id AND (m.value IS NULL OR g.key <> m.key) WHERE groups > 1 GROUP BY m.entity_id""")
def conflict_warnings(spark, sf_dir):
    profiles = profile.canonical(order_evidence(spark, sf_dir))
    return profile.conflicts(profiles).select("entity_id", "message")


BRIEF = {"fields": [{"path": "full_name"}, {"path": "phone", "from": "phones[0]"}, {"path": "title", "from": "current_title"}], "on_missing": "null"}


@query(f"""WITH {PROFILE_SQL} SELECT entity_id, concat_ws(',', 'full_name_confidence', CASE WHEN m THEN 'mail,mail_confidence' END, CASE WHEN f THEN 'phone_confidence' END, 'skills,skills_confidence') AS only_a, CASE WHEN f THEN 'title' ELSE 'phone,title' END AS only_b, false AS subset FROM p""")
def config_key_diff(spark, sf_dir):
    """The keys that one of two configs' outputs has and the other hasn't."""
    both = outputs(customer_profiles(spark, sf_dir), {"a": PUBLIC, "b": BRIEF})
    left, right = compare.key_difference(F.col("a.output_json"), F.col("b.output_json"))
    return both.select("entity_id", F.array_join(left, ",").alias("only_a"), F.array_join(right, ",").alias("only_b"), (F.size(right) == 0).alias("subset"))


@query(f"""WITH {PROFILE_SQL}, c AS (SELECT p.*, c_custkey AS k FROM p JOIN customer ON entity_id = c_custkey::VARCHAR), rows AS (
SELECT entity_id, '$.mail' AS path, 'only_left' AS change, '"' || email || '"' AS "left", NULL AS "right" FROM c WHERE m AND k % 5 = 0
UNION ALL SELECT entity_id, '$.mail_confidence', 'only_left', '0.65', NULL FROM c WHERE m AND k % 5 = 0
UNION ALL SELECT entity_id, '$.full_name', 'differs', '"' || name || '"', '"' || name || ' Jr"' FROM c WHERE k % 7 = 0
UNION ALL SELECT entity_id, '$.skills[1]', 'only_left', '"sql"', NULL FROM c WHERE s AND k % 3 = 0
UNION ALL SELECT entity_id, '$.skills_confidence[1]', 'only_left', '0.65', NULL FROM c WHERE s AND k % 3 = 0
UNION ALL SELECT entity_id, unnest(['$.skills', '$.skills[0]']), unnest(['only_left', 'only_right']), unnest(['[]', NULL]), unnest([NULL, '"zither"']) FROM c WHERE NOT s AND k % 11 = 0
UNION ALL SELECT entity_id, unnest(['$.skills_confidence', '$.skills_confidence[0]']), unnest(['only_left', 'only_right']), unnest(['[]', NULL]), unnest([NULL, '0.59']) FROM c WHERE NOT s AND k % 11 = 0)
SELECT * FROM rows""")
def run_difference(spark, sf_dir):
    """Two runs over customers of whom some were told anew in between."""
    k = F.col("c_custkey")
    name = F.when(k % 7 == 0, F.concat("c_name", F.lit(" Jr"))).otherwise(F.col("c_name"))
    skills = F.when((k % 4 == 0) & (k % 3 == 0), "py").when(k % 4 == 0, "sql, py").when(k % 11 == 0, "zither")
    old, new = customer_profiles(spark, sf_dir), customer_profiles(spark, sf_dir, name=name, mailed=k % 5 != 0, skills=skills)
    return compare.compare(project(old, PUBLIC), project(new, PUBLIC))


LISTS = {"fields": [{"path": "full_name"}, {"path": "emails"}, {"path": "phones"}, {"path": "skills", "from": "skills[].name"}]}


@query(f"""WITH {PROFILE_SQL} SELECT entity_id, '{{"full_name":"' || name || '","emails":[' || CASE WHEN m THEN '"' || email || '"' ELSE '' END || '],"phones":[' || CASE WHEN f THEN '"' || phone || '"' ELSE '' END || '],"skills":[' || CASE WHEN s THEN '"Python","SQL"' ELSE '' END || ']}}' AS output_json,
'cand_' || substr(sha1(CASE WHEN m THEN 'email:' || email WHEN f THEN 'phone:' || phone ELSE 'name:' || lower(name) END), 1, 10) AS candidate_id, CASE WHEN m OR f OR s THEN '' ELSE 'incomplete' END AS warnings, 0::BIGINT AS n_errors FROM p""")
def run_sinks(spark, sf_dir):
    """A run of many entities, written whole, written again without effect, and read back."""
    result, folder = resolve(customer_evidence(spark, sf_dir), LISTS), new_folder(spark, "runs")
    for _ in range(2):
        write_run(result, folder, "nightly")
    back = read_run(spark, folder, "nightly")
    warned = back.warnings.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("warnings"))
    ids = back.canonical.select("entity_id", F.get_json_object("profile", "$.candidate_id").alias("candidate_id"))
    out = back.output.join(ids.hint("merge"), "entity_id").join(warned.hint("merge"), "entity_id", "left")  # never broadcast, of however many entities
    return out.select("entity_id", "output_json", "candidate_id", F.coalesce("warnings", F.lit("")).alias("warnings"), F.size("errors").cast("long").alias("n_errors"))


@query(f"""WITH {PROFILE_SQL} SELECT entity_id, NULL AS output, 'projection: field ''years_of_experience'' (from ''years_of_experience'') is missing' AS errors, name, '' AS warnings FROM p""")
def run_envelopes(spark, sf_dir):
    """The answers of a run by a preset that no profile can satisfy."""
    rows = envelope(resolve(customer_evidence(spark, sf_dir), config.load("strict_required")))
    return rows.select("entity_id", "output", F.array_join("errors", ";").alias("errors"), F.get_json_object("canonical", "$.full_name.value").alias("name"), F.array_join(F.coalesce("warnings", F.array().cast("array<string>")), ";").alias("warnings"))


@query("""SELECT n_nationkey, 'BSc in F' || n_nationkey || ' at ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' (2001 - )' ELSE '' END || ';MA' AS education FROM nation""")
def enrich_education(spark, sf_dir):
    """Education lists of profiles, under all the names that their keys have; entries that say nothing go."""
    k = F.col("n_nationkey")
    pick = lambda a, b: F.when(k % 2 == 0, a).otherwise(b)
    payload = F.concat(F.lit('{"education": [{"'), pick("schoolName", "university"), F.lit('": "'), "n_name", F.lit('", "'), pick("degreeName", "qualification"), F.lit('": "BSc", "'), pick("fieldOfStudy", "field"), F.lit('": "F'), k.cast("string"), F.lit('"'), pick(', "startDate": "2001"', ""), F.lit('}, {"school": ""}, {"degree": "MA"}, {}]}'))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.transform(parse_education(F.parse_json(payload)), lambda e: e["description"]), ";").alias("education"))


@query("""WITH o AS (SELECT o_orderpriority || '/' || o_orderstatus AS text, o_orderkey FROM orders)
SELECT o_orderkey, CASE WHEN text LIKE '%F' THEN NULL WHEN text LIKE '%O' THEN 'S ' || text END AS summary, CASE WHEN text LIKE '%F' THEN '' ELSE 'r1,r2' END AS roles,
CASE WHEN text LIKE '1%F' THEN 'API quota exceeded across all fallback models.' WHEN text LIKE '2%F' THEN 'Invalid API key provided.' WHEN text LIKE '3%F' THEN 'All models are currently overloaded. Please try again later.' WHEN text LIKE '%F' THEN 'Model error: ' || text END AS error FROM o WHERE text NOT LIKE '%P' UNION ALL
SELECT o_orderkey, 'S ' || text, 'r1,r2', NULL FROM o WHERE text LIKE '%P'""")
def insight_answers(spark, sf_dir):
    """Remarks on outputs by a function that fails for some, asked once for equal outputs."""

    def ask(text: str) -> str:
        if text.endswith("F"):
            raise RuntimeError({"1": "Error 429: Quota", "2": "bad API_KEY", "3": "503"}.get(text[0], text))
        return '```json\n{"recruiter_summary": "S ' + text + '", "recommended_roles": ["r1", "r2"]}\n```'

    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("output_json"))
    told = with_insights(o, ask)
    return told.select("o_orderkey", F.col("insights.summary").alias("summary"), F.array_join(F.coalesce("insights.recommended_roles", F.array().cast("array<string>")), ",").alias("roles"), F.col("insights_error").alias("error"))


#: The one that stands for all.
FLAGSHIP = merge_single_plurality
