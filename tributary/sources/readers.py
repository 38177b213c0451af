"""CSV, JSON, text and document files as evidence.

A file is a row (file name, bytes) until it is parsed, so many small files are read in parallel and a broken
one becomes a row of its own that says what is wrong. Large CSV tables go through ``wide_table`` instead.
"""

from __future__ import annotations

import csv
import io
import json
import os
import re
import sys
from collections.abc import Callable, Iterator, Mapping
from urllib.parse import quote, unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import dicts as D
from tributary.operators.evidence import evidence
from tributary.sources.pdf import pdf_text
from tributary.session import ship

ALIASES = {a: field for field, aliases in D.COLUMN_ALIASES.items() for a in aliases}
SOURCES = "entity_id string, source_seq int, source_id string, source_type string, ok boolean, error string, warnings array<string>"
FACT = "source_seq int, ev_seq int, row int, field_name string, raw_value string, key string, source_id string, source_type string, method string, ok boolean, error string, warnings array<string>"


def header_key(name: str) -> str:
    return "".join(c for c in name.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")


def header_key_column(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def alias_column(key: Column) -> Column:
    """The field that a header's key stands for, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), key)


def separator(sample: str) -> str:
    """Of comma, tab, semicolon and bar what splits the lines of a sample; a comma where that can't be told."""
    try:
        return csv.Sniffer().sniff(sample, delimiters=",\t;|").delimiter
    except csv.Error:
        return ","


def row_facts(head: list[str], cells: list[str]) -> Iterator[tuple]:
    """(field, value, key, method) of each cell of a row that isn't blank."""
    for column, value in zip(head, cells):  # missing cells are missing, those beyond the header have no name
        value = value.strip()
        if not value:
            continue
        field, method = ALIASES.get(header_key(column)), f"csv_column:{column}"
        if field == "skills":
            for skill in value.replace("|", ",").replace(";", ",").split(","):
                if skill.strip():
                    yield field, skill.strip(), None, method
        elif field:
            yield field, value, None, method
        else:
            yield "extra_attributes", value, column, method


def csv_facts(name: str, data: bytes) -> Iterator[tuple]:
    """(row, field, value, key, method) of each cell that isn't blank; raises ValueError with what is wrong with the file."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise ValueError(f"unreadable CSV: {e}") from e
    csv.field_size_limit(sys.maxsize)
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=separator(text[:2048]))
    head = next(rows, None)
    if not head or not any(h.strip() for h in head):
        raise ValueError("CSV has no header row")
    n = 0
    for cells in rows:
        if not cells:
            continue
        n += 1
        for fact in row_facts(head, cells):
            yield n, *fact
    if not n:
        raise ValueError("CSV has no data rows")


def json_facts(name: str, data: bytes) -> Iterator[tuple]:
    try:
        top = json.loads(data.decode("utf-8-sig"))
    except ValueError as e:
        raise ValueError(f"invalid JSON: {e}") from e
    if not isinstance(top, dict):
        raise ValueError("expected a JSON object at the top level")
    for field, keys in D.KEY_ALIASES.items():
        for key in keys:
            values = [x for x in (top[key] if isinstance(top.get(key), list) else [top.get(key)]) if x is not None and str(x).strip()]
            if values:
                for x in values if field in D.MULTI_FIELDS else values[:1]:
                    yield 0, field, str(x).strip(), None, f"json_key:{key}"
                break
    if isinstance(top.get("skills"), list):
        for x in top["skills"]:
            if x is not None and str(x).strip():
                yield 0, "skills", str(x).strip(), None, "json_key:skills[]"


READERS: dict[str, tuple[str, Callable[[str, bytes], Iterator[tuple]]]] = {".csv": ("structured", csv_facts), ".txt": ("structured", csv_facts), ".json": ("semistructured", json_facts)}
#: .text: text that is to be read as a document, as it is.
DOCUMENTS = (".pdf", ".text")


#: Names in one pattern of a scan.
NAMES = 200


def plain_path(path: str) -> str:
    """How a path is known in a scan's rows: no scheme for local files, else as it is."""
    path = path if "://" in path or path.startswith(("/", "file:")) else os.path.abspath(path)
    return re.sub("^file:/+", "/", path)


def _patterns(paths: list[str]) -> list[str]:
    """The paths as patterns of names in a folder, so that a file that isn't there is no error while others are."""
    folders: dict[str, list[str]] = {}
    for path in dict.fromkeys(paths):
        folder, _, name = plain_path(path).rpartition("/")
        folders.setdefault(folder, []).append(re.sub(r"([\\{}\[\]*?,^])", r"\\\1", name))
    return [f"{folder}/{{{','.join(names[i : i + NAMES])}}}" for folder, names in folders.items() for i in range(0, len(names), NAMES)]


def _scan(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """One scan of all these files that are there, or None."""
    known = _patterns(paths)
    try:
        return spark.read.format("binaryFile").load(known) if known else None
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    there = []
    for pattern in known:  # folders of which nothing is there
        try:
            there.append(spark.read.format("binaryFile").load(pattern) and pattern)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.read.format("binaryFile").load(there) if there else None


def _listed(spark: SparkSession, paths: list[str], scan: DataFrame | None) -> tuple[DataFrame, set[str]]:
    found = {plain_path(unquote(f)) for f in scan.inputFiles()} if scan is not None else set()
    rows = []
    for i, path in enumerate(paths):
        name = path.rstrip("/").rsplit("/", 1)[-1]
        rows.append((i, name, extension(name), plain_path(path), None if plain_path(path) in found else "file not found"))
    return spark.createDataFrame(rows, "source_seq int, source_id string, ext string, key string, error string"), found


def listed_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """(source_seq, source_id, ext, key, error) of each path, and the paths of files that are there; key is the path as scans know it. Nothing is read."""
    listed, found = _listed(spark, paths, _scan(spark, paths))
    return listed, [p for p in dict.fromkeys(paths) if plain_path(p) in found]


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_seq, source_id, ext, content, error) of each path, in their order; a file that isn't there is a row with an error.

    All files are one scan, joined with the list of paths by name; the list is the caller's, the contents stay where they are read.
    """
    kind, scan = "source_seq int, source_id string, ext string, content binary, error string", _scan(spark, paths)
    listed, _ = _listed(spark, paths, scan)
    none = listed.where("error is not null").select("source_seq", "source_id", "ext", F.lit(None).cast("binary").alias("content"), "error")
    if scan is None:
        return none.to(spark.createDataFrame([], kind).schema)
    listed, at = listed.where("error is null"), F.regexp_replace("path", "^file:/+", "/")
    full = scan.select(at.alias("at"), "content").join(listed, F.col("at") == F.col("key")).select("source_seq", "source_id", "ext", "content", "error")
    empty = listed.join(scan.select(at.alias("at")), F.col("at") == F.col("key"), "left_anti")  # an empty file has no row in a scan
    empty = empty.select("source_seq", "source_id", "ext", F.lit(b"").alias("content"), "error")
    return full.union(empty).union(none)


def extension(name: str) -> str:
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def filesystem(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else fs.FileSystem.from_uri(f"file://{quote(plain_path(path))}")


def file_facts(readers: Mapping, seq: int, name: str, ext: str, data: bytes | None, error: str | None) -> list[tuple]:
    """FACT rows of a file, and one without a field that says how it went."""
    kind, read = readers.get(ext, ("unknown", None))
    rows, warnings = [], []
    if error is None and read is None:
        error = f"unsupported file type '{ext}'"
    if error is None:
        try:
            rows = list(read(name, data))
        except ValueError as e:
            error = str(e)
        except Exception as e:  # noqa: BLE001  one bad file is no reason to fail
            error, kind = f"unexpected error: {e}", "unknown"
    n = max((r[0] for r in rows), default=0)
    if n > 1:
        warnings.append(f"CSV contains {n} rows; batch mode enabled.")
    out = [(seq, i, r[0], r[1], r[2], r[3], f"{name}#row{r[0]}" if r[0] else name, kind, r[4], True, None, None) for i, r in enumerate(rows)]
    out.append((seq, -1, n, None, None, None, name, kind, None, error is None, error, warnings))
    return out


def facts(found: DataFrame) -> DataFrame:
    """The facts of tabular and JSON files, and a row without a field for each file that says how it went."""
    readers = dict(READERS)

    def parse(batches):
        import pandas as pd

        columns = [x.split()[0] for x in FACT.split(", ")]
        for batch in batches:
            for seq, name, ext, data, error in zip(batch["source_seq"], batch["source_id"], batch["ext"], batch["content"], batch["error"]):
                yield pd.DataFrame(file_facts(readers, seq, name, ext, data, error), columns=columns)

    ship(found.sparkSession)
    return found.where(~F.col("ext").isin(*DOCUMENTS)).mapInPandas(parse, FACT)


def to_evidence(rows: DataFrame, entity_id: Column) -> DataFrame:
    """Facts as evidence of the entity that entity_id tells from source_id and row."""
    attributes = F.when(F.col("key").isNotNull(), F.create_map("key", "raw_value"))
    return evidence(rows.where("field_name is not null"), entity_id, F.col("field_name"), F.when(F.col("key").isNull(), F.col("raw_value")), F.col("source_id"), F.col("source_type"), F.col("method"), F.col("source_seq"), F.col("ev_seq"), value_map=attributes)


def to_sources(rows: DataFrame, entity_id: Column) -> DataFrame:
    return rows.where("field_name is null").select(entity_id.alias("entity_id"), "source_seq", "source_id", "source_type", "ok", "error", "warnings")


def document_text(ext: str, data: bytes | None, error: str | None, extract: Callable[[bytes], str]) -> tuple[str | None, str | None]:
    """(text, error) of a document."""
    if error is not None:
        return None, error
    try:
        text = extract(data) if ext == ".pdf" else data.decode("utf-8", "replace")
    except Exception as e:  # noqa: BLE001
        return None, f"could not read PDF: {e}"
    return (text, None) if text and text.strip() else (None, "PDF produced no extractable text (likely scanned/image-only)")


def document_texts(found: DataFrame, extract: Callable[[bytes], str] | None = None) -> DataFrame:
    """(source_seq, source_id, text, error) of documents; extract makes text of a PDF's bytes, pdf_text() unless another is given."""
    extract = extract or pdf_text

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = zip(batch["source_seq"], batch["source_id"], batch["ext"], batch["content"], batch["error"])
            yield pd.DataFrame([(seq, name, *document_text(ext, data, error, extract)) for seq, name, ext, data, error in rows], columns=["source_seq", "source_id", "text", "error"])

    ship(found.sparkSession)
    return found.where(F.col("ext").isin(*DOCUMENTS)).mapInPandas(run, "source_seq int, source_id string, text string, error string")


def wide_table(df: DataFrame, entity_id: Column, source_id: Column, source_type: Column | None = None, aliases: dict[str, str] = ALIASES, source_seq: Column | None = None) -> DataFrame:
    """A wide table, of any size, as evidence: its columns are unpivoted, known headers are fields, the others attributes. Stays in the JVM."""
    columns = df.columns
    kept = df.select(entity_id.cast("string").alias("_e"), source_id.alias("_s"), (source_type if source_type is not None else F.lit("structured")).alias("_t"), (source_seq if source_seq is not None else F.lit(0)).alias("_q"), *[F.trim(F.col(c).cast("string")).alias(f"c{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.lit(aliases.get(header_key(c))).cast("string").alias("field"), F.col(f"c{i}").alias("v")) for i, c in enumerate(columns)])
    rows = kept.select("_e", "_s", "_t", "_q", F.explode(F.filter(cells, lambda x: x["v"] != "")).alias("x")).select("_e", "_s", "_t", "_q", "x.*")
    values = F.when(F.col("field") == "skills", F.filter(F.transform(F.split("v", "[,|;]"), lambda s: F.trim(s)), lambda s: s != "")).otherwise(F.array("v"))
    rows = rows.select("_e", "_s", "_t", "_q", "i", "column", "field", F.posexplode(values).alias("k", "v"))
    return evidence(rows, F.col("_e"), F.coalesce("field", F.lit("extra_attributes")), F.when(F.col("field").isNotNull(), F.col("v")), F.col("_s"), F.col("_t"), F.concat(F.lit("csv_column:"), "column"), F.col("_q"), F.col("i") * 1000 + F.col("k"), value_map=F.when(F.col("field").isNull(), F.create_map("column", "v")))


def json_column(df: DataFrame, entity_id: Column, source_id: Column, payload: Column, source_seq: Column | None = None) -> DataFrame:
    """A column of JSON objects as evidence, in the JVM: of each field the first alias that is there and not blank, and the items of skills."""
    v = F.try_parse_json(payload)
    get = lambda key: F.trim(F.try_variant_get(v, f"$.{key}", "string"))
    cells = []
    for i, (field, keys) in enumerate(D.KEY_ALIASES.items()):
        value, method = F.lit(None).cast("string"), F.lit(None).cast("string")
        for key in reversed(keys):
            there = F.coalesce(get(key) != "", F.lit(False))
            value, method = F.when(there, get(key)).otherwise(value), F.when(there, F.lit(f"json_key:{key}")).otherwise(method)
        cells.append(F.struct(F.lit(i).alias("i"), F.lit(field).alias("field"), value.alias("v"), method.alias("m")))
    skills = F.transform(F.filter(F.coalesce(F.try_variant_get(v, "$.skills", "array<string>"), F.array().cast("array<string>")), lambda s: F.trim(s) != ""), lambda s, k: F.struct((k + 100).alias("i"), F.lit("skills").alias("field"), F.trim(s).alias("v"), F.lit("json_key:skills[]").alias("m")))
    rows = df.select(entity_id.cast("string").alias("_e"), source_id.alias("_s"), (source_seq if source_seq is not None else F.lit(0)).alias("_q"), F.explode(F.concat(F.array(*cells), skills)).alias("x")).where("x.v is not null").select("_e", "_s", "_q", "x.*")
    return evidence(rows, F.col("_e"), F.col("field"), F.col("v"), F.col("_s"), F.lit("semistructured"), F.col("m"), F.col("_q"), F.col("i"))


def raw_texts(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(source_seq, text) of every readable file, for the discovery of addresses. JSON is written anew, so that nothing in it is escaped that need not be."""
    text = F.decode("content", "UTF-8")
    plain = found.where(~F.col("ext").isin(*DOCUMENTS) & F.col("error").isNull()).select("source_seq", F.when(F.col("ext") == ".json", F.to_json(F.try_parse_json(text))).otherwise(text).alias("text"))
    return plain.where("text is not null").union(documents.where("text is not null").select("source_seq", "text"))
