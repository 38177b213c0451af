"""CSV files of any size, read by many tasks, with the row numbers of a serial reader.

A split of a file doesn't know whether it begins inside a quoted field. So each split is walked from both beginnings, and says for either how it ends and how many rows begin
in it. One row a split is then put together in the files' order: how each split really begins, and the number of its first row. With that known every split is parsed
where it is; only rows that lie across splits are brought together.
"""

from __future__ import annotations

import csv
import io
import sys
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.session import ship
from tributary.sources.readers import listed_files, row_facts, separator

DELIMITERS = ",\t;|"
#: Characters of a file's beginning that its delimiter is told from.
SAMPLE = 2048
MARK = "\ufeff"
SPLIT = "file string, start long, ends array<boolean>, begun array<long>, runs array<long>, head string, bad boolean"
PLAN = "file string, start long, quoted boolean, row long, run long, delimiter string, head array<string>, n long, error string"
CELL = "file string, ev_seq int, row int, field_name string, raw_value string, key string, method string"
#: A task's Python holds so many rows of a batch at a time, and gives back what it made by so many characters or rows.
PIECE, MOST_CHARACTERS, MOST_ROWS = 256, 1_000_000, 20_000
RUN = "file string, run long, start long, row long, delimiter string, head array<string>, text string, whole boolean"


def quoted_after(line: str, quoted: bool, delimiter: str) -> bool:
    """Whether a quoted field is open at the end of a line: a quote opens one at the beginning of a field alone, and two of them within are none."""
    pieces = line.split('"')
    fresh = not quoted and pieces[0][-1:] in ("", delimiter)
    i, last = 1, len(pieces) - 1
    while i <= last:
        piece = pieces[i]
        if quoted and piece == "" and i < last:
            i += 1  # a doubled quote: what follows is still inside
        elif quoted:
            quoted, fresh = False, piece[-1:] == delimiter
        elif fresh:
            quoted = True
        else:
            fresh = piece[-1:] == delimiter
        i += 1
    return quoted


def walked(chunk: str, quoted: bool, delimiter: str) -> tuple[bool, int]:
    """Of what stands between two line feeds: whether a quoted field is open at its end, and how many rows that aren't blank begin in it. Carriage returns end lines, too."""
    if '"' not in chunk and "\r" not in chunk:
        return quoted, int(not quoted and chunk != "")
    lines, rows = chunk.split("\r"), 0
    for line in lines if lines[-1] or len(lines) == 1 else lines[:-1]:
        rows += not quoted and line != ""
        quoted = quoted_after(line, quoted, delimiter)
    return quoted, rows


def parsed(text: str, delimiter: str) -> list[list[str]]:
    """The rows of text that aren't blank."""
    if not any(c in text for c in '"\r\n'):
        return [text.split(delimiter)] if text else []
    csv.field_size_limit(sys.maxsize)
    return [cells for cells in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if cells]


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, start, value) of each line; a partition has whole splits, one after another, each in its order. A value that isn't UTF-8 is null."""
    text = spark.read.option("lineSep", "\n").text(paths)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return text.select(F.regexp_replace(path, "^file:/+", "/").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.when(F.is_valid_utf8("value"), F.col("value")).alias("value"))


def _names(kind: str) -> list[str]:
    return [x.split()[0] for x in kind.split(", ")]


def _flat(batches, *names: str):
    """The rows of Arrow's batches. Of a batch PIECE rows at a time are Python's objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            piece = batch.slice(at, PIECE)
            yield from zip(*[piece.column(n).to_pylist() for n in names])


def _batch(rows: list[tuple], kind: str):
    """Rows of a kind as a batch of Arrow."""
    import pyarrow as pa

    plain = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [plain.get(t) or pa.list_(plain[t[6:-1]]) for t in (x.split()[1] for x in kind.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _names(kind))


def _walk(batches):
    """A row of SPLIT for each split. By delimiter and beginning (outside, inside quotes): how it ends, its rows, its runs, which are lines that begin outside quotes. Of
    a file's first split also its beginning, with the whole first row whatever the delimiter."""
    for (file, start), lines in groupby(_flat(batches, "file", "start", "value"), lambda x: x[:2]):
        ends, begun, runs, head, size, closed, bad = [False, True] * 4, [0] * 8, [0] * 8, [], 0, [False] * 4, False
        for _, _, chunk in lines:
            bad, chunk = bad or chunk is None, chunk or ""
            if start == 0 and (size < SAMPLE or not all(closed)):
                chunk = chunk if head else chunk.removeprefix(MARK)
                head.append(chunk)
                size += len(chunk) + 1
            for i in range(8):
                runs[i] += not ends[i]
                ends[i], n = walked(chunk, ends[i], DELIMITERS[i // 2])
                begun[i] += n
            if size:
                closed = [done or not e for done, e in zip(closed, ends[::2])]
        yield _batch([(file, start, ends, begun, runs, "\n".join(head) if start == 0 else None, bad)], SPLIT)


def _joined(splits):
    """The PLAN of a file from its splits."""
    import pandas as pd

    splits = splits.sort_values("start")
    text = splits["head"].iloc[0] or ""
    delimiter = separator(text[:SAMPLE])
    csv.field_size_limit(sys.maxsize)
    head = next(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), [])
    out, quoted, row, run, at = [], False, 0, 0, 2 * DELIMITERS.index(delimiter)
    for file, start, ends, begun, runs in zip(splits["file"], splits["start"], splits["ends"], splits["begun"], splits["runs"]):
        out.append((file, start, quoted, row, run, delimiter, head))
        row, run, quoted = row + begun[at + quoted], run + runs[at + quoted], bool(ends[at + quoted])
    n = row - 1  # but for the header
    error = "unreadable CSV: not UTF-8" if splits["bad"].any() else "CSV has no header row" if not any(h.strip() for h in head) else "CSV has no data rows" if n < 1 else None
    return pd.DataFrame([(*x, n, error) for x in out], columns=_names(PLAN))


def _cut(batches):
    """RUN rows: lines from one that begins outside quotes to one that ends there, and the number of the first row. A run that a split's end cuts is there in parts that aren't
    whole, of which the first has the number."""
    out, size = [], 0
    for (file, start), lines in groupby(_flat(batches, "file", "start", "value", "quoted", "row", "run", "delimiter", "head"), lambda x: x[:2]):
        held, first, row = [], None, None
        for _, _, chunk, began, row_, run_, delimiter, head in lines:
            if row is None:  # the split's first line
                quoted, row, run, whole = began, row_, run_ - began, not began
                chunk = chunk.removeprefix(MARK) if start == 0 else chunk
            if not held and whole:
                first = row
            held.append(chunk)
            quoted, n = walked(chunk, quoted, delimiter)
            row += n
            if not quoted:
                text = "\n".join(held)
                if text:
                    out.append((file, run, start, first, delimiter, head, text, whole))
                    size += len(text)
                held, whole, first = [], True, None
                run += 1
                if size > MOST_CHARACTERS or len(out) >= MOST_ROWS:
                    yield _batch(out, RUN)
                    out, size = [], 0
        if held:
            out.append((file, run, start, first, delimiter, head, "\n".join(held), False))
    if out:
        yield _batch(out, RUN)


def _facts(batches):
    """CELL rows of runs, FACT rows but for source_seq and source_id, which are put in by file."""
    out, size = [], 0
    for file, row, delimiter, head, text in _flat(batches, "file", "row", "delimiter", "head", "text"):
        for n, cells in enumerate(parsed(text, delimiter), row):
            if n > 0:
                out += [(file, i, n, field, value, key, method) for i, (field, value, key, method) in enumerate(row_facts(head, cells))]
        size += len(text)
        if out and (size > MOST_CHARACTERS or len(out) >= MOST_ROWS):
            yield _batch(out, CELL)
            out, size = [], 0
    if out:
        yield _batch(out, CELL)


def csv_facts_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """What readers.facts() says of these CSV files, ev_seq counted within the row; any number of tasks reads a file, in splits of spark.sql.files.maxPartitionBytes.

    The plan that is broadcast has a row for each split: some 800,000 rows, or 80 MB, for 100 TB in splits of 128 MB. Quoted fields may hold line feeds and be of any length that
    a task can hold. A null row, a status, is there for every path, be the file missing, empty or unreadable.
    """
    listed, there = listed_files(spark, paths)
    ship(spark)
    rows = None
    if there:
        lines = _lines(spark, there)
        plan = lines.mapInArrow(_walk, SPLIT).groupBy("file").applyInPandas(_joined, PLAN)
        good = plan.where("error is null").drop("n", "error")
        runs = lines.join(F.broadcast(good), ["file", "start"]).mapInArrow(_cut, RUN)
        parts = F.array_sort(F.collect_list(F.struct("start", "text")))
        cut = runs.where("not whole").groupBy("file", "run").agg(F.max("row").alias("row"), F.first("delimiter").alias("delimiter"), F.first("head").alias("head"), F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))
        columns = ["file", "row", "delimiter", "head", "text"]
        cells = runs.where("whole").select(columns).union(cut.select(columns)).mapInArrow(_facts, CELL)
        ids = listed.where("error is null").select("source_seq", "source_id", F.col("key").alias("file"))
        name = F.concat("source_id", F.lit("#row"), "row")
        rows = cells.join(F.broadcast(ids), "file").select("source_seq", "ev_seq", "row", "field_name", "raw_value", "key", name.alias("source_id"), F.lit("structured").alias("source_type"), "method", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("array<string>").alias("warnings"))
        told = ids.join(plan.where("start = 0").select("file", "n", "error"), "file", "left")
        told = told.select("source_seq", "n", F.when(F.col("n").isNull(), F.lit("CSV has no header row")).otherwise(F.col("error")).alias("error"))
    else:
        told = spark.createDataFrame([], "source_seq int, n long, error string")
    told = listed.select("source_seq", "source_id", F.col("error").alias("missing")).join(told, "source_seq", "left")
    error, n = F.coalesce("missing", "error"), F.coalesce(F.when(F.col("error").isNull(), F.col("n")), F.lit(0)).cast("int")
    many = F.when(n > 1, F.array(F.concat(F.lit("CSV contains "), n, F.lit(" rows; batch mode enabled.")))).otherwise(F.array().cast("array<string>"))
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (("field_name", "string"), ("raw_value", "string"), ("key", "string"))]
    told = told.select("source_seq", F.lit(-1).alias("ev_seq"), n.alias("row"), *nothing, "source_id", F.lit("structured").alias("source_type"), F.lit(None).cast("string").alias("method"), error.isNull().alias("ok"), error.alias("error"), many.alias("warnings"))
    return told if rows is None else rows.unionByName(told)
