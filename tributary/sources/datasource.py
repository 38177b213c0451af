"""Files as a data source of Spark: spark.read.format("tributary").load(paths) gives their facts.

    register(spark)
    spark.read.format("tributary").load(["a/resume.csv", "a/profile.json"]).where("source_id = 'profile.json'")

A path is a file or a folder, of which all files count; a scheme may say where it is. Small files share a partition, so there are as many as the bytes need. Conditions on source_seq, source_id and
source_type are pushed to the scan: files that can't meet them are not opened. A file is read whole by its task; csv_facts_of reads larger CSV files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tributary.session import ship
from tributary.sources.pdf import pdf_text
from tributary.sources.readers import DOCUMENTS, FACT, READERS, document_text, extension, file_facts, filesystem

#: Bytes of files in a partition, and what opening one counts as.
PARTITION, OPEN = 32 << 20, 1 << 20


@dataclass
class Part(InputPartition):
    """(source_seq, name, path, error) of files that one task reads."""

    files: list[tuple[int, str, str, str | None]]


def listing(paths: list[str]) -> list[tuple[str, str, int, str | None]]:
    """(path, name, bytes, error) of all files of paths, in their order, those of a folder by name; names that begin with a dot or underscore are none of its files."""
    from pyarrow.fs import FileSelector, FileType

    out = []
    for path in paths:
        fs, at = filesystem(path)
        name = path.rstrip("/").rsplit("/", 1)[-1]
        info = fs.get_file_info(at)
        if info.type == FileType.File:
            out.append((path, name, info.size, None))
        elif info.type == FileType.Directory:
            root = at.rstrip("/")
            found = sorted((f.path, f.size) for f in fs.get_file_info(FileSelector(at, recursive=True)) if f.type == FileType.File)
            inside = [(f[len(root) + 1 :], size) for f, size in found]
            shown = quote if "://" in path else str
            out += [(f"{path.rstrip('/')}/{shown(x)}", x.rsplit("/", 1)[-1], size, None) for x, size in inside if not any(y.startswith((".", "_")) for y in x.split("/"))]
        else:
            out.append((path, name, 0, "file not found"))
    return out


def allowed(filters: list[tuple[str, tuple]], seq: int, name: str, kind: str) -> bool:
    """Whether a file may have rows that meet all of (column, values). A source_id names a file or one of its rows; a file that fails may have no kind."""
    for column, values in filters:
        if column == "source_seq" and seq not in values or column == "source_id" and not any(v == name or str(v).startswith(f"{name}#row") for v in values) or column == "source_type" and kind not in values and "unknown" not in values:
            return False
    return True


class FactsReader(DataSourceReader):
    def __init__(self, paths: list[str], readers: Mapping, extract: Callable[[bytes], str]) -> None:
        self.paths, self.readers, self.extract, self.filters = paths, dict(readers), extract, []

    def kind(self, ext: str) -> str:
        return "unstructured" if ext in DOCUMENTS else self.readers.get(ext, ("unknown",))[0]

    def partitions(self) -> list[Part]:
        parts, room = [], 0
        for seq, (path, name, size, error) in enumerate(listing(self.paths)):
            if not allowed(self.filters, seq, name, self.kind(extension(name))):
                continue
            if not parts or room < size + OPEN:
                parts.append(Part([]))
                room = PARTITION
            parts[-1].files.append((seq, name, path, error))
            room -= size + OPEN
        return parts or [Part([])]

    def read(self, part: Part) -> Iterator[tuple]:
        for seq, name, path, error in part.files:
            ext, data = extension(name), None
            if error is None:
                try:
                    fs, at = filesystem(path)
                    with fs.open_input_stream(at, compression=None) as f:
                        data = f.read()
                except FileNotFoundError:
                    error = "file not found"
            if ext not in DOCUMENTS:
                yield from file_facts(self.readers, seq, name, ext, data, error)
                continue
            text, error = document_text(ext, data, error, self.extract)
            if error is None:
                yield seq, 0, 0, "document", text, None, name, "unstructured", "document", True, None, None
            yield seq, -1, 0, None, None, None, name, "unstructured", None, error is None, error, []


class PushingReader(FactsReader):
    """Spark takes a reader with this method only if its setting for it is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("source_seq",), ("source_id",), ("source_type",)):
                self.filters.append((f.attribute[0], tuple(f.value) if isinstance(f, In) else (f.value,)))
            yield f  # they leave files out, rows are Spark's to filter


def register(spark: SparkSession, readers: Mapping[str, tuple[str, Callable]] = READERS, extract: Callable[[bytes], str] = pdf_text, name: str = "tributary", push: bool = True) -> None:
    """Makes the format known to a session. readers: (source_type, facts of a file's name and bytes) by extension, those of a caller's own among them; extract: text of a PDF's bytes.

    Rows are those of facts(); a document is one fact, `document`, its whole text. Every file has a row without a field that says how it went, one that isn't there too.
    push: turns spark.sql.python.filterPushdown.enabled on, which must then stay on while the format is used; without it all files are opened.
    """
    ship(spark)
    if push:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    word = name

    class Facts(DataSource):
        @classmethod
        def name(cls) -> str:
            return word

        def schema(self) -> str:
            return FACT

        def reader(self, schema) -> DataSourceReader:
            paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
            return (PushingReader if push else FactsReader)(paths, readers, extract)

    spark.dataSource.register(Facts)
