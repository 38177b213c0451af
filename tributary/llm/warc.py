"""WARC archives of pages, written and read by way of a table of chunks.

A payload travels as rows (record, chunk number, bytes), so neither side holds a whole record: the writer copies
chunk after chunk, the reader parses the archive as a stream. Each chunk that is read carries the digest of the
payload up to its end; the last one's is the payload's.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import checked_broadcast, durable, new_folder, small_batches
from tributary.llm.token_files import filesystem

#: Bytes of a chunk.
CHUNK = 1 << 18
#: Pages of one payload that one task looks at; payloads of more, of which there are few, whose number is looked up by broadcast.
PART, LOOKUPS = 20_000, 300_000
#: Rows of a batch of chunks.
CHUNKS = 100
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record_id(page: int | None, part: str) -> str:
    """A URI of the page's number, or of the place of the record where it has none."""
    return f"<urn:page:{page}>" if page is not None else f"<urn:page:none:{part}>"


def base32_of_hex(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def payload(html: str) -> Column:
    return F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")


def originals(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: int = 0) -> DataFrame:
    """(revisit, same, refers_to): the id and the payload's digest of each page whose payload, of at least so many bytes, a page of smaller id has as well.

    The first page of each payload comes from an aggregation that combines before its shuffle. Pages of one payload, all
    empty ones for instance, are dealt to as many tasks as their number asks for.
    """
    each = durable(pages.select(F.col(page_id).cast("long").alias("page"), F.sha1(payload(html)).alias("digest"), F.octet_length(payload(html)).alias("size")))
    firsts = each.where(f"size >= {least}").groupBy("digest").agg(F.min("page").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    firsts = durable(firsts.withColumn("cuts", F.ceil(F.col("n") / PART).cast("int")))
    hot = firsts.where("cuts > 1").select(F.col("digest").alias("hot"), F.col("cuts").alias("many"))
    salted = each.where(f"size >= {least}").join(checked_broadcast(hot, LOOKUPS), F.col("digest") == F.col("hot"), "left")
    salted = salted.select("page", "digest", F.pmod(F.xxhash64("page"), F.coalesce("many", F.lit(1)).cast("long")).cast("int").alias("salt"))
    firsts = firsts.select("digest", "refers_to", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("salt"))
    return salted.join(firsts, ["digest", "salt"]).where("page > refers_to").select(F.col("page").alias("revisit"), F.col("digest").alias("same"), "refers_to").distinct()


def chunk_table(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """(page, url, refers_to, size, digest, chunk, data): the rows of each record; a revisit has one without data.

    Of equal payloads the page of the smallest id is a response, as are rows that share its id, the others revisit it; a null
    id is always a response.
    """
    first = originals(pages, page_id, html, least)
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).cast("string").alias("url"), payload(html).alias("body"))
    rows = rows.withColumns({"size": F.octet_length("body").cast("long"), "digest": F.sha1("body")})
    rows = rows.join(first, (rows["page"] == first["revisit"]) & (rows["digest"] == first["same"]), "left")
    n = F.when(F.col("refers_to").isNotNull(), F.lit(0)).otherwise(F.ceil(F.col("size") / CHUNK)).cast("int")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))))
    data = F.when(n > 0, F.substring(F.col("body"), F.col("chunk") * CHUNK + 1, F.lit(CHUNK)))  # cut as the rows are made: no array of chunks is held
    return rows.select("page", "url", "refers_to", "size", "digest", "chunk", data.alias("data"))


class Archive:
    """An archive of gzip members, one a record, that appears under its name when it is complete."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.draft, compression=None, buffer_size=1 << 20)
        self.member = None

    def begin(self, headers: list[tuple[str, str]], block: bytes, rest: int) -> None:
        """The head of a record whose block is these bytes and rest more."""
        self.member = zlib.compressobj(3, zlib.DEFLATED, 31)
        head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block) + rest))])
        self.out.write(self.member.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block))

    def write(self, data: bytes) -> None:
        self.out.write(self.member.compress(data))

    def end(self) -> None:
        self.out.write(self.member.compress(b"\r\n\r\n") + self.member.flush())

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.draft, self.path)


def write_archives(chunks: DataFrame, folder: str) -> list[tuple[str, int]]:
    """Writes a chunk table to archives below folder, one a partition; returns (file, records) of each. The chunks of a record come one after another.

    The digest of a payload grows with its chunks and must come to what the record's head says. White space in an address is made single spaces, a null one is empty.
    """
    small_batches(chunks.sparkSession, CHUNKS)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        file, out, n = f"{folder}/part-{part:06d}.warc.gz", None, 0
        said, sha = None, hashlib.sha1()

        def check(said: str | None, sha) -> None:
            if said is not None and sha.hexdigest() != said:
                raise ValueError(f"the chunks of a record don't make its payload: {said}")

        for batch in batches:
            ids, refers = batch["page"].astype("Int64").tolist(), batch["refers_to"].astype("Int64").tolist()
            for page, to, url, size, digest, chunk, data in zip(ids, refers, batch["url"].tolist(), batch["size"].tolist(), batch["digest"].tolist(), batch["chunk"].tolist(), batch["data"].tolist()):
                page, to = (None if x is pd.NA else int(x) for x in (page, to))
                if out is None:
                    out = Archive(file)
                if chunk == 0:
                    if n:
                        out.end()
                        check(said, sha)
                    said, sha = digest if to is None else None, hashlib.sha1()
                    http = HTTP % size
                    clean = "" if url is None else " ".join(url.split())
                    headers = [("WARC-Type", "response" if to is None else "revisit"), ("WARC-Record-ID", record_id(page, f"{part}-{n}")), ("WARC-Date", DATE), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha1:{base32_of_hex(digest)}"), ("Content-Type", "application/http; msgtype=response")]
                    if to is not None:
                        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(to, ""))]
                    out.begin(headers, http, size if to is None else 0)
                    n += 1
                if data is not None:
                    out.write(bytes(data))
                    sha.update(data)
        if out:
            out.end()
            check(said, sha)
            out.close()
            yield pd.DataFrame({"file": [file], "records": [n]})

    made = chunks.mapInPandas(write, "file string, records long").collect()
    return sorted((r["file"], r["records"]) for r in made)


class Stream:
    """The inflated bytes of an archive, a piece at a time."""

    def __init__(self, uri: str) -> None:
        fs, path = filesystem(uri)
        self.file = fs.open_input_stream(path, compression=None, buffer_size=1 << 20)
        self.inflate, self.held, self.over = zlib.decompressobj(31), b"", False
        self.raw = b""

    def more(self) -> bool:
        while not self.over:
            if self.inflate.eof:
                self.raw = self.inflate.unused_data or self.raw
                self.inflate = zlib.decompressobj(31)
            else:
                self.raw = self.inflate.unconsumed_tail or self.raw
            if not self.raw:
                self.raw = self.file.read(1 << 18)
                if not self.raw:
                    self.over = True
                    break
            raw, self.raw = self.raw, b""
            if got := self.inflate.decompress(raw, CHUNK):
                self.held += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark, which goes too; None at the end."""
        while (i := self.held.find(mark)) < 0:
            if not self.more():
                return None
        out, self.held = self.held[:i], self.held[i + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        """The next bytes, n at most and one at least."""
        while not self.held and self.more():
            pass
        out, self.held = self.held[:n], self.held[n:]
        if not out:
            raise ValueError("the archive ends within a record")
        return out

    def close(self) -> None:
        self.file.close()


def headers_of(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


CHUNK_ROW = "record_id string, url string, record_type string, refers_to string, payload_bytes long, header_digest string, chunk long, start long, read long, data binary, digest_so_far string, last boolean"


def records(uri: str, with_data: bool = True) -> Iterator[tuple]:
    """The chunk rows of an archive. start, read: where a chunk begins, and its bytes. digest_so_far is that of the payload up to the chunk's end; the last row of a revisit or of an empty payload has no data."""
    s = Stream(uri)
    while (head := s.until(b"\r\n\r\n")) is not None:
        h = headers_of(head)
        http = s.until(b"\r\n\r\n")
        size = int(headers_of(http)["content-length"])
        left = int(h["content-length"]) - len(http) - 4
        same = (h["warc-record-id"], h.get("warc-target-uri"), h["warc-type"], h.get("warc-refers-to"), size, h.get("warc-payload-digest", "").removeprefix("sha1:"))
        sha, k, start = hashlib.sha1(), 0, 0
        while left:
            data = s.take(min(left, CHUNK))
            sha.update(data)
            left -= len(data)
            yield (*same, k, start, len(data), data if with_data else None, base64.b32encode(sha.copy().digest()).decode(), not left)
            k, start = k + 1, start + len(data)
        if not k:
            yield (*same, 0, 0, 0, None, base64.b32encode(sha.digest()).decode(), True)
        s.until(b"\r\n\r\n")
    s.close()


def read_archives(spark: SparkSession, files: list[tuple[str, int]], with_data: bool = True) -> DataFrame:
    """The chunk table of the archives, read as streams; without data where only digests are asked for."""
    columns = [x.split()[0] for x in CHUNK_ROW.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch["file"].tolist():
                held = []
                for row in records(file, with_data):
                    held.append(row)
                    if len(held) >= (CHUNKS if with_data else 5000):
                        yield pd.DataFrame(held, columns=columns)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=columns)

    if not files:
        return spark.createDataFrame([], CHUNK_ROW)
    return spark.createDataFrame([(f,) for f, _ in files], "file string").repartition(min(len(files), 20_000)).mapInPandas(read, CHUNK_ROW)


def page_of(uri: str) -> Column:
    return F.regexp_extract(uri, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def archive_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes pages to new archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to of each.

    A response's size and digest are those of the payload that was read, a revisit's those of its headers. Null html is an empty
    payload; equal rows of one id are all responses or all revisits; null ids are responses. A payload of any length travels in chunks.
    An empty table gives no archive and no rows. Columns other than the three are not read, whatever their names.
    """
    spark = pages.sparkSession
    files = write_archives(chunk_table(pages, page_id, url, html), new_folder(spark, "warc"))
    rows = read_archives(spark, files, with_data=False).where("last")
    digest = F.when(F.col("record_type") == "revisit", F.col("header_digest")).otherwise(F.col("digest_so_far"))
    size = F.when(F.col("record_type") == "revisit", F.col("payload_bytes")).otherwise(F.col("start") + F.col("read"))
    return rows.select(page_of("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", page_of("refers_to").alias("refers_to"))
