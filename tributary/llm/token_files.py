"""Token files: one array of ids after another, document boundaries in an Elias-Fano code.

File format, little endian, read from its end:

    ids         unsigned 16 or 32 bit integers, all documents in turn, each with its end id
    boundaries  an Elias-Fano code of the starts and the end
    doc ids     an Elias-Fano code of doc id minus the least one; documents of null id come first and have none
    trailer     magic, bytes of an id, number of documents, of those with an id, the least and the largest doc id, number of ids

An Elias-Fano code of n numbers up to ``top``:

    low bits    ``low`` bits of each number
    high bits   in unary: number i sets bit (number >> low) + i
    samples     uint64 each: the place of every 64th bit that is set in the high bits

A number takes about 2 + log2(top / n) bits, where a table would take 64.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import new_folder, small_batches
from tributary.llm.tokens import encoder

MAGIC = b"TRIBTOK2"
TRAILER = struct.Struct("<8sBQQqqQ")
SAMPLE = 64
#: Numbers that are coded at once; a multiple of eight.
PART = 1 << 16
#: Ids that are read at once.
BLOCK = 1 << 21
#: Documents whose boundaries are decoded at once.
RUN = 1 << 14


class EliasFano:
    """A sequence of numbers that never fall, up to ``top``."""

    def __init__(self, n: int, low: int, low_bits: np.ndarray, high_bits: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low, self.low_bits, self.high_bits, self.samples = n, low, low_bits, high_bits, samples

    @staticmethod
    def low_width(n: int, top: int) -> int:
        return max(0, (top // max(n, 1)).bit_length() - 1)

    @classmethod
    def sizes(cls, n: int, top: int) -> tuple[int, int, int]:
        """Bytes of low bits, high bits and samples."""
        low = cls.low_width(n, top)
        return (n * low + 7) // 8, (n + (top >> low) + 1 + 7) // 8, 8 * ((n + SAMPLE - 1) // SAMPLE)

    @classmethod
    def of(cls, values: np.ndarray, top: int) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, low = len(values), cls.low_width(len(values), top)
        parts = [np.zeros(0, dtype=np.uint8)]
        for i in range(0, n if low else 0, PART):
            bits = np.unpackbits(values[i : i + PART].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            parts.append(np.packbits(bits[:, :low].ravel(), bitorder="little"))
        places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros(cls.sizes(n, top)[1], dtype=np.uint8)
        np.bitwise_or.at(high, places // 8, (1 << (places % 8)).astype(np.uint8))
        return cls(n, low, np.concatenate(parts), high, places[::SAMPLE].astype("<u8"))

    def select(self, i: int) -> int:
        """Value i, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        ahead = np.unpackbits(self.high_bits[byte : byte + 1], bitorder="little")
        ahead[: at % 8] = 0
        while left >= (ones := int(ahead.sum())):
            left -= ones
            byte += 1
            ahead = np.unpackbits(self.high_bits[byte : byte + 1], bitorder="little")
        place = 8 * byte + int(np.flatnonzero(ahead)[left])
        return (place - i) << self.low | self._low(i)

    def _low(self, i: int) -> int:
        first = i * self.low
        part = int.from_bytes(self.low_bits[first // 8 : (first + self.low + 7) // 8].tobytes(), "little")
        return part >> (first % 8) & ((1 << self.low) - 1)

    def some(self, i: int, k: int) -> np.ndarray:
        """Values i to i + k, unsigned: select for a run of them, from the nearest sample on. Memory is that of the run and of the high bits that it spans."""
        k = max(0, min(k, self.n - i))
        if not k:
            return np.zeros(0, dtype=np.uint64)
        byte, skip = int(self.samples[i // SAMPLE]) // 8, i % SAMPLE
        after = (i + k - 1) // SAMPLE + 1  # the sample behind the run
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high_bits)
        ones = np.flatnonzero(np.unpackbits(self.high_bits[byte:end], bitorder="little")) + 8 * byte
        ones = ones[np.searchsorted(ones, int(self.samples[i // SAMPLE])) + skip :][:k]
        out = (ones - np.arange(i, i + k)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            first = i * self.low
            found = np.unpackbits(self.low_bits[first // 8 : (first + k * self.low + 7) // 8], bitorder="little")[first % 8 :][: k * self.low]
            bits = np.zeros((k, 64), dtype=np.uint8)
            bits[:, : self.low] = found.reshape(k, self.low)
            out |= np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
        return out

    @classmethod
    def read(cls, file, at: int, n: int, top: int) -> tuple[EliasFano, int]:
        """The code that begins at a place of a file, and where it ends."""
        parts = []
        for size in cls.sizes(n, top):
            parts.append(np.frombuffer(file.read_at(size, at), dtype=np.uint8))
            at += size
        return cls(n, cls.low_width(n, top), parts[0], parts[1], parts[2].view("<u8")), at

    def tobytes(self) -> bytes:
        return self.low_bits.tobytes() + self.high_bits.tobytes() + self.samples.tobytes()


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """Appends documents to a file that appears under its name only when it is complete."""

    def __init__(self, uri: str, dtype: np.dtype) -> None:
        self.fs, self.path = filesystem(uri)
        self.dtype, self.ids, self.starts, self.total = dtype, array("q"), array("q", [0]), 0
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.draft, compression=None, buffer_size=1 << 20)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.total += len(ids) // self.dtype.itemsize
        if doc_id is not None:
            self.ids.append(doc_id)
        self.starts.append(self.total)

    @property
    def docs(self) -> int:
        return len(self.starts) - 1

    def close(self) -> None:
        known = np.array(self.ids, dtype=np.int64)
        least, most = (int(known[0]), int(known[-1])) if len(known) else (0, 0)
        self.out.write(EliasFano.of(np.array(self.starts, dtype=np.int64), self.total).tobytes())
        self.out.write(EliasFano.of(known.view(np.uint64) - np.uint64(least % (1 << 64)), most - least).tobytes())
        self.out.write(TRAILER.pack(MAGIC, self.dtype.itemsize, self.docs, len(known), least, most, self.total))
        self.out.close()
        self.fs.move(self.draft, self.path)


class Reader:
    """A file of Writer's: starts and doc ids of any run of documents, and the ids of any document. The codes stay as they are, nothing is expanded for all documents."""

    def __init__(self, uri: str) -> None:
        self.fs, path = filesystem(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        magic, width, self.n, known, self.least, most, self.total = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.dtype, self.nulls = np.dtype(f"<u{width}"), self.n - known
        self.bounds, at = EliasFano.read(self.file, self.total * width, self.n + 1, self.total)
        self.names, _ = EliasFano.read(self.file, at, known, most - self.least)

    def doc_ids(self, i: int, k: int) -> list[int | None]:
        """Those of documents i to i + k, None for null."""
        k = max(0, min(k, self.n - i))
        nulls = max(0, min(k, self.nulls - i))
        return [None] * nulls + [x + self.least for x in self.names.some(i + nulls - self.nulls, k - nulls).tolist()]

    def starts(self, i: int, k: int) -> np.ndarray:
        """Where documents i to i + k begin and the last of them ends, k + 1 numbers."""
        return self.bounds.some(i, k + 1).astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))

    def ids(self, start: int, end: int) -> np.ndarray:
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((end - start) * width, start * width), dtype=self.dtype)

    def close(self) -> None:
        self.file.close()


def crc32(ids: np.ndarray, crc: int = 0) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes(), crc)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int, int]]:
    """Writes all documents to files below folder, in ascending doc_id order from file to file and within each.

    Returns (file, documents, ids) of each file in that order, a row for each partition. A null text is
    an empty one and has the end id alone; null ids come first; documents of equal ids go by their text's hash.
    Rows of one id, or of none, may be cut into several files by the hash of their text; equal rows each have their own place.
    A task that runs again writes the same file again. An empty table gives no files. Other columns are not read, whatever their names.
    A long text is encoded in stretches, so a task holds a batch of texts, their ids and a number a document.
    folder is a URI that the executors can open, as one in the shared folder.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use, number, out = encoder(vocabulary), TaskContext.get().partitionId(), None
        end = np.array([end_id], dtype=use.dtype).tobytes()
        for batch in batches:
            for key, ids in zip(batch["doc_id"].astype("Int64").tolist(), use.encode_all(batch["text"].tolist())):
                out = out or Writer(f"{folder}/part-{number:06d}.tok", use.dtype)
                out.add(None if key is pd.NA else int(key), ids + end)
        if out:
            out.close()
            yield pd.DataFrame({"number": [number], "file": [f"{folder}/part-{number:06d}.tok"], "docs": [out.docs], "ids": [out.total]})

    made = rows.mapInPandas(write, "number long, file string, docs long, ids long").collect()
    return [(r["file"], r["docs"], r["ids"]) for r in sorted(made, key=lambda r: r["number"])]


def read_token_files(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document in the files, in their order."""
    rows, start = [], 0
    for file, _, n in files:
        rows.append((file, start))
        start += n
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder.cache_clear()  # writing is through
        for batch in batches:
            for file, base in zip(batch["file"].tolist(), batch["start"].tolist()):
                r = Reader(file)
                i = 0
                while i < r.n:  # as many of the next documents as a block of ids holds, one at least
                    bounds = r.starts(i, min(RUN, r.n - i))
                    k = max(1, int(np.searchsorted(bounds, bounds[0] + BLOCK, side="right")) - 1)
                    bounds = bounds[: k + 1]
                    ids = r.ids(int(bounds[0]), int(bounds[-1]))
                    crcs = [crc32(ids[a:b]) for a, b in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0])]
                    yield pd.DataFrame({"doc_id": pd.array(r.doc_ids(i, k), dtype="Int64"), "start": bounds[:-1] + base, "n_tokens": np.diff(bounds), "ids_crc32": crcs})
                    i += k
                r.close()

    return spark.createDataFrame(rows, "file string, start long").repartition(min(len(rows), 20_000)).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Writes docs into a new shared folder and reads the files back."""
    files = write_token_files(docs, new_folder(docs.sparkSession, "tokens"), vocabulary, end_id)
    return read_token_files(docs.sparkSession, files)
