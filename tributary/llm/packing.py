"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n``, as attention does. Pieces in descending
order go to the sequence of least cost that has room; what fits nowhere is cut to fill what is free.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import small_batches
from tributary.llm.tokens import encoder

#: Tokens that are packed together. Less than a sequence of padding comes with each such window.
WINDOW = 1 << 22
#: Costs of a token, and of a pair of tokens: for a model of width 4096, attention outweighs the rest beyond 12 * 4096 tokens.
LINEAR, QUADRATIC = 1.0, 1.0 / (12 * 4096)

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; there are as few sequences as can be."""
    pieces: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []
    n = 0
    for d, total in enumerate(lengths):
        full = total // capacity
        for k in range(full):
            pieces.append((d, k * capacity, capacity, n, 0))
            n += 1
        if total % capacity:
            rest.append((total % capacity, d, full * capacity))
    bins = -(-sum(x for x, _, _ in rest) // capacity)
    used = [0] * bins
    heap: list[tuple[float, int]] = [(0.0, b) for b in range(bins)]

    def put(length: int, d: int, start: int, b: int) -> float:
        pieces.append((d, start, length, n + b, used[b]))
        used[b] += length
        return linear * length + quadratic * length * length

    over: list[tuple[int, int, int]] = []
    for length, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        passed: list[tuple[float, int]] = []
        while heap and used[heap[0][1]] + length > capacity:
            passed.append(heapq.heappop(heap))
        if heap:
            cost, b = heap[0]
            heapq.heapreplace(heap, (cost + put(length, d, start, b), b))
        else:
            over.append((length, d, start))
        for x in passed:
            if used[x[1]] < capacity:
                heapq.heappush(heap, x)
    for length, d, start in over:
        while length:
            cost, b = heapq.heappop(heap)
            part = min(length, capacity - used[b])
            cost += put(part, d, start, b)
            if used[b] < capacity:
                heapq.heappush(heap, (cost, b))
            length, start = length - part, start + part
    return pieces


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 4096, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each partition packs its own documents, a window of tokens at a time, so nothing is shuffled and a
    task holds no more than a window, a batch of texts and their ids. Which documents share a sequence therefore follows from how
    the input is split. Among pieces of one length the earlier document's comes first, among sequences of one cost the earlier.
    A text of any length is encoded in stretches and cut into full sequences and a rest. Equal rows are packed each for itself; null
    texts are empty, and an empty text is its end id; a null id stays null. No rows, no pieces. Other columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = encoder(vocabulary)
        end, width = np.array([end_id], dtype=use.dtype).tobytes(), use.dtype.itemsize
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def packed() -> pd.DataFrame:
            nonlocal number, size
            out = []
            for d, start, length, seq, offset in pack([len(b) // width for _, b in held], capacity):
                key, ids = held[d]
                crc = zlib.crc32(np.frombuffer(ids, use.dtype, length, start * width).astype("<u4").tobytes())
                out.append((key, start, length, crc, len(ids) // width, number + seq, offset))
            number = max((x[5] for x in out), default=number - 1) + 1
            held.clear()
            size = 0
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])
            return frame.astype({"doc_id": "Int64"})

        for batch in batches:
            for key, ids in zip(batch["doc_id"].astype("Int64").tolist(), use.encode_all(batch["text"].tolist())):
                held.append((key, ids + end))
                size += len(held[-1][1]) // width
                if size >= window:
                    yield packed()
        if held:
            yield packed()

    return rows.mapInPandas(run, SCHEMA)
