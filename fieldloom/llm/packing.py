"""Sum-of-squares online packing of documents into token windows.

A document's ids end with an end id.  Its first pieces fill windows of their own;
the last, shorter one goes to the fill level that leaves the least sum over
levels of the squared number of windows partly filled to that level.  An array
of those numbers is all the state the choice needs.  Each task packs the
documents it reads, one pass, in their order; its windows are numbered within
the task, so nothing is shuffled.  Windows still partly filled when a task's
documents end are poured together, fullest first, cutting where one is full, so
a task leaves one padded window at most.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import table
from fieldloom.llm.memory import tidy
from fieldloom.llm.tokens import default_vocabulary, encoder

WINDOW, END = 1024, 0
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Windows of one size, filled online; ``place`` returns (window, offset)."""

    def __init__(self, size: int):
        self.size, self.made = size, 0
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """Room for ``length`` units, 1 to ``size``; ties go to the fullest level."""
        room = self.size - length
        gain = np.where(self.count[: room + 1] > 0, 1 - 2 * self.count[: room + 1], 2**40)
        gain[0] = 0
        after = 2 * self.count[length : self.size + 1] + 1
        after[room] = 0  # a full window is no longer counted
        cost = gain + after
        level = room - int(np.argmin(cost[::-1]))
        if level:
            window = self.windows[level].pop()
            self.count[level] -= 1
        else:
            window = self.made
            self.made += 1
        if level + length < self.size:
            self.windows[level + length].append(window)
            self.count[level + length] += 1
        return window, level

    def padding(self) -> int:
        return int((self.count * (self.size - np.arange(self.size + 1))).sum())


def _pack(vocabulary: str, window: int, end_id: int, cached: int | None):
    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(vocabulary, cached).encode, SumOfSquares(window)
        base = TaskContext.get().partitionId() << 36
        end = struct.pack("<I", end_id)
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        #: Pieces of the windows that are not full: (doc_id, start, ids, doc_tokens) in order of offset.
        waiting: dict[int, list[tuple]] = {}

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        def rows_of(at: int, pieces: list[tuple]) -> Iterator[tuple]:
            offset = 0
            for doc_id, start, ids, n in pieces:
                yield doc_id, start, len(ids) // 4, zlib.crc32(ids), n, base + at, offset
                offset += len(ids) // 4

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    at, offset = packer.place(length)
                    pieces = waiting.setdefault(at, [])
                    pieces.append((doc_id, start, ids[4 * start : 4 * (start + length)], n))
                    if offset + length == window:
                        rows += rows_of(at, waiting.pop(at))
            yield batch_of(rows)
        rows, pieces, held = [], [], 0
        numbers = sorted(waiting)
        for at in sorted(waiting, key=lambda k: (-sum(len(p[2]) for p in waiting[k]), k)):
            for doc_id, start, ids, n in waiting[at]:
                while ids:
                    part, ids = ids[: 4 * (window - held)], ids[4 * (window - held) :]
                    pieces.append((doc_id, start, part, n))
                    start, held = start + len(part) // 4, held + len(part) // 4
                    if held == window:
                        rows += rows_of(numbers.pop(0), pieces)
                        pieces, held = [], 0
        if pieces:
            rows += rows_of(numbers.pop(0), pieces)
        yield batch_of(rows)

    return pack


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END, cached: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of ``docs`` is a document, also where doc_ids repeat or are null;
    a null or empty text has the end id alone.  Windows hold at most ``window``
    ids and fill from offset 0 without gaps.  Other columns are ignored.
    ``cached`` bounds the words whose ids a worker keeps, not the result.
    """

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack(vocabulary or default_vocabulary(), window, end_id, cached), _SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
