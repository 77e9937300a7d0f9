"""Token ids in Arrow IPC files of equal-length sequences.

A shard is two files of the Arrow random-access format.  ``*.ids.arrow`` has the
columns ``ids`` (fixed-size list of uint16, or of uint32 where the vocabulary has
more than 65,536 ids) and ``mask`` (fixed-size list of uint8, eight positions a
byte, least significant bit first: set where an id stands, clear where the last
sequence is padded); every record batch but the last holds BATCH sequences, so
sequence i is found by division and read as a view of the mapped file.  ``*.docs.arrow`` has one row per document:
doc_id, start (ids before it within the shard) and n_tokens.

Shards hold ascending ranges of doc_id.  Tasks write under names of their own and
return them; only names that a committed task returned are read, so a lost or
repeated task leaves no trace in the data.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow.fs import LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import cut, fresh_path, table
from fieldloom.llm.files import open_store
from fieldloom.llm.memory import tidy
from fieldloom.llm.tokens import default_vocabulary, encoder

LENGTH, BATCH, END = 1024, 256, 2
_SHARD = "shard long, path string, n_docs long, n_tokens long"


def _ids_schema(length: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.uint8(), length // 8))])


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    """Appends documents to a shard; holds at most BATCH sequences besides one document."""

    def __init__(self, path: str, length: int = LENGTH, wide: bool = True):
        if length % 8:
            raise ValueError("the sequence length must be a multiple of 8")
        files, at = open_store(path)
        files.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.length, self.held, self.size, self.start, self.n_docs = length, [], 0, 0, 0
        self.out = [files.open_output_stream(at + end) for end in (".ids.arrow", ".docs.arrow")]
        self.schema = _ids_schema(length, wide)
        self.ids = pa.ipc.new_file(self.out[0], self.schema)
        self.docs = pa.ipc.new_file(self.out[1], _DOCS)

    def _flush(self, last: bool) -> None:
        data, unit = np.frombuffer(b"".join(self.held), "<u4"), self.length * BATCH
        whole = len(data) if last else len(data) // unit * unit
        for at in range(0, whole, unit):
            part = data[at : min(whole, at + unit)]
            rows = -(-len(part) // self.length)
            ids = np.zeros(rows * self.length, self.schema.field("ids").type.value_type.to_pandas_dtype())
            ids[: len(part)] = part
            mask = np.packbits(np.arange(len(ids)) < len(part), bitorder="little")
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), f.type.list_size) for x, f in zip((ids, mask), self.schema, strict=True)]
            self.ids.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.held = [data[whole:].tobytes()]
        self.size = len(data) - whole

    def add(self, doc_ids: list, texts_ids: list[bytes]) -> None:
        lengths = np.array([len(x) // 4 for x in texts_ids], dtype=np.int64)
        starts = self.start + np.cumsum(lengths) - lengths
        self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(lengths)], schema=_DOCS))
        for x in texts_ids:
            self.held.append(x)
            self.size += len(x) // 4
            if self.size >= self.length * BATCH:
                self._flush(False)
        self.start += int(lengths.sum())
        self.n_docs += len(doc_ids)

    def close(self) -> None:
        self._flush(True)
        for x in (self.ids, self.docs, *self.out):
            x.close()


class Shard:
    """Random access to a shard's sequences and documents."""

    def __init__(self, path: str):
        files, at = open_store(path)
        local = isinstance(files, LocalFileSystem)
        opened = [pa.memory_map(at + end) if local else files.open_input_file(at + end) for end in (".ids.arrow", ".docs.arrow")]
        self.ids, self.docs = (pa.ipc.open_file(f) for f in opened)
        self.length = self.ids.schema.field("ids").type.list_size

    def _values(self, batch: int) -> tuple[np.ndarray, np.ndarray]:
        found = self.ids.get_batch(batch)
        return tuple(found.column(k).values.to_numpy(zero_copy_only=True) for k in (0, 1))

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and packed mask of sequence ``i`` as views of the file's memory."""
        ids, mask = self._values(i // BATCH)
        at, bits = i % BATCH * self.length, self.length // 8
        return ids[at : at + self.length], mask[at // 8 : at // 8 + bits]

    def documents(self) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
        """Batches of the document index with each document's ids, read one record batch at a time."""
        batch, held, at = -1, b"", 0  # documents follow one another without gaps
        for k in range(self.docs.num_record_batches):
            index, out = self.docs.get_batch(k), []
            for n in index.column(2).to_pylist():
                parts, missing = [held[at : at + 4 * n]], 4 * n
                at += len(parts[0])
                while missing := missing - len(parts[-1]):
                    batch += 1
                    ids, mask = self._values(batch)
                    held = ids[: int(np.bitwise_count(mask).sum())].astype("<u4").tobytes()
                    at = min(missing, len(held))
                    parts.append(held[:at])
                out.append(b"".join(parts))
            yield index, out


def _write(path: str, vocabulary: str, end_id: int, length: int):
    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, writer = encoder(vocabulary).encode, struct.pack("<I", end_id), None
        wide = max(encoder(vocabulary).tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        shard = TaskContext.get().partitionId()
        name = f"{path}/shard-{shard:07d}-{uuid.uuid4().hex}"
        for batch in batches:
            writer = writer or ShardWriter(name, length, wide)
            ids = encode(batch.column(1))
            for at in range(0, len(batch), 512):
                doc_ids = batch.column(0).slice(at, 512).to_pylist()
                writer.add(doc_ids, [x + end for x in islice(ids, len(doc_ids))])
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": name, "n_docs": writer.n_docs, "n_tokens": writer.start}])

    return write


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END, length: int = LENGTH) -> DataFrame:
    """Write all rows of ``docs`` in ascending doc_id order below ``path``; returns the shards written.

    Null doc_ids come first, rows of one doc_id in an order of their own; a null
    or empty text has the end id alone.  Other columns are ignored, and an empty
    table gives no shard.  Rows: shard, path, n_docs, n_tokens, base (ids in the
    shards before it).
    """
    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    shards = cut(ordered.mapInArrow(_write(path, vocabulary or default_vocabulary(), end_id, length), _SHARD), "shards")
    rows, base = [], 0
    for r in shards.orderBy("shard").toLocalIterator():  # a row a file
        rows.append((r["shard"], r["path"], r["n_docs"], r["n_tokens"], base))
        base += r["n_tokens"]
    return spark.createDataFrame(rows, _SHARD + ", base long").repartition(max(1, len(rows)))


@tidy
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for index, ids in Shard(path).documents():
                crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                starts = pa.array(index.column(1).to_numpy() + base)
                yield pa.RecordBatch.from_arrays([index.column(0), starts, n, crc], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(shards: DataFrame) -> DataFrame:
    """One row per document of the shards' files: doc_id, start (over all shards), n_tokens, ids_crc32."""
    return shards.select("path", "base").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), fresh_path(spark, "tokens")))


QUERIES = {"op10_token_output": op10_token_output}
ORACLES: dict[str, str] = {}
