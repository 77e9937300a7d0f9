"""WARC archives: writing, and reading with boundary-chain verification.

Writing: every page becomes a record.  Of equal payloads the one with the least
page_id is a ``response`` with its payload, the others are ``revisit`` records
that name it and carry the payload's digest and length.  Tasks write files of
their own and return their names; only names from committed tasks are read.

Reading: files are cut into blocks.  A task looks for record beginnings in its
block (line starts that begin with the version) and parses each one's header,
which gives the offset of the record that must follow: a candidate edge
``offset -> successor``.  Payloads may hold the same bytes, so some candidates
are false.  Within its block a task jumps pointers (offset to successor, then to
successor's successor, and so on) until each candidate knows where its chain
leaves the block; the blocks' exits are then followed from the file's start,
again by pointer jumping over the table of block entries, and only candidates
that are reachable this way are records.

A chain that ends before its file does has met damage.  Reading then goes on at
the next candidate whose own chain ends well, at the end of the file or at what
begins like a record but is none (the next damage); bytes that no record covers
are reported in rows of type ``damaged``, never passed over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import cut, fresh_path, table
from fieldloom.llm.files import open_store
from fieldloom.llm.memory import tidy

VERSION = b"WARC/1.1"
#: Bytes of a file that one task scans for record beginnings, and from which a task begins another file.
BLOCK, FILE = 16 << 20, 256 << 20
_FIELD = re.compile(rb"[^\s:]{1,128}[ \t]*:")
_START = re.compile(rb"(?:\A|(?<=\n))WARC/1\.[01]\r\n")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
_ORIGIN = "urn:uuid:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<{_ORIGIN}{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record's bytes; ``first``: page_id of the response that a revisit stands for, or None for a response."""
    head = [
        VERSION.decode(), f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 2026-01-01T00:00:00Z", f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', '%20', url or 'about:blank')}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"WARC-X-Page-ID: {page_id}")
    body = payload
    if first is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_id(first)}", f"WARC-X-Refers-To-Page: {first}"]
        body = b""
    head += [f"Content-Length: {len(body)}", "Content-Type: text/html"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def header_goes_on(data: bytes) -> bool:
    """Whether ``data``, cut off before a header's end, may begin one: every line after the first begins with a field's name."""
    *lines, last = data.split(b"\r\n")[1:] or [b""]
    return all(map(_FIELD.match, lines)) and (len(last) <= 128 or _FIELD.match(last) is not None)


def parse_header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Fields of the header at ``at`` and where the body begins; None unless well-formed."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if fields.get("content-length", "").isdigit() else None


def _write(path: str):
    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_store(path)
        files.create_dir(root, recursive=True)
        task, out, name, size, made = TaskContext.get().partitionId(), None, "", 0, []
        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(k) for k in range(4)), strict=True):
                if out is None:
                    name = f"part-{task:07d}-{uuid.uuid4().hex}.warc"
                    out, size = files.open_output_stream(f"{root}/{name}"), 0
                payload = (html.as_py() or "").encode()
                data = record(page_id.as_py(), url.as_py(), payload, payload_digest(payload), first.as_py())
                out.write(data)
                size += len(data)
                if size >= FILE:
                    out.close()
                    made, out = [*made, (f"{path}/{name}", size)], None
        if out is not None:
            out.close()
            made.append((f"{path}/{name}", size))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], ["file", "size"])

    return write


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns the files: file, size.

    Null html is an empty payload.  Equal payloads (by SHA-256) have one
    response, the least page_id; null page_ids come last, and rows that tie on
    page_id are all responses.  A response of null page_id has only responses
    beside it.
    """
    slim = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("sha"))
    firsts = cut(slim.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first"), "firsts")
    marked = slim.join(firsts, "sha", "left").select("page_id", "url", "html", F.when(F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull() & F.col("page_id").isNull()), F.col("first")).alias("first"))
    return cut(marked.mapInArrow(_write(path), "file string, size long"), "archives")


class _Reader:
    """Reads of one file by offset, in pieces as large as asked for."""

    def __init__(self, uri: str):
        files, at = open_store(uri)
        self.file = files.open_input_file(at)

    def __enter__(self) -> _Reader:
        return self

    def __exit__(self, *fault) -> None:
        self.file.close()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def header(self, at: int) -> tuple[dict[str, str], int] | None:
        size = 1 << 12
        while True:
            data = self.read(at, size)
            if b"\r\n\r\n" in data or len(data) < size:
                found = parse_header(data, 0)
                return found and (found[0], at + found[1])
            if not header_goes_on(data):
                return None
            size *= 4


def block_candidates(read: _Reader, begin: int, end: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets in [begin, end) where a record may begin, the offset that must follow each (``size`` at the end), and those that only begin like one."""
    lead = 1 if begin else 0
    data = read.read(begin - lead, end - begin + lead + len(VERSION) + 2)
    offsets, follows, broken = [], [], []
    for m in _START.finditer(data):
        at = begin - lead + m.start()
        if not begin <= at < end or (begin and m.start() == 0):
            continue
        head = read.header(at)
        next_at = size + 1 if head is None else head[1] + int(head[0]["content-length"]) + 4
        if next_at <= size and read.read(next_at - 4, 4) == b"\r\n\r\n":
            offsets.append(at)
            follows.append(next_at)
        else:
            broken.append(at)
    return np.array(offsets, np.int64), np.array(follows, np.int64), np.array(broken, np.int64)


def exits(offsets: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Where each candidate's chain first comes to what is no candidate of the block: beyond it, or where it breaks; by pointer jumping."""
    n = len(offsets)
    if not n:
        return follows
    at = np.minimum(np.searchsorted(offsets, follows), n - 1)
    linked = offsets[at] == follows
    out, jump = follows, np.where(linked, at, np.arange(n))
    for _ in range(max(1, n.bit_length())):
        out, jump = out[jump], jump[jump]
    return out


def reached(offsets: np.ndarray, follows: np.ndarray, entry: int) -> np.ndarray:
    """Which candidates the chain from offset ``entry`` visits; by pointer doubling."""
    n = len(offsets)
    seen = np.zeros(n + 1, dtype=bool)
    seen[:n] = offsets == entry
    at = np.minimum(np.searchsorted(offsets, follows), max(0, n - 1))
    jump = np.append(np.where(offsets[at] == follows, at, n), n) if n else np.array([0])
    for _ in range(max(1, n.bit_length())):
        seen[jump[seen]] = True
        jump = jump[jump]
    return seen[:n]


@tidy
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, size, begin, end in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            with _Reader(file) as read:
                offsets, follows, broken = block_candidates(read, begin, end, size)
            leave = pa.concat_arrays([pa.array(exits(offsets, follows)), pa.nulls(len(broken), pa.int64())])
            columns = [pa.array([file] * len(leave), pa.string()), pa.array(np.concatenate([offsets, broken])), leave]
            yield pa.RecordBatch.from_arrays(columns, ["file", "offset", "exit"])


@tidy
def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, size, begin, end, entries in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            with _Reader(file) as read:
                offsets, follows, _ = block_candidates(read, begin, end, size)
                rows = []
                for at in offsets[np.logical_or.reduce([reached(offsets, follows, entry) for entry in entries])].tolist():
                    fields, body = read.header(at)
                    payload = read.read(body, int(fields["content-length"]))
                    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    whole = fields.get("warc-type") != "revisit"
                    number = lambda name: int(fields[name]) if fields.get(name, "").isdigit() else None
                    rows.append({
                        "page_id": number("warc-x-page-id"), "url": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"),
                        "payload_bytes": len(payload) if whole else number("warc-x-payload-length"), "payload_digest": payload_digest(payload) if whole else said,
                        "intact": not whole or payload_digest(payload) == said, "refers_to": number("warc-x-refers-to-page"), "payload": payload if whole else None, "file": file, "offset": at,
                    })
                    if len(rows) == 64:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)


_RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("intact", pa.bool_()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64()),
])
_RECORD_DDL = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, intact boolean, refers_to long, payload binary, file string, offset long"


def _reach(starts: DataFrame, jump: DataFrame) -> DataFrame:
    """All (file, at) that jumps (file, at, next) lead to from ``starts``, those included; by pointer doubling, so in logarithmically many passes."""
    entries, count = cut(starts.distinct(), "entries"), -1
    while True:  # entries so far, and where 1, 2, 4, ... jumps lead
        more = entries.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        grown = cut(entries.union(more).distinct(), "entries")
        held = entries.count() if count < 0 else count
        count = grown.count()
        if count == held:
            return entries
        entries = grown
        onward = jump.select("file", F.col("at").alias("next"), F.col("next").alias("after"))
        jump = cut(jump.join(onward, ["file", "next"]).select("file", "at", F.col("after").alias("next")), "jumps")


def _ends(jump: DataFrame) -> DataFrame:
    """(file, at, end): where the chain of each position of ``jump`` ends; by pointer doubling."""
    ends = cut(jump.select("file", "at", F.col("next").alias("end")), "ends")
    while True:
        onward = ends.select("file", F.col("at").alias("end"), F.col("end").alias("after"))
        if ends.join(onward, ["file", "end"], "left_semi").isEmpty():
            return ends
        ends = cut(ends.join(onward, ["file", "end"], "left").select("file", "at", F.coalesce("after", "end").alias("end")), "ends")


def _resumed(damage: DataFrame, candidates: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where reading goes on after the first ``damage`` (file, at) of each file: the entries, and (file, begin, end) of what is lost.

    Offsets of a damaged file (a row a record) are sorted in one task; undamaged files have no part in this.
    """
    held = cut(candidates.join(damage.select("file").distinct(), "file", "left_semi"), "damaged")
    sizes = files.select("file", "size").distinct()
    jump = held.where("exit is not null").select("file", F.col("offset").alias("at"), F.col("exit").alias("next"))
    ends = _ends(jump)
    like_records = held.where("exit is null").select("file", F.col("offset").alias("end"), F.lit(True).alias("begun"))
    sound = ends.join(sizes, "file").join(like_records, ["file", "end"], "left").where("end = size or begun").select("file", "at", "end")
    stops = damage.union(sound.join(sizes, "file").where("end < size").select("file", F.col("end").alias("at"))).distinct()
    marked = sound.select("file", "at", "end", F.lit(False).alias("stop")).unionByName(stops.select("file", "at", F.lit(None).cast("long").alias("end"), F.lit(True).alias("stop")))
    following = F.last(F.when(~F.col("stop"), F.struct("at", "end")), ignorenulls=True).over(Window.partitionBy("file").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1))
    links = cut(marked.withColumn("then", following).where("stop").select("file", "at", F.col("then")["at"].alias("again"), F.col("then")["end"].alias("next")), "links")
    met = _reach(damage, links.where("next is not null").select("file", "at", "next"))
    lost = links.join(met, ["file", "at"]).join(sizes, "file").select("file", F.col("at").alias("begin"), F.coalesce("again", "size").alias("end"), "again")
    lost = cut(lost, "lost")
    return _reach(lost.where("again is not null").select("file", F.col("again").alias("at")), jump), lost.drop("again")


def read_archives(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """Records of the files (file, size): page_id, url, record_type, payload_bytes, payload_digest, intact, refers_to, payload, file, offset.

    A revisit has its response's payload_bytes and payload_digest and a null
    payload; ``intact`` says that a response's payload has its digest.  Damaged
    headers or lengths, cut-off ends and foreign bytes lose the records they are
    in: each such stretch is a row of type "damaged", not intact, with its offset
    and its length as payload_bytes.  Empty files have no records.
    """
    blocks = files.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("begin"))
    blocks = cut(blocks.select("file", "size", "begin", F.least(F.col("begin") + block, "size").alias("end")), "blocks")
    parts = max(1, blocks.count())
    candidates = cut(blocks.repartition(parts, "file", "begin").mapInArrow(_scan, "file string, offset long, exit long"), "chains")
    starts = files.where("size > 0").select("file", F.lit(0).cast("long").alias("at"))
    known = candidates.where("exit is not null")
    landing = known.select("file", F.col("exit").alias("at")).union(starts).distinct()  # the offsets at which chains enter blocks
    jump = cut(known.select("file", F.col("offset").alias("at"), F.col("exit").alias("next")).join(landing, ["file", "at"], "left_semi"), "jumps")
    entries = _reach(starts, jump)
    broken = entries.join(known.select("file", F.col("offset").alias("at")), ["file", "at"], "left_anti").join(files.select("file", "size").distinct(), "file").where("at < size").select("file", "at")
    broken = cut(broken, "broken")
    lost = None
    if not broken.isEmpty():
        more, lost = _resumed(broken, candidates, files)
        entries = entries.union(more).distinct()
    started = blocks.join(entries, "file").where("at >= begin and at < end").groupBy("file", "size", "begin", "end").agg(F.collect_set("at").alias("at"))  # an entry a stretch of records
    records = started.repartition(parts, "file", "begin").mapInArrow(_records, _RECORD_DDL)
    if lost is None:
        return records
    damaged = {"record_type": F.lit("damaged"), "payload_bytes": F.col("end") - F.col("begin"), "intact": F.lit(False), "file": F.col("file"), "offset": F.col("begin")}
    return records.unionByName(lost.select(*(damaged.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in records.schema.fields)))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op6_warc": op6_warc}
ORACLES = {
    "op6_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, payload, octet_length(payload) AS payload_bytes, sha1(payload) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((CAST('0x' || digest[1 + 5 * (k // 4) : 5 + 5 * (k // 4)] AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31)]), 'string_agg', '') AS payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f"""
}
