"""Secrets in texts, also below layers of encoding.

A worklist holds the layers of a text: at first the text itself.  Each layer is
searched, and whatever it holds in encoded form makes further layers: the layer
with its URL and Unicode escapes resolved, each run of base64 decoded (at all four
alignments, since a run may be glued to a path before it), each compressed stream
unpacked.  A layer knows how its characters map to those of the layer it came
from, so each find is reported by the span of the original text that holds it.  A
layer of the same content over the same span was there before and is not entered
again, so streams that unpack to themselves end; the work ends when no layer gives
a new one.  Escapes of escapes (``%252541``) are resolved in one step, so that the
number of layers grows with the logarithm of the text.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import table
from fieldloom.llm.memory import release

#: Kinds in the order in which spans of one start are listed.  "sealed" is no secret: a stream that unpacks to more than MOST_UNPACKED in all.
KINDS = ("assign", "access", "hex", "sealed")
#: Characters that a text's compressed streams may unpack to together; a stream beyond it is reported as "sealed", never passed over.
MOST_UNPACKED = 64 << 20
#: Characters of the shortest secret that a layer can hold ("token=" and eight more), and of its base64.
SHORTEST, SHORTEST_BASE64 = 14, 19

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

_URL = r"%(?:25)*(?P<url>[0-9A-Fa-f]{2})"
_UNICODE = r"(?<!\\)\\++(?:u005[cC])*(?:u(?P<u4>[0-9a-fA-F]{4})|u\{(?P<ub>[0-9a-fA-F]{1,6})\}|U(?P<u8>[0-9a-fA-F]{8})|x(?P<x2>[0-9a-fA-F]{2}))"
_REFERENCE = r"&(?:#38;|#[xX]26;|amp;)*(?:#(?P<dec>[0-9]{1,7});|#[xX](?P<hex>[0-9a-fA-F]{1,6});)"
_ESCAPE = re.compile(f"{_URL}|{_UNICODE}|{_REFERENCE}|(?P<wide>[！-～])")
_BASE64 = re.compile(rf"(?:[A-Za-z0-9+/]{{60,}}+\r?\n)++[A-Za-z0-9+/]*={{0,2}}|[A-Za-z0-9+/_-]{{{SHORTEST_BASE64},}}+={{0,2}}")
_PRINTED = re.compile(rb"[\t\n\r\x20-\x7e]{%d,}" % SHORTEST)
#: Beginnings of compressed streams (fixed values of their formats).
_MAGIC = r"(?P<gzip>\x1f\x8b\x08)|(?P<zlib>x[\x01\x5e\x9c\xda])|(?P<zstd>\x28\xb5\x2f\xfd)|(?P<bzip2>BZh[1-9]1AY&SY)|(?P<xz>\xfd7zXZ\x00)"
_STREAM, _STREAM_BYTES = re.compile(_MAGIC), re.compile(_MAGIC.encode("ascii"))
_UNPACKERS: dict[str, Callable] = {
    "gzip": lambda: zlib.decompressobj(31), "zlib": lambda: zlib.decompressobj(15), "zstd": lambda: zstandard.ZstdDecompressor().decompressobj(), "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor,
}
#: Bytes handed to an unpacker at a time, so that what comes out at once stays in the megabytes.
_PIECE = 256


@dataclass
class Layer:
    """A text and where its characters stand: ``place(k)`` is the span of character k in ``parent``."""

    text: str
    path: tuple[str, ...] = ()
    parent: Layer | None = None
    place: Callable[[int], tuple[int, int]] | None = None

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text that [start, end) came from."""
        layer = self
        while layer.parent is not None:
            start, end = layer.place(start)[0], layer.place(end - 1)[1]
            layer = layer.parent
        return start, end


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """The finds of one layer: kind, start, end (exclusive)."""
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        yield from (("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8)
    if "AKIA" in text:
        yield from (("access", *m.span()) for m in _ACCESS.finditer(text))
    yield from (("hex", *m.span()) for m in _HEX.finditer(text))


def _character(m: re.Match) -> str:
    kind = m.lastgroup
    code = ord(m["wide"]) - 0xFEE0 if kind == "wide" else int(m[kind], 10 if kind == "dec" else 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def _unescaped(layer: Layer) -> Iterator[Layer]:
    pieces, made, begins, ends, kinds = [], [], [], [], set()
    at = size = 0
    for m in _ESCAPE.finditer(layer.text):
        pieces += [layer.text[at : m.start()], _character(m)]
        size += m.start() - at
        made.append(size)
        begins.append(m.start())
        ends.append(at := m.end())
        kinds.add("url" if m.lastgroup == "url" else "unicode")
        size += 1
    if not made:
        return

    def place(k: int) -> tuple[int, int]:
        n = bisect_right(made, k) - 1
        if n < 0:
            return k, k + 1
        if made[n] == k:
            return begins[n], ends[n]
        p = ends[n] + k - made[n] - 1
        return p, p + 1

    yield Layer("".join(pieces) + layer.text[at:], (*layer.path, "+".join(sorted(kinds, reverse=True))), layer, place)


def _from_base64(layer: Layer) -> Iterator[Layer]:
    for m in _BASE64.finditer(layer.text):
        run, start = m[0].rstrip("="), m.start()
        where = None
        if "\n" in run:
            codes = np.frombuffer(run.encode("ascii"), np.uint8)
            where = np.flatnonzero((codes != 10) & (codes != 13))
            run = codes[where].tobytes().decode("ascii")
        run = run.replace("-", "+").replace("_", "/")
        for skip in range(4):
            left = len(run) - skip
            if left < SHORTEST_BASE64:
                break
            left -= left % 4 == 1
            raw = binascii.a2b_base64(run[skip : skip + left] + "=" * (-left % 4))

            def place(k: int, skip=skip, start=start, where=where, step: int = 1, off: int = 0) -> tuple[int, int]:
                k = k * step + off
                first, last = skip + k * 8 // 6, skip + (k * 8 + 7) // 6
                return (start + first, start + last + 1) if where is None else (start + int(where[first]), start + int(where[last]) + 1)

            if _PRINTED.search(raw) or _STREAM_BYTES.search(raw):
                yield Layer(raw.decode("latin-1"), (*layer.path, "base64"), layer, place)
            if 3 * raw.count(0) > len(raw):  # every other byte of text in 16 bits
                for off in (0, 1):
                    if _PRINTED.search(half := raw[off::2]):
                        yield Layer(half.decode("latin-1"), (*layer.path, "base64", "utf-16"), layer, lambda k, place=place, off=off: (place(k, step=2, off=off)))


def unpack(kind: str, data: memoryview, most: int) -> tuple[bytes, int, bool]:
    """What a stream unpacks to, as far as it is sound; its length; whether that is more than ``most`` (and cut off there)."""
    machine, out, size = _UNPACKERS[kind](), [], 0
    for at in range(0, len(data), _PIECE):
        try:
            got = machine.decompress(bytes(data[at : at + _PIECE]))
        except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, EOFError, MemoryError):
            return b"".join(out), at, False
        out.append(got)
        size += len(got)
        if size > most:
            return b"", len(data), True
        if machine.eof:
            return b"".join(out), min(len(data), at + _PIECE) - len(machine.unused_data), False
    return b"".join(out), len(data), False


def _unpacked(layer: Layer, left: list[int]) -> Iterator[Layer | tuple[str, int, int]]:
    if not _STREAM.search(layer.text):
        return
    data = memoryview(layer.text.encode("latin-1", "replace"))
    end = 0
    for m in _STREAM.finditer(layer.text):
        if m.start() < end:
            continue
        got, length, sealed = unpack(m.lastgroup, data[m.start() :], left[0])
        if sealed:
            end = len(data)
            yield ("sealed", m.start(), end)
        elif len(got) >= SHORTEST:
            end = m.start() + max(length, 1)
            left[0] -= len(got)
            yield Layer(got.decode("latin-1"), (*layer.path, m.lastgroup), layer, lambda _, span=(m.start(), end): span)


def scan(text: str | None, most: int = MOST_UNPACKED) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, layers): all finds by start, kind and end; ``layers`` are the encodings around one, outermost first, empty for base ones."""
    found: dict[tuple[str, int, int], tuple[str, ...]] = {}
    work, seen, left = deque([Layer(text or "")]), set(), [most]
    while work:
        layer = work.popleft()
        for kind, start, end in base_spans(layer.text):
            found.setdefault((kind, *layer.origin(start, end)), layer.path)
        streams = list(_unpacked(layer, left))
        binary = any(isinstance(s, Layer) and s.place(0)[0] == 0 for s in streams)  # what looks like an escape in a stream's bytes is none
        for more in streams if binary else (*_unescaped(layer), *_from_base64(layer), *streams):
            if not isinstance(more, Layer):
                found.setdefault((more[0], *layer.origin(*more[1:])), layer.path)
                continue
            key = (hashlib.blake2b(more.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), more.origin(0, len(more.text)) if more.text else None)
            if more.text and key not in seen:
                seen.add(key)
                work.append(more)
    order = sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return [(*s, ">".join(found[s])) for s in order]


_SPAN = "struct<kind:string,start:long,end:long,layers:string>"


def _scanned(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    try:
        for part in texts:
            yield pd.Series([[dict(zip(("kind", "start", "end", "layers"), s, strict=True)) for s in scan(t)] for t in part], dtype=object)
    finally:
        release()


def with_secrets(docs: DataFrame, text: str = "text", name: str = "secrets") -> DataFrame:
    """All columns of ``docs`` and, in place of a column of that ``name``, the finds of every whole text in an array.

    Null and empty texts have none.  Offsets count code points, ends are
    exclusive.  Rows are independent of one another, so repeated ones have the same
    finds, and nothing is shuffled.
    """
    return docs.withColumn(name, F.pandas_udf(_scanned, f"array<{_SPAN}>")(F.coalesce(F.col(text), F.lit(""))))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds in every document: counts and digest of those of the text itself, and all of them."""
    found = with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), name="found").select("doc_id", "found", F.expr("filter(found, s -> s.layers = '' and s.kind <> 'sealed')").alias("base"))
    listed = lambda spans: F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("found").alias("spans"))


QUERIES = {"op12_secret_scan": op12_secret_scan}
#: No SQL: nested layers are tested against texts that were encoded at known places.
ORACLES: dict[str, str] = {}
