"""Media columns: byte payloads as PNG images in binary columns, and perceptual hashes.

A payload whose length is a positive multiple of 192 is an 8-bit RGB image 64
pixels wide.  The writer gives each line the filter that leaves it the fewest
different bytes, and emits the signature, an IHDR, a ``tEXt`` chunk with the
number of bytes before padding, IDAT chunks of at most 64 KiB of one zlib stream
and an IEND, each with its checksum.  The reader walks the chunks, tests every
checksum, inflates and undoes all five scanline filters with numpy.  Features
come from the pixels: 64 bits that say which low-frequency cosine coefficients
of the grey image, shrunk to 32 x 32, are above their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import cut, table
from fieldloom.llm.memory import tidy

WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
_SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
_IDAT = 1 << 16
#: Lines that are filtered at once, each part with the line above it.
_LINES = 1 << 12
_GREY = np.array([299, 587, 114]) / 1000.0
_SIDE, _LOW = 32, 8
_angle = np.pi * (2 * np.arange(_SIDE)[None, :] + 1) * np.arange(_LOW)[:, None] / (2 * _SIDE)
_COSINE = np.cos(_angle) * np.where(np.arange(_LOW) == 0, np.sqrt(1 / _SIDE), np.sqrt(2 / _SIDE))[:, None]


class MediaError(ValueError):
    """Stored bytes that are not a whole, undamaged image."""


def padded(data: bytes) -> bytes:
    """``data`` with blanks up to a positive multiple of a row."""
    return data + b" " * (max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _guesses(rows: np.ndarray, bpp: int) -> Iterator[np.ndarray]:
    """What each of the five filters takes from every sample."""
    left, above, corner = (np.zeros(rows.shape, np.int16) for _ in range(3))
    left[:, bpp:], above[1:], corner[1:, bpp:] = rows[:, :-bpp], rows[:-1], rows[:-1, :-bpp]
    yield np.zeros(rows.shape, np.int16)
    yield left
    yield above
    yield (left + above) >> 1
    yield _paeth(left, above, corner)


def _paeth(left: np.ndarray, above: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of the three neighbours, the one next to left + above - corner; ties in this order."""
    a, b, c = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))


def filtered(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Scanlines, each after the number of its filter: the first of those that leave the fewest different bytes."""
    best, lines = np.full(len(rows), 256), np.zeros((len(rows), rows.shape[1] + 1), np.uint8)
    for kind, guess in enumerate(_guesses(rows, bpp)):
        line = (rows - guess).astype(np.uint8)
        in_order = np.sort(line, axis=1)
        different = (in_order[:, 1:] != in_order[:, :-1]).sum(axis=1)
        better = different < best
        best[better], lines[better, 0], lines[better, 1:] = different[better], kind, line[better]
    return lines


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    """A PNG of ``payload``; ``n_bytes`` of it are data, the rest padding."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    stream = zlib.compressobj(3)
    parts = [stream.compress(filtered(rows[max(0, y - 1) : y + _LINES], CHANNELS)[min(y, 1) :].tobytes()) for y in range(0, len(rows), _LINES)]
    stream = b"".join([*parts, stream.flush()])
    return b"".join([
        _SIGNATURE,
        _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)),
        _chunk(b"tEXt", b"n_bytes\0%d" % n_bytes),
        *(_chunk(b"IDAT", stream[i : i + _IDAT]) for i in range(0, len(stream), _IDAT)),
        _chunk(b"IEND", b""),
    ])


def chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kinds and bodies of a PNG's chunks; raises MediaError at the first fault."""
    if media[:8] != _SIGNATURE:
        raise MediaError("no PNG signature")
    at, kind = 8, b""
    while kind != b"IEND":
        if at + 12 > len(media):
            raise MediaError("cut off")
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(media) or zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise MediaError(f"damaged chunk {kind!r}")
        yield kind, body
        at += 12 + n


def unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Pixels of scanlines that each begin with their filter's number.

    Runs of lines with the filters that look both left and up are undone along
    their diagonals: pixels of one diagonal do not need one another.
    """
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise MediaError("unknown filter")
    begins = np.flatnonzero(np.diff(kinds > 2, prepend=False, append=False))
    runs = dict(zip(begins[::2].tolist(), begins[1::2].tolist(), strict=True))
    for y in np.flatnonzero(kinds).tolist():
        if kinds[y] == 1:
            by_pixel = out[y].reshape(-1, bpp)
            np.cumsum(by_pixel, axis=0, dtype=np.uint8, out=by_pixel)
        elif kinds[y] == 2:
            out[y] += out[y - 1] if y else 0
        elif y in runs:
            _undo_diagonals(out, kinds, y, runs[y], bpp)
    return out


def _undo_diagonals(out: np.ndarray, kinds: np.ndarray, first: int, last: int, bpp: int) -> None:
    """Undo the filters 3 and 4 of the lines first .. last - 1 of ``out`` in place."""
    width, height = out.shape[1] // bpp, last - first
    x = np.zeros((height + 1, width + 1, bpp), np.int16)  # a line above and a pixel before each line
    x[1:, 1:] = out[first:last].reshape(height, width, bpp)
    if first:
        x[0, 1:] = out[first - 1].reshape(width, bpp)
    mean = (kinds[first:last] == 3)[:, None]
    for d in range(height + width - 1):
        rows = np.arange(max(0, d - width + 1), min(height, d + 1))
        at = d - rows
        left, above, corner = x[rows + 1, at], x[rows, at + 1], x[rows, at]
        guess = np.where(mean[rows], (left + above) >> 1, _paeth(left, above, corner))
        x[rows + 1, at + 1] = (x[rows + 1, at + 1] + guess) & 255
    out[first:last] = x[1:, 1:].reshape(height, -1)


def decode_png(media: bytes) -> tuple[np.ndarray, int]:
    """Pixels (height x width x 3) and the number of data bytes of what ``encode_png`` or another 8-bit RGB writer stored."""
    head, stream, n_bytes = None, [], -1
    for kind, body in chunks(media):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            stream.append(body)
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
    if head is None or head[2:] != (8, 2, 0, 0, 0):
        raise MediaError("not a plain 8-bit RGB image")
    width, height = head[:2]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(stream)), np.uint8)
    except zlib.error as fault:
        raise MediaError(str(fault)) from fault
    if len(raw) != height * (width * CHANNELS + 1):
        raise MediaError("wrong number of samples")
    pixels = unfilter(raw.reshape(height, -1), CHANNELS)
    return pixels.reshape(height, width, CHANNELS), n_bytes if n_bytes >= 0 else pixels.size


def _shrunk(grey: np.ndarray, side: int, axis: int) -> np.ndarray:
    """Means over ``side`` equal parts of an axis, its units split where a border falls inside."""
    n = grey.shape[axis]
    total = np.concatenate([np.zeros_like(np.take(grey, [0], axis)), np.cumsum(grey, axis=axis)], axis=axis)
    at = np.linspace(0, n, side + 1)
    low = np.minimum(at.astype(np.int64), n - 1)
    share = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
    edge = np.take(total, low, axis) * (1 - share) + np.take(total, low + 1, axis) * share
    return np.diff(edge, axis=axis) * (side / n)


def cosine_hash(pixels: np.ndarray) -> bytes:
    """Eight bytes: a bit for each of 8 x 8 low-frequency coefficients, set above their median."""
    grey = _shrunk(_shrunk(pixels @ _GREY, _SIDE, 0), _SIDE, 1)
    low = np.round(_COSINE @ grey @ _COSINE.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


@tidy
def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            data = [(x.as_py() or "").encode() for x in part.column(1)]
            media = pa.array([encode_png(padded(d), len(d)) for d in data], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), media], ["doc_id", "media"])


@tidy
def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _DECODED.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            media = stored.as_py()
            pixels, n_bytes = decode_png(media)
            payload = pixels.tobytes()
            rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(pixels)))
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


_DECODED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, cosine_hash binary"


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id and the PNG of every whole text (UTF-8, null as empty) in the binary column ``media``."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode, "doc_id long, media binary")


def from_media(stored: DataFrame) -> DataFrame:
    """Read ``media`` back and describe it; damaged bytes raise MediaError.

    Rows are independent, so repeats repeat; null doc_ids stay, an empty table
    stays empty, and other columns are ignored.
    """
    return stored.select("doc_id", "media").mapInArrow(_decode, _DECODED)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = from_media(cut(to_media(table(spark, sf_dir, "documents")), "media"))
    return found.withColumn("feature", F.lower(F.hex("cosine_hash"))).drop("cosine_hash")


QUERIES = {"op4_media_columns": op4_media_columns}
ORACLES: dict[str, str] = {}
