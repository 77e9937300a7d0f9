from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm import media
from tests.llm.conftest import ODD


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 192 == 0 and payload and payload.startswith(data) and set(payload[len(data) :]) <= {32}
    pixels, n = media.decode_png(media.encode_png(payload, len(data)))
    assert pixels.tobytes() == payload and n == len(data)


def filtered(rows, kinds, bpp=3):
    out = []
    for y, (row, kind) in enumerate(zip(rows, kinds, strict=True)):
        above = rows[y - 1] if y else [0] * len(row)
        line = []
        for x, v in enumerate(row):
            a, b, c = (row[x - bpp] if x >= bpp else 0), above[x], (above[x - bpp] if x >= bpp else 0)
            guess = a + b - c
            near = min((abs(guess - a), 0, a), (abs(guess - b), 1, b), (abs(guess - c), 2, c))[2]
            line.append((v - [0, a, b, (a + b) // 2, near][kind]) % 256)
        out.append([kind, *line])
    return np.array(out, dtype=np.uint8)


@pytest.mark.parametrize("kind", range(5))
def test_all_filters_are_undone(kind):
    rows = np.random.Generator(np.random.PCG64(kind)).integers(0, 256, (7, 30)).tolist()
    assert media.unfilter(filtered(rows, [kind] * 7), 3).tolist() == rows
    with pytest.raises(media.MediaError):
        media.unfilter(np.full((1, 4), 5, np.uint8), 3)


def test_damage_is_found():
    good = media.encode_png(media.padded(b"some text" * 90), 810)
    for at in (0, 20, 40, len(good) // 2, len(good) - 5):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(media.MediaError):
            media.decode_png(bytes(bad))
    for n in (5, 50, len(good) - 1):
        with pytest.raises(media.MediaError):
            media.decode_png(good[:n])
    kinds = [k for k, _ in media.chunks(good)]
    assert kinds[0] == b"IHDR" and kinds[-1] == b"IEND"
    assert struct.unpack(">II", next(media.chunks(good))[1][:8]) == (64, 5)


def test_hash_is_perceptual():
    rng = np.random.Generator(np.random.PCG64(8))
    base = np.kron(rng.integers(0, 256, (8, 8, 3)), np.ones((8, 8, 1))).astype(np.uint8)
    bits = lambda x: np.unpackbits(np.frombuffer(media.cosine_hash(x), np.uint8))
    near = np.clip(base.astype(int) + rng.integers(-6, 7, base.shape), 0, 255).astype(np.uint8)
    far = np.kron(rng.integers(0, 256, (8, 8, 3)), np.ones((8, 8, 1))).astype(np.uint8)
    assert (bits(base) != bits(near)).sum() <= 6 < 16 < (bits(base) != bits(far)).sum()
    assert len(media.cosine_hash(np.full((1, 64, 3), 32, np.uint8))) == 8


def test_columns_against_brute_force(spark, make):
    rows = media.from_media(media.to_media(make(ODD, "media"))).collect()
    want = sorted(((i is None, i or 0, (t or "").encode()) for i, t in ODD), key=str)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r) for r in rows), key=lambda x: (str(x[:2]), x[2]["n_bytes"]))
    assert len(got) == len(want)
    for r in rows:
        texts = [(t or "").encode() for i, t in ODD if i == r["doc_id"] and len((t or "").encode()) == r["n_bytes"]]
        payload = media.padded(texts[0])
        assert r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
    stored = {r["media_sha256"] for r in rows if r["n_bytes"] == 0}
    assert len(stored) == 1
    assert media.from_media(media.to_media(make(ODD).where("false"))).count() == 0


def test_mixed_filters_are_undone():
    rng = np.random.Generator(np.random.PCG64(9))
    for _ in range(20):
        rows = rng.integers(0, 256, (int(rng.integers(1, 40)), 30))
        kinds = rng.integers(0, 5, len(rows)).tolist()
        assert media.unfilter(filtered(rows.tolist(), kinds), 3).tolist() == rows.tolist()


def test_each_line_has_the_filter_with_the_fewest_bytes():
    rng = np.random.Generator(np.random.PCG64(2))
    ramp = np.add.outer(np.arange(6) * 40, np.arange(10) * 7)
    rows = np.concatenate([rng.integers(97, 123, (3, 30)), np.repeat(ramp, 3, axis=1) % 256, np.full((2, 30), 32), rng.integers(0, 256, (2, 30))])
    rows = np.concatenate([rows, rows[-1:], (rows[-1:] // 2 + np.arange(30) // 3) % 256]).astype(np.uint8)
    lines = media.filtered(rows, 3)
    for kind in range(5):
        plain = filtered(rows.tolist(), [kind] * len(rows))
        for line, other in zip(lines, plain, strict=True):
            assert len(set(line[1:])) <= len(set(other[1:])) and (line[0] != kind or (line == other).all())
    assert lines[0, 0] == 0 and len(set(lines[:, 0].tolist())) >= 3


def test_filters_run_in_the_query(spark, make):
    texts = ["abc " * 3000, "".join(chr(32 + (k // 3 + k // 192) % 90) for k in range(40_000)), "plain prose of several words", "x" * 5000 + "y" * 900_000]
    stored = media.to_media(make(list(enumerate(texts)))).orderBy("doc_id").collect()
    kinds = set()
    for r, t in zip(stored, texts, strict=True):
        raw = zlib.decompress(b"".join(body for kind, body in media.chunks(bytes(r["media"])) if kind == b"IDAT"))
        kinds |= set(raw[:: media.ROW + 1])
        pixels, n = media.decode_png(bytes(r["media"]))
        assert pixels.tobytes()[:n] == t.encode()
    assert len(kinds) >= 3


def plain_hash(payload):
    """The feature by the formulas, sample by sample."""
    import math

    h = len(payload) // 192
    grey = [[sum(w * payload[192 * y + 3 * x + k] for k, w in enumerate((0.299, 0.587, 0.114))) for x in range(64)] for y in range(h)]
    share = lambda n, k, i: max(0.0, min(i + 1, (k + 1) * n / 32) - max(i, k * n / 32)) * 32 / n
    small = [[sum(share(h, a, y) * share(64, b, x) * grey[y][x] for y in range(h) for x in (2 * b, 2 * b + 1)) for b in range(32)] for a in range(32)]
    scale = lambda k: math.sqrt((1 if k == 0 else 2) / 32)
    low = [scale(u) * scale(v) * sum(small[y][x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    low = [round(x, 6) for x in low]
    middle = sorted(low[1:])[31]
    return int("".join("1" if x > middle else "0" for x in low), 2).to_bytes(8, "big")


def test_feature_against_the_formulas():
    rng = np.random.Generator(np.random.PCG64(3))
    for h in (1, 3, 40):
        payload = rng.integers(0, 256, 192 * h, dtype=np.uint8).tobytes()
        assert media.cosine_hash(np.frombuffer(payload, np.uint8).reshape(h, 64, 3)) == plain_hash(payload)
