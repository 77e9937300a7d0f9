from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import packing, token_files, tokens
from fieldloom.llm.common import fresh_path
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def library():
    t = tokens.Tokenizer.from_file(tokens.default_vocabulary())
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def odd_texts(n=4000, seed=3):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", " \n", "a", "Bc", "1", "'s", "!", "é", "日本", "<|endoftext|>", "\x1c", "\r\n", "é", "​", "\xa0", "①", "Ж", "\x85", "the", " the", "\U0001f600", "　"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_ids_are_the_library_s(library):
    texts = [t for _, t in ODD] + odd_texts()
    e = tokens.Encoder(tokens.default_vocabulary())
    for text, ids in zip(texts, e.encode(pa.array(texts, pa.string())), strict=True):
        assert ids == library(text), text


def test_small_cache_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 3)
    texts = odd_texts(300, 5)
    e = tokens.Encoder(tokens.default_vocabulary())
    assert [library(t) for t in texts] == list(e.encode(pa.array(texts)))
    assert len(e.pieces.young) <= 3 and len(e.pieces.old) <= 3


def test_a_cut_is_cut_no_further():
    e = tokens.Encoder(tokens.default_vocabulary())
    for text in [t for _, t in ODD if t] + odd_texts(2000, 6):
        assert all(e.findall(c) == [c] for c in e.findall(text))


def check_pieces(rows, wanted, window):
    """Every id of every document in one piece, windows without gaps."""
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        by_window.setdefault(r["sequence_id"], []).append(r)
    for ids in wanted.values():
        for one in ids:
            assert one
    total = sum(len(one) // 4 for ids in wanted.values() for one in ids)
    assert sum(r["length"] for r in rows) == total
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
    return by_doc, by_window


def test_packing(spark, make, library):
    rows = ODD + [(100 + k, "word " * (k * 7 % 1900)) for k in range(150)]
    wanted = {}
    for i, t in rows:
        wanted.setdefault(i, []).append(library(t) + b"\0\0\0\0")
    got = packing.pack(make(rows, "start length").repartition(2)).collect()
    by_doc, by_window = check_pieces(got, wanted, 1024)
    for (i, n), pieces in by_doc.items():
        if len(wanted[i]) > 1:
            continue
        at, ids = 0, wanted[i][0]
        assert n == len(ids) // 4
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == n
    full = sum(sum(r["length"] for r in p) == 1024 for p in by_window.values())
    assert full >= len(by_window) - 2
    assert packing.pack(make(rows).where("false")).count() == 0


def test_sum_of_squares_rule():
    rng = np.random.Generator(np.random.PCG64(6))
    p, windows = packing.SumOfSquares(50), {}
    for n in rng.integers(1, 51, 500).tolist():
        before = p.count.copy()
        at, level = p.place(n)
        costs = {}
        for h in range(0, 51 - n):
            if h and not before[h]:
                continue
            after = before.copy()
            if h:
                after[h] -= 1
            if h + n < 50:
                after[h + n] += 1
            costs[h] = int((after**2).sum())
        assert costs[level] == min(costs.values()) and level == max(h for h, c in costs.items() if c == min(costs.values()))
        assert windows.get(at, 0) == level
        windows[at] = level + n
    assert p.padding() == sum(50 - x for x in windows.values())
    assert p.place(50)[1] == 0


@pytest.mark.parametrize("parts", ["1", "5"])
def test_token_files(spark, make, library, parts):
    rows = ODD + [(k, f"text {k} " * (k % 40)) for k in range(60, 20, -1)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        shards = token_files.write_token_files(make(rows, "base path"), fresh_path(spark, "tokens"), length=64)
        got = token_files.read_token_files(shards).collect()
        assert shards.count() <= int(parts)
        first = token_files.Shard(shards.orderBy("shard").first()["path"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    ids = sorted(((i is not None, i or 0, library(t) + b"\2\0\0\0") for i, t in rows), key=lambda x: x[:2])
    assert len(got) == len(rows) and sum(r["n_tokens"] for r in got) == sum(len(x[2]) // 4 for x in ids)
    in_order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in in_order] == [i if known else None for known, i, _ in ids]
    at = 0
    for r in in_order:
        assert r["start"] == at
        at += r["n_tokens"]
    for known, i, x in ids:
        if known and sum(k and j == i for k, j, _ in ids) == 1:
            assert next(r["ids_crc32"] for r in got if r["doc_id"] == i) == zlib.crc32(x)
    view, mask = first.sequence(0)
    assert len(view) == 64 and len(mask) == 8 and not view.flags.owndata and first.ids.schema.field("ids").type.list_size == 64


def test_many_batches_and_a_wide_vocabulary(tmp_path):
    rng = np.random.Generator(np.random.PCG64(1))
    docs = [rng.integers(0, 2**32, n, dtype=np.uint32).astype("<u4") for n in rng.integers(0, 9000, 80).tolist()]
    path = f"file://{tmp_path}/x"
    w = token_files.ShardWriter(path, 16, True)
    for k in range(0, 80, 7):
        w.add(list(range(k, min(80, k + 7))), [d.tobytes() for d in docs[k : k + 7]])
    w.close()
    shard = token_files.Shard(path)
    assert [x for _, ids in shard.documents() for x in ids] == [d.tobytes() for d in docs]
    flat = np.concatenate(docs)
    for i in (0, 255, 256, 1000, len(flat) // 16):
        ids, mask = shard.sequence(i)
        n = int(np.bitwise_count(mask).sum())
        assert (ids[:n] == flat[16 * i : 16 * i + n]).all() and n == min(16, len(flat) - 16 * i)


def test_empty_table(spark, make):
    shards = token_files.write_token_files(make([(1, "a")]).where("false"), fresh_path(spark, "tokens"))
    assert shards.count() == 0 and token_files.read_token_files(shards).count() == 0


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "<|endof text|>", " <|endoftext|>\n"]


@pytest.fixture(scope="module")
def as_loaded():
    t = tokens.Tokenizer.from_file(tokens.default_vocabulary())
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_special_tokens_are_those_of_the_library_as_loaded(as_loaded):
    texts = SPECIAL + [t for _, t in ODD] + odd_texts(2000, 8)
    for text, ids in zip(texts, tokens.encoder(tokens.default_vocabulary()).encode(pa.array(texts, pa.string())), strict=True):
        assert ids == as_loaded(text), text
    assert np.frombuffer(as_loaded(SPECIAL[0]), "<u4").tolist() == [64, 220, 50256, 275]


def test_queries_give_special_tokens(spark, make, as_loaded):
    docs, ids = make(list(enumerate(SPECIAL))), [as_loaded(t) for t in SPECIAL]
    for r in packing.pack(docs).collect():
        whole = ids[r["doc_id"]] + b"\0\0\0\0"
        assert r["doc_tokens"] == len(whole) // 4 and r["ids_crc32"] == zlib.crc32(whole[4 * r["start"] : 4 * (r["start"] + r["length"])])
    got = token_files.read_token_files(token_files.write_token_files(docs, fresh_path(spark, "tokens"), length=64)).orderBy("start").collect()
    assert [(r["n_tokens"], r["ids_crc32"]) for r in got] == [(len(i) // 4 + 1, zlib.crc32(i + b"\2\0\0\0")) for i in ids]
