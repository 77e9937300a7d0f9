from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest

from fieldloom.llm import files, warc
from fieldloom.llm.common import fresh_path

PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, "http://a/3", None), (4, None, ""), (5, "http://a/5", "é" * 9000),
    (6, "http://a b/6", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"),
    (7, "u", "line\nWARC/1.1\r\nContent-Length: 999999\r\n\r\n"), (None, "n", "<p>nobody</p>"), (8, "u", "<p>nobody</p>"), (9, "u", "WARC/1.1\r\n"), (9, "u", "WARC/1.1\r\n"),
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as first", "1 as sha")


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("block", [150, 1000, 1 << 24])
def test_round_trip(spark, block):
    made = warc.write_archives(pages(spark, PAGES).coalesce(2), fresh_path(spark, "warc"))
    rows = warc.read_archives(made, block).collect()
    assert len(rows) == len(PAGES) and all(r["intact"] for r in rows)
    firsts = {}
    for i, _, html in PAGES:
        if i is not None:
            firsts[html or ""] = min(i, firsts.get(html or "", i))
    want = sorted(str((i, len((h or "").encode()), digest(h), "response" if firsts[h or ""] == i else "revisit", None if firsts[h or ""] == i else firsts[h or ""])) for i, _, h in PAGES)
    assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in rows) == want
    by = {r["page_id"]: r for r in rows}
    assert by[6]["payload"].decode() == PAGES[5][2] and by[2]["payload"] is None


def test_empty_table(spark):
    made = warc.write_archives(pages(spark, PAGES).where("false"), fresh_path(spark, "warc"))
    assert warc.read_archives(made).count() == 0


def test_pointer_jumping():
    offsets, follows = np.array([0, 10, 13, 30, 40]), np.array([10, 30, 31, 40, 70])
    assert warc.reached(offsets, follows, 0).tolist() == [True, True, False, True, True]
    assert warc.exits(offsets, follows).tolist() == [70, 70, 31, 70, 70]
    none = np.array([], np.int64)
    assert warc.reached(none, none, 0).tolist() == [] and warc.exits(none, none).tolist() == []


def damaged(spark, tmp_path, change, many=40, block=1 << 24):
    """Rows of ``many`` records in one file after ``change`` of its bytes, and the records' offsets."""
    inner = warc.record(900, "in", b"embedded", warc.payload_digest(b"embedded"), None)
    bodies = [inner * 2 if k % 7 == 3 else f"page {k} ".encode() * (k + 1) for k in range(many)]
    parts = [warc.record(k, f"http://a/{k}", b, warc.payload_digest(b), None) for k, b in enumerate(bodies)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).tolist()
    data = change(bytearray(b"".join(parts)), at)
    path = tmp_path / "x.warc"
    path.write_bytes(bytes(data))
    files = spark.createDataFrame([(path.as_uri(), len(data))], "file string, size long")
    rows = warc.read_archives(files, block).collect()
    return sorted(r["page_id"] for r in rows if r["record_type"] != "damaged"), sorted((r["offset"], r["payload_bytes"]) for r in rows if r["record_type"] == "damaged"), at


def another_length(data, at):
    k = data.index(b"Content-Length: ", at) + 16
    data[k] = ord("9") if data[k] != ord("9") else ord("8")
    return data


@pytest.mark.parametrize(("block", "which"), [(700, [3, 17, 24]), (1 << 24, [0, 10, 11, 25, 39])])
def test_damaged_lengths(spark, tmp_path, block, which):
    def change(data, at):
        for k in which:
            another_length(data, at[k])
        return data

    pages_read, lost, at = damaged(spark, tmp_path, change, block=block)
    assert pages_read == [k for k in range(40) if k not in which]
    begins = [k for k in which if k - 1 not in which]
    assert [b for b, _ in lost] == [at[k] for k in begins] and sum(n for _, n in lost) == sum(at[k + 1] - at[k] for k in which)


def test_cut_off_end_and_foreign_bytes(spark, tmp_path):
    got, lost, at = damaged(spark, tmp_path, lambda data, at: data[: at[39] + 60])
    assert got == list(range(39)) and lost == [(at[39], 60)]
    got, lost, at = damaged(spark, tmp_path, lambda data, at: b"garbage\n" + data)
    assert got == list(range(40)) and lost == [(0, 8)]
    got, lost, at = damaged(spark, tmp_path, lambda data, at: data[: at[20]] + b"\0" * 499 + b"\n" + data[at[20] :])
    assert got == list(range(40)) and lost == [(at[20], 500)]
    got, lost, at = damaged(spark, tmp_path, lambda data, at: b"no archive at all")
    assert got == [] and lost == [(0, 17)]


def test_damage_in_a_payload_is_told_by_its_digest(spark, tmp_path):
    def change(data, at):
        data[at[6] - 20] ^= 1
        return data

    got, lost, _ = damaged(spark, tmp_path, change)
    assert got == list(range(40)) and lost == []


def test_headers():
    data = warc.record(3, "u", b"abc", "D", None)
    fields, body = warc.parse_header(data, 0)
    assert data[body : body + 3] == b"abc" and fields["warc-type"] == "response" and fields["content-length"] == "3"
    assert warc.parse_header(b"WARC/1.1\r\nno colon\r\n\r\n", 0) is None and warc.parse_header(b"WARC/1.1\r\nContent-Length: x\r\n\r\n", 0) is None
    assert warc.parse_header(b"WARC/1.1\r\nA: b", 0) is None


def test_long_headers_and_payloads_that_look_like_one(spark):
    rows = [(1, "http://a/" + "x" * 300_000, "one"), (2, "u", "WARC/1.1\r\n" + "no header " * 200_000), (3, "u", "WARC/1.1\r\nName: " + "v" * 100_000)]
    made = warc.write_archives(pages(spark, rows).coalesce(1), fresh_path(spark, "warc"))
    got = {r["page_id"]: r for r in warc.read_archives(made, 1 << 16).collect()}
    assert {i: r["payload"].decode() for i, r in got.items()} == {i: h for i, _, h in rows} and got[1]["url"] == rows[0][1]
    assert not warc.header_goes_on(b"WARC/1.1\r\n" + b"x" * 200) and warc.header_goes_on(b"WARC/1.1\r\nA: " + b"x" * 200) and warc.header_goes_on(b"WARC/1.1\r\nA: b\r\nWAR")
    assert not warc.header_goes_on(b"WARC/1.1\r\nA: b\r\nno field\r\n") and warc.header_goes_on(b"WARC/1.1")


@pytest.mark.parametrize(("uri", "arrow"), [
    ("s3a://b/x", "s3://b/x"), ("s3n://b/x", "s3://b/x"), ("s3://b/x", "s3://b/x"), ("dbfs:/t/x", "file:///dbfs/t/x"), ("file:/t/x", "file:///t/x"), ("file:///t/x", "file:///t/x"),
    ("hdfs://h/x", "hdfs://h/x"), ("abfss://c@a/x", "abfss://c@a/x"), ("gs://b/x", "gs://b/x"),
])
def test_schemes(monkeypatch, uri, arrow):
    monkeypatch.setattr(files, "pyarrow", type("P", (), {"fs": type("F", (), {"FileSystem": type("S", (), {"from_uri": staticmethod(lambda u: ("fs", u))})}), "ArrowInvalid": ValueError}))
    assert files.open_store(uri) == ("fs", arrow)


def test_unknown_scheme():
    with pytest.raises(ValueError, match="no file system for nosuch://x"):
        files.open_store("nosuch://x")
