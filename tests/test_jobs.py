from __future__ import annotations

import datetime
import json
import logging
import subprocess
import sys

import pytest

from jobs import source_factors, speedups
from jobs.settings import read_config
from tests.conftest import ROOT

P = 65521
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, extra string"


def at(day, hour, minute=0):
    return datetime.datetime(2024, 1, day, hour, minute)


def events(spark, rows, path, mode="append"):
    spark.createDataFrame([(k, *r, "x") for k, r in enumerate(rows)], EVENTS).coalesce(1).write.mode(mode).parquet(path)


BATCH = [
    (at(1, 0), 1, "a", 8.0), (at(1, 0, 5), 2, "a", 6.0), (at(1, 3), 1, "a", 3.0), (at(1, 1), 1, "b", 4.0), (at(1, 2), 1, "b", 2.0), (at(2, 5), 1, "b", 10.0), (at(2, 6), 1, "b", 5.0),
    (None, 1, "a", 1.0), (at(1, 4), 1, None, 1.0), (at(1, 4), 1, "a", None), (at(1, 4), 1, "a", 0.0), (at(1, 4), 1, "a", -1.0), (at(1, 4), 1, "a", float("nan")), (at(1, 4), 1, "a", float("inf")),
]


def test_speedups(spark, tmp_path):
    source, out = str(tmp_path / "events"), str(tmp_path / "out")
    events(spark, BATCH, source)
    done = speedups.run(spark, source, out, {"size": 1000, "files_per_day": 2})
    assert done == {"read": 14, "written": 6}
    rows = {(r["day"], r["method"], r["seq"]): r for r in speedups.result(spark, out).collect()}
    got = {k: (r["threads"], r["runs"], r["real_s"], r["speedup_global"], r["speedup_own"]) for k, r in rows.items()}
    assert got == {
        ("2024-01-01", "a", 0): (1, 2, 6.0, 4 / 6, 1.0), ("2024-01-01", "a", 1): (4, 1, 3.0, 4 / 3, 2.0), ("2024-01-01", "b", 0): (2, 1, 4.0, 1.0, 1.0), ("2024-01-01", "b", 1): (3, 1, 2.0, 2.0, 2.0),
        ("2024-01-02", "b", 0): (6, 1, 10.0, 1.0, 1.0), ("2024-01-02", "b", 1): (7, 1, 5.0, 2.0, 2.0),
    }
    assert rows["2024-01-01", "a", 1]["rate"] == pytest.approx(2e9 / 3 / 1e9 / 3)


def test_speedups_of_some_days(spark, tmp_path, caplog):
    source, out = str(tmp_path / "events"), str(tmp_path / "out")
    events(spark, BATCH, source)
    speedups.run(spark, source, out)
    first = sorted(map(str, speedups.result(spark, out).collect()))
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    speedups.run(spark, source, out)
    assert sorted(map(str, speedups.result(spark, out).collect())) == first and spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    events(spark, [(at(2, 5), 9, "b", 1.0), (at(1, 0), 9, "a", 0.5), (at(3, 0), 9, "c", 7.0)], source)
    with caplog.at_level(logging.INFO, "jobs.speedups"):
        assert speedups.run(spark, source, out, first_day="2024-01-02", last_day="2024-01-02") == {"read": 3, "written": 2}
    assert "read 3 events" in caplog.text and "wrote 2 rows" in caplog.text
    rows = {(r["day"], r["method"], r["seq"]): r["real_s"] for r in speedups.result(spark, out).collect()}
    assert rows["2024-01-02", "b", 0] == 1.0 and rows["2024-01-01", "a", 0] == 6.0 and ("2024-01-03", "c", 0) not in rows  # other days untouched
    speedups.run(spark, source, out, first_day="2024-01-03")
    assert len(speedups.result(spark, out).collect()) == 7


def test_speedups_of_nothing(spark, tmp_path):
    events(spark, [], str(tmp_path / "events"))
    assert speedups.run(spark, str(tmp_path / "events"), str(tmp_path / "out")) == {"read": 0, "written": 0}


DOCS = "doc_id long, text string, lang string, source string, n_chars long, i long, word string"


def documents(spark, rows, path):
    spark.createDataFrame([(k, *r, 0, 7, "x") for k, r in enumerate(rows)], DOCS).coalesce(1).write.mode("append").parquet(path)


def texts(seed, many):
    return [(" ".join(f"w{(seed * 31 + k * j * j) % 97}" for j in range(1, 30 + k)), ("en", "fr", None, "")[k % 4], f"src{k % 9}" if k % 10 else None) for k in range(many)]


def brute(rows, edge, columns):
    """The factors by plain Python."""
    import hashlib

    bucket = lambda s, n: int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % n
    counts = {}
    for text, lang, source in rows:
        for word in (text or "").split():
            at = counts.setdefault(lang or "none", [[0] * columns for _ in range(edge)])[bucket(source or "", edge)]
            at[bucket(word, columns)] += 1
    out = {}
    for lang, a in counts.items():
        gram = [[sum(x * y for x, y in zip(r, s, strict=True)) % P for s in a] for r in a]
        m, at = [row[:] for row in gram], None
        for k in range(edge):
            if m[k][k] == 0:
                at = k if at is None else at
                assert not any(m[r][k] for r in range(k + 1, edge))
                continue
            for r in range(k + 1, edge):
                f = m[r][k] * (P - pow(m[k][k], -1, P)) % P
                m[r] = m[r][:k] + [f] + [(x + f * y) % P for x, y in zip(m[r][k + 1 :], m[k][k + 1 :], strict=True)]
        out |= {(lang, i, j): (gram[i][j], m[i][j], at) for i in range(edge) for j in range(edge)}
    return out


def held(spark, out):
    return {(r["lang"], r["i"], r["j"]): (r["gram"], r["v"], r["singular_at"]) for r in source_factors.result(spark, out).collect()}


CONFIG = {"edge": 5, "columns": 32, "prime": P, "files_per_batch": 1}


def test_source_factors_over_growing_input(spark, tmp_path):
    source, out, ck = (str(tmp_path / n) for n in ("docs", "out", "ck"))
    first, second = [*texts(1, 23), (None, "en", "src1"), ("", "en", "src1"), ("long " * 50_000, "fr", "src2")], texts(2, 17)
    documents(spark, first[:10], source)
    documents(spark, first[10:], source)
    done = source_factors.run(spark, source, out, ck, CONFIG)
    assert (done["read"], done["batches"], done["written"]) == (26, 2, 75) and held(spark, out) == brute(first, 5, 32)
    documents(spark, second, source)
    done = source_factors.run(spark, source, out, ck, CONFIG)
    assert (done["read"], done["batches"]) == (17, 1) and held(spark, out) == brute(first + second, 5, 32)
    done = source_factors.run(spark, source, out, ck, CONFIG)
    assert (done["read"], done["batches"]) == (0, 0) and held(spark, out) == brute(first + second, 5, 32)
    source_factors.run(spark, source, str(tmp_path / "whole"), str(tmp_path / "ck2"), CONFIG | {"files_per_batch": 10})
    assert held(spark, str(tmp_path / "whole")) == held(spark, out)


def test_a_repeated_batch_counts_once(spark, tmp_path):
    source, path = str(tmp_path / "docs"), str(tmp_path / "counts")
    documents(spark, texts(3, 12), source)
    batch = spark.read.parquet(source)
    source_factors.add_counts(batch.limit(5), 0, path, CONFIG)
    for _ in range(2):
        assert source_factors.add_counts(batch, 0, path, CONFIG) == 12
    got = {(r["lang"], r["i"], r["j"]): (r["gram"], r["v"], r["singular_at"]) for r in source_factors.factors(source_factors.counts_so_far(spark, path), 5, P).collect()}
    assert got == brute(texts(3, 12), 5, 32)


def test_source_factors_of_nothing_and_of_one_file(spark, tmp_path):
    source = tmp_path / "docs"
    documents(spark, [], str(source))
    assert source_factors.run(spark, str(source), str(tmp_path / "out"), str(tmp_path / "ck"), CONFIG)["written"] == 0
    done = source_factors.run(spark, "/root/testdata/sf0.001/documents.parquet", str(tmp_path / "o"), str(tmp_path / "c"), CONFIG)
    assert done["read"] == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_configs(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"edge": 4}))
    assert read_config(path, source_factors.DEFAULTS)["edge"] == 4 and read_config(source_factors.CONFIG, source_factors.DEFAULTS) == source_factors.DEFAULTS
    for bad in ({"edge": "4"}, {"none": 1}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            read_config(path, source_factors.DEFAULTS)


def test_command_line(tmp_path):
    """One process a job, as a user starts them; the session is theirs."""
    out = subprocess.run(
        [sys.executable, "-m", "jobs.speedups", "--events", "/root/testdata/sf0.001/events.parquet", "--out", str(tmp_path / "out"), "--first-day", "2024-01-05", "--last-day", "2024-01-06"],
        cwd=ROOT, capture_output=True, text=True, timeout=300,
    )
    assert out.returncode == 0, out.stderr[-2000:]
    assert "jobs.speedups read" in out.stderr and sorted(p.name for p in (tmp_path / "out").glob("day=*")) == ["day=2024-01-05", "day=2024-01-06"]


def test_jobs_stand_alone():
    for module in ("settings", "speedups", "source_factors", "registry"):
        text = (ROOT / "jobs" / f"{module}.py").read_text()
        assert "llm" not in text and "corpus_pipeline" not in text
