from __future__ import annotations

import builtins
import importlib
import sys

import pytest

from fieldloom.streaming import matrices as streams


def test_every_query_has_sql(spark):
    from fieldloom import queries

    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_entry_without_the_text_operators(monkeypatch):
    real = builtins.__import__

    def without(name, globals=None, locals=None, fromlist=(), level=0):  # noqa: A002
        if name == "corpus_pipeline" or name.startswith("fieldloom.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, globals, locals, fromlist, level)

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("fieldloom.llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    entry = importlib.import_module("__spark_entry__")
    assert "gram_matrix" in entry.queries() and not any(q.startswith("op") for q in entry.queries())
    monkeypatch.setattr(builtins, "__import__", real)
    sys.modules.pop("__spark_entry__")


@pytest.mark.parametrize("p", [101])
def test_stream_of_matrices(spark, tmp_path, p):
    source = tmp_path / "in"
    spark.createDataFrame([(1, [[2, 3], [5, 7]]), (2, [[0, 1], [1, 0]])], "key long, m array<array<bigint>>").write.parquet(str(source))
    stream = spark.readStream.schema("key long, m array<array<bigint>>").parquet(str(source))
    query = streams.to_table(stream, str(tmp_path / "out"), str(tmp_path / "ck"), p).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = {r["key"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows[1]["m"] == [[2, 3], [48, 50]] and rows[1]["singular_at"] is None
    assert rows[2]["singular_at"] == 0
