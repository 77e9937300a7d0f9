from __future__ import annotations

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm import exact_dedup
from fieldloom.llm.quotient_filter import CountingQuotientFilter as Filter
from tests.llm.conftest import ODD


@given(st.lists(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**64 - 1)), max_size=60), min_size=1, max_size=5), st.integers(0, 4))
@settings(max_examples=80, deadline=None)
def test_filters_merge_without_loss(parts, bits):
    filters = [Filter.from_bytes(Filter.of(np.array(p, dtype=np.uint64)).to_bytes()) for p in parts]
    values, counts = Filter.merge(filters).items()
    every = [x for p in parts for x in p]
    assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == {x: every.count(x) for x in every}
    assert values.tolist() == sorted(set(every))
    again = Filter.merge([piece for f in filters for _, piece in f.split(bits)])
    assert [x.tolist() for x in again.items()] == [values.tolist(), counts.tolist()]
    for f in filters:
        assert all(int(v) >> (64 - bits) == k if bits else k == 0 for k, piece in f.split(bits) for v in piece.items()[0].tolist())


def brute(rows):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    out = []
    for i, t in rows:
        same = [j for j, u in rows if lower(u) == lower(t)]
        ids = [j for j in same if j is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(same), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return out


def key(x):
    return tuple((v is None, v) for v in x)


def test_against_brute_force(spark, make):
    rows = [*ODD, (20, "ABC É"), (21, "abc É"), (22, "abc é"), (23, "ABC É")]
    got = [tuple(r) for r in exact_dedup.exact_groups(make(rows, "fp norm keep_id")).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_colliding_fingerprints_do_not_join_texts(spark, make, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    rows = [(1, "a"), (2, "b"), (3, "A"), (4, "c")]
    got = [tuple(r) for r in exact_dedup.exact_groups(make(rows)).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_dropping_copies(spark, make):
    rows = [(1, "x"), (2, "X"), (3, "y"), (3, "y"), (4, None), (5, "")]
    kept = exact_dedup.drop_exact_copies(make(rows, "kept"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5] and "kept" in kept.columns
    assert exact_dedup.drop_exact_copies(make(rows, "sha id n doc rows __sha")).columns[-1] == "__sha"
    assert exact_dedup.drop_exact_copies(make(rows).where("false")).count() == 0
    assert exact_dedup.exact_groups(make(rows).where("false")).count() == 0


def test_texts_of_null_ids_stay(spark, make):
    rows = [(1, "a"), (None, "only here"), (None, "A"), (None, "twice"), (None, "TWICE"), (None, "x"), (4, "X")]
    kept = exact_dedup.drop_exact_copies(make(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"].lower()) for r in kept) == [(0, "only here"), (0, "twice"), (1, "a"), (4, "x")]
