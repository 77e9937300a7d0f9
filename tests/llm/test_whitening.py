from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from fieldloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label long, x string, n long"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", 1) for i, v in vectors], SCHEMA)


def exact(rows):
    """(n, S, covariance) over the distinct vectors, in rationals."""
    fit = sorted({tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for v in rows})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(d)]
    centred = [[Fraction(n * v[k] - sums[k], n) for k in range(d)] for v in fit]
    return n, sums, [[sum(c[i] * c[j] for c in centred) / n for j in range(d)] for i in range(d)]


def random_rows(n, d, seed=1):
    r = np.random.default_rng(seed)
    return [(k, v.tolist()) for k, v in enumerate((r.normal(size=(n, d)) * (1 + np.arange(d)) + 50 * np.arange(d)).astype(np.float32))]


@pytest.mark.parametrize("parts", [1, 7])
def test_against_rational_sums(spark, parts):
    rows = random_rows(60, 20)
    rows += [(100 + k, rows[0][1]) for k in range(40)] + [(None, rows[1][1])]
    x = whitening.quantised(frame(spark, rows)).repartition(parts)
    model = whitening.fit(x)
    n, sums, covariance = exact([v for _, v in rows])
    assert (model.n, list(model.sums)) == (n, sums)
    trace = sum(covariance[k][k] for k in range(20))
    assert abs(Fraction(model.trace) - trace) < trace * Fraction(1, 10**14)
    e, v = model.variances, model.axes
    exact_cov = np.array([[float(c) for c in row] for row in covariance])
    assert e.shape == (16,) and (np.diff(e) < 0).all()
    assert np.abs(exact_cov @ v - v * e).max() < 1e-11 * e[0] and np.abs(v.T @ v - np.eye(16)).max() < 1e-12
    out = whitening.whitened(x, model).collect()
    assert len(out) == len(rows) * 16 and model.identity_error < 1e-9 and {r["identity_error"] for r in out} == {model.identity_error}
    by = {(r["vec_id"], r["component"]): r for r in out}
    for i, vec in rows[:5]:
        q = [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vec]
        assert by[i, 1]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(q, sums, strict=True)) and by[i, 1]["n"] == n
        for k in range(16):
            want = float(sum((Fraction(a) - Fraction(s, n)) * Fraction(float(c)) for a, s, c in zip(q, sums, v[:, k], strict=True))) / math.sqrt(e[k])
            assert by[i, k + 1]["whitened"] == pytest.approx(want, rel=1e-9, abs=1e-11) and by[i, k + 1]["explained"] == pytest.approx(float(e[k] / float(trace)), rel=1e-12)
    assert sum(r["vec_id"] is None for r in out) == 16


def test_outer_sums_are_exact_beyond_doubles():
    r = np.random.default_rng(3)
    high = r.normal(size=(1024, 3)) * [1, 1e9, 1e-6]
    low = high * r.normal(size=high.shape) * 2.0**-54
    total, rest = whitening.outer_sums(high, low)
    for i in range(3):
        for j in range(3):
            want = sum((Fraction(a) + Fraction(b)) * (Fraction(c) + Fraction(d)) for a, b, c, d in zip(high[:, i], low[:, i], high[:, j], low[:, j], strict=True))
            scale = Fraction(float(np.abs(high[:, i]).max() * np.abs(high[:, j]).max())) * 1024
            assert abs(Fraction(total[i, j]) + Fraction(rest[i, j]) - want) < scale * Fraction(1, 2**80)


def test_cancellation():
    """A large common offset leaves nothing of a plain sum of squares in doubles."""
    x = 10**15 + np.arange(-500, 501, dtype=np.int64)[:, None] * np.array([1, 3])
    model = whitening.Whitening(len(x), tuple(int(s) for s in x.sum(axis=0)), np.zeros((2, 0)), np.zeros(0), 0.0)
    total, rest = whitening.outer_sums(*model.centred(x))
    squares = sum(k * k for k in range(-500, 501))
    assert total.tolist() == [[squares, 3 * squares], [3 * squares, 9 * squares]] and not rest.any()


def test_odd_rows(spark):
    good = random_rows(8, 3)
    nan, inf = float("nan"), float("inf")
    rows = [*good, (20, None), (21, []), (22, [1, None, 2]), (23, [1, nan, 2]), (24, [inf, 0, 0]), (25, [1, 2]), (26, [1, 2, 3, 4])]
    out = whitening.whitened(x := whitening.quantised(frame(spark, rows)), whitening.fit(x)).collect()
    assert {r["vec_id"] for r in out} == set(range(8)) and len(out) == 24


def test_no_spread_and_no_rows(spark):
    same = whitening.quantised(frame(spark, [(k, [1, 2]) for k in range(5)]))
    model = whitening.fit(same)
    assert model.n == 1 and not len(model.variances) and whitening.whitened(same, model).count() == 0
    line = whitening.quantised(frame(spark, [(k, [k, 2]) for k in range(5)]))
    assert {r["component"] for r in whitening.whitened(line, whitening.fit(line)).collect()} == {1}
    assert whitening.fit(whitening.quantised(frame(spark, []))) is None


def test_query(spark):
    out = whitening.op11_embedding_whitening(spark, "/root/testdata/sf0.001")
    one = out.selectExpr("count(*) as n", "count(distinct vec_id) as v", "max(identity_error) as e", "count(distinct component) as c").first()
    assert one["n"] == one["v"] * 16 and one["c"] == 16 and one["e"] < 1e-4


def test_deviation_overflow():
    model = whitening.Whitening(2**20, (0,), np.zeros((1, 0)), np.zeros(0), 0.0)
    with pytest.raises(OverflowError):
        model.deviations(np.array([[2**40]]))
