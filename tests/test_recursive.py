from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.engine import MatrixEngine
from fieldloom.functions.field import SingularMatrixError
from fieldloom.operators import echelon, kernels, multiply, recursive, verify
from fieldloom.operators.eliminate import eliminate_tiles
from fieldloom.operators.layout import TileMatrix
from fieldloom.plans import cuts
from fieldloom.sources import matrices

P = 65521


def to_df(spark, a, zeros=False):
    return spark.createDataFrame([(i, j, int(v)) for (i, j), v in np.ndenumerate(a) if zeros or v], "i long, j long, v long")


def to_array(df, rows, columns):
    a = np.zeros((rows, columns), dtype=object)
    for r in df.collect():
        a[r["i"], r["j"]] = r["v"]
    return a


def drawn(rows, columns, p=P, seed=1):
    return np.random.default_rng(seed).integers(0, p, (rows, columns))


def times(a, b, p=P):
    return (a.astype(object) @ b.astype(object)) % p


@pytest.mark.parametrize("modulus", [P, None])
def test_partial_sums_meet_in_small_groups(spark, modulus):
    """Many inner tiles, few blocks: a block has no more partial sums than there are tasks."""
    n = 2000 * 2
    a, b = drawn(6, n, seed=2), drawn(5, n, seed=3)
    left = TileMatrix.of(to_df(spark, a), 6, n, (4, 2)).df.select("bi", F.col("bj").alias("bk"), F.col("t").alias("x"))
    right = TileMatrix.of(to_df(spark, b.T), n, 5, (2, 3)).df.select("bj", F.col("bi").alias("bk"), F.col("t").alias("y"))
    parts = multiply.partial_sums(left, right, (1, 1), (4, 2, 3), modulus, 100)
    sizes = parts.groupBy("bi", "bj").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("tasks")).collect()
    assert len(sizes) == 4 and all(r["n"] == r["tasks"] <= 4 for r in sizes)
    got = multiply.multiply_tiles(to_df(spark, a), to_df(spark, b), 6, 5, n, modulus, tile=64)
    assert (to_array(got, 6, 5) == times(a, b.T, modulus or 1 << 32)).all()


def test_partial_sums_give_out_what_does_not_fit(spark, monkeypatch):
    monkeypatch.setattr(multiply, "HELD_BYTES", 3 * 8 * 16)
    monkeypatch.setattr(multiply, "ONE_LEVEL", 1)
    a, b = drawn(30, 40, seed=4), drawn(25, 40, seed=5)
    got = multiply.multiply_tiles(to_df(spark, a), to_df(spark, b), 30, 25, 40, tile=4)
    assert (to_array(got, 30, 25) == times(a, b.T)).all()


@pytest.mark.parametrize(("rows", "columns", "tile"), [(1, 1, 4), (20, 20, 5), (21, 13, 4), (13, 22, 5), (9, 9, 16), (40, 6, 8)])
def test_recursive_elimination(spark, rows, columns, tile):
    a = drawn(rows, columns, seed=rows)
    got = to_array(recursive.eliminate_recursive(to_df(spark, a), rows, columns, tile=tile), rows, columns)
    assert (got == kernels.factor_by_halves(a, P)).all()


def test_recursive_elimination_passes_over_zero_pivots_or_raises(spark):
    a = drawn(12, 10, seed=8)
    a[:, 5] = 0
    got = to_array(recursive.eliminate_recursive(to_df(spark, a), 12, 10, tile=4), 12, 10)
    assert (got == kernels.factor_by_halves(a, P)).all()
    a = drawn(12, 12, seed=9)
    a[7] = (3 * a[2] + a[4]) % P  # the row vanishes, and those below it do not
    with pytest.raises(SingularMatrixError) as fault:
        recursive.eliminate_recursive(to_df(spark, a), 12, 12, tile=4)
    assert fault.value.pivot == 7
    assert recursive.eliminate_recursive(to_df(spark, a), 0, 12).count() == 0


def written(root, before=()):
    return {p: p.stat().st_size for p in Path(root).rglob("*.parquet") if p not in before}


def test_recursion_writes_less_than_steps(spark):
    root = cuts.shared_dir(spark).removeprefix("file://")
    a = matrices.random_field(spark, 320, 320, seed=3)
    sizes = []
    for form in (eliminate_tiles, recursive.eliminate_recursive):
        before = written(root)
        form(a, 320, 320, tile=32).count()  # 10 steps
        sizes.append(sum(written(root, before).values()))
    assert sizes[1] < sizes[0]


def test_solve_invert_determinant(spark):
    a, b = drawn(19, 19, seed=11), drawn(19, 7, seed=12)
    x = to_array(recursive.solve(to_df(spark, a), 19, to_df(spark, b), 7, tile=8), 19, 7)
    assert (times(a, x) == b).all()
    inverse = to_array(recursive.invert(to_df(spark, a), 19, tile=8), 19, 19)
    assert (times(a, inverse) == np.eye(19, dtype=int)).all()
    lu = kernels.factor_by_halves(a, P)
    want = 1
    for k in range(19):
        want = want * int(lu[k, k]) % P
    assert recursive.determinant(to_df(spark, a), 19, tile=8) == want and recursive.determinant(to_df(spark, a), 0) == 1
    assert recursive.solve(to_df(spark, a), 0, to_df(spark, b), 7).count() == recursive.invert(to_df(spark, a), 0).count() == 0


def test_singular_systems(spark):
    a = drawn(9, 9, seed=13)
    a[8] = a[3]
    assert recursive.determinant(to_df(spark, a), 9, tile=4) == 0
    for call in (lambda: recursive.invert(to_df(spark, a), 9, tile=4), lambda: recursive.solve(to_df(spark, a), 9, to_df(spark, a), 9, tile=4)):
        with pytest.raises(SingularMatrixError) as fault:
            call()
        assert fault.value.pivot == 8


def plain_rank_profile(a, p):
    """The first independent rows, by elimination in plain integers."""
    basis, out = [], []
    for r, row in enumerate(a.tolist()):
        row = [x % p for x in row]
        for c, b in basis:
            f = row[c]
            row = [(x - f * y) % p for x, y in zip(row, b, strict=True)]
        c = next((c for c, x in enumerate(row) if x), None)
        if c is not None:
            f = pow(row[c], -1, p)
            basis.append((c, [x * f % p for x in row]))
            out.append(r)
    return out


@pytest.mark.parametrize(("rows", "columns", "of_rank", "p"), [(60, 9, 4, P), (200, 12, 12, 7), (50, 8, 3, 2), (5, 9, 5, 101), (30, 6, 0, P)])
def test_rank_profile_and_echelon_form(spark, rows, columns, of_rank, p):
    rng = random.Random(rows)
    a = times(drawn(rows, of_rank, p, 3), drawn(of_rank, columns, p, 4), p).astype(np.int64) if of_rank else np.zeros((rows, columns), dtype=np.int64)
    for _ in range(rows // 4):  # rows that repeat, and empty ones
        a[rng.randrange(rows)] = a[rng.randrange(rows)] * rng.randrange(p) % p
    df = to_df(spark, a).repartition(7)
    want = plain_rank_profile(a, p)
    assert [r["i"] for r in echelon.independent_rows(df, columns, p).orderBy("i").collect()] == want and echelon.rank(df, columns, p) == len(want)
    made = echelon.reduced(df, columns, p).orderBy("r").collect()
    columns_wanted = plain_rank_profile(a.T, p)
    assert [r["pivot_j"] for r in made] == columns_wanted and sorted(r["i"] for r in made) == want
    if made:
        e = np.array([r["v"] for r in made])
        assert (e[:, columns_wanted] == np.eye(len(made), dtype=int)).all()
        assert len(plain_rank_profile(np.vstack([e, a]), p)) == len(made)  # the same row space


def test_many_sets_are_merged_in_levels(spark, monkeypatch):
    monkeypatch.setattr(echelon, "FAN", 2)
    monkeypatch.setattr(echelon, "BLOCK", 3)
    a = times(drawn(80, 5, seed=5), drawn(5, 7, seed=6)).astype(np.int64)
    assert [r["i"] for r in echelon.independent_rows(to_df(spark, a), 7).orderBy("i").collect()] == plain_rank_profile(a, P)


@pytest.mark.parametrize(("rows", "columns", "of_rank"), [(20, 7, 4), (7, 7, 7), (15, 6, 0)])
def test_pluq(spark, rows, columns, of_rank):
    a = times(drawn(rows, of_rank, seed=7), drawn(of_rank, columns, seed=8)).astype(np.int64) if of_rank else np.zeros((rows, columns), dtype=np.int64)
    if of_rank:
        a[0] = 0
        a[:, 1] = a[:, 0]
    row_order, column_order, packed = echelon.pluq(to_df(spark, a), rows, columns)
    to_i, to_j = ({r[0]: r[1] for r in o.collect()} for o in (row_order, column_order))
    assert sorted(to_i.values()) == list(range(rows)) and sorted(to_j.values()) == list(range(columns))
    moved = np.zeros_like(a)
    for i in range(rows):
        for j in range(columns):
            moved[to_i[i], to_j[j]] = a[i, j]
    lu = to_array(packed, rows, columns)
    n = np.tril(lu, -1)
    low = np.vstack([np.eye(min(rows, columns), dtype=int), np.zeros((max(0, rows - columns), columns), dtype=int)])[:rows] - n[:, : min(rows, columns)]
    assert (times(low, np.triu(lu)[: min(rows, columns)]) == moved).all()
    r = len(plain_rank_profile(a, P))
    assert all(lu[k, k] for k in range(r)) and not np.triu(lu)[r:].any()


def test_exact_products(spark):
    rng = random.Random(4)
    for low, high in ((-(2**62), 2**62), (0, 1), (-5, 5), (-(2**63), 2**63 - 1)):
        a, b = ([[rng.choice([low, high, rng.randint(low, high)]) for _ in range(9)] for _ in range(n)] for n in (5, 4))
        da, db = (spark.createDataFrame([(i, j, v) for i, row in enumerate(m) for j, v in enumerate(row)], "i long, j long, v long") for m in (a, b))
        want = {(i, j): sum(x * y for x, y in zip(r, s, strict=True)) for i, r in enumerate(a) for j, s in enumerate(b)}
        word = {(r["i"], r["j"]): r["v"] for r in multiply.multiply_exact(da, db, 5, 4, 9, tile=4, wrap=True).collect()}
        assert word == {k: (v + 2**63) % 2**64 - 2**63 for k, v in want.items()}
        if high < 2**60:
            assert {(r["i"], r["j"]): int(r["v"]) for r in multiply.multiply_exact(da, db, 5, 4, 9, tile=4).collect()} == want
    small = spark.createDataFrame([(0, j, 2**60) for j in range(3)], "i long, j long, v long")
    assert int(multiply.multiply_exact(small, small.withColumn("v", -F.col("v")), 1, 1, 3).first()["v"]) == -3 * 2**120
    huge = spark.createDataFrame([(0, j, 2**62) for j in range(3)], "i long, j long, v long")
    with pytest.raises(ArithmeticError):
        multiply.multiply_exact(huge, huge, 1, 1, 3)


@pytest.mark.parametrize(("rows", "columns"), [(17, 17), (20, 9), (9, 20)])
def test_probable_checks(spark, rows, columns):
    a = drawn(rows, columns, seed=21)
    m, lu = to_df(spark, a), kernels.factor_by_halves(a, P)
    assert tuple(verify.probably_factors(to_df(spark, lu), m).first())[:2] == (rows, 0)
    for at in ((3, 7), (7, 3)):  # above and below the diagonal
        wrong = lu.copy()
        wrong[at] = (wrong[at] + 1) % P
        row = verify.probably_factors(to_df(spark, wrong), m).first()
        assert row["failing"] > 0 and row["odds"] == P**-2.0
    b = drawn(6, columns, seed=22)
    c = times(a, b.T)
    assert verify.probably_product(m, to_df(spark, b), to_df(spark, c)).first()["failing"] == 0
    c[2, 4] += 1
    assert verify.probably_product(m, to_df(spark, b), to_df(spark, c)).first()["failing"] == 1


def test_probable_checks_take_absent_rows_as_zeros(spark):
    a = np.zeros((5, 3), dtype=np.int64)
    a[0] = [1, 2, 3]
    packed, m = to_df(spark, a), to_df(spark, a)
    assert verify.probably_factors(packed, m).first()["failing"] == 0
    assert verify.probably_factors(packed.where("false"), m).first()["failing"] == 1


def test_engine_on_systems(spark):
    engine = MatrixEngine(spark)
    a, b = engine.random(10, seed=3), engine.random(10, 4, seed=4)
    x = a.solve(b, tile=8)
    assert (x.rows, x.columns) == (10, 4) and a.multiply_t(x.transpose()).check(b, upper_only=False).first()["mismatching"] == 0
    assert a.multiply_t(a.inverse(tile=8).transpose()).check(engine.zeros(10, 10), upper_only=False).first()["mismatching"] == 10
    assert a.rank() == 10 and b.rank() == 4 and b.transpose().rank() == 4 and engine.zeros(3, 3).rank() == 0 and a.determinant(tile=8) != 0
    for call in (lambda: b.inverse(), lambda: engine.random(4, p=None).determinant(), lambda: a.solve(engine.random(9, 2))):
        with pytest.raises(ValueError):
            call()
