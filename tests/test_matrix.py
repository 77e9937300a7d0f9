from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.functions import field
from fieldloom.operators import eliminate, kernels, layout, multiply, verify
from fieldloom.sources import matrices

P = 65521

#: Packed form of the deterministic 12 x 12 matrix mod 65521 (fixed values).
GOLDEN = np.array("""
  208     0   210   211   212   213   214   215   216   217   218   219
  314   210   419   945  1260  1575  1890  2205  2520  2835  3150  3465
  629   311   527 33488  1254 34328  1881 34955  2508 35582  3135 36209
  944   623 18026 11596  2152 19339 36311 53283  4734 21706 38678 55650
 1259   935 36053 18774 45446 56986 29331  1459 39108 11236 48885 21013
 1574  1247 54080 37549 16366 55847 17222 31268 45095 58922  7228 21055
 1889  1559  6586 56324 32733 57317  8870 54358 62376  4652 12449 20021
 2204  1871 24613  9578 49100 49114  9756 33311 40216 53684  1183 47042
 2519  2183 42640 28353 65467 40911 19513 31896 40276 20672 60984 49295
 2834  2495 60667 47128 16313 32708 29270 63793 34330 53378 44652 54031
 3149  2807 13173   382 32680 24505 39027 24992  5682 37770 52512 47681
 3464  3119 31200 19157 49047 16302 33678 60501 21508 19162 19999 33625
""".split(), dtype=np.int64).reshape(12, 12)  # fmt: skip


def cells(spark, a):
    a = np.asarray(a)
    return spark.createDataFrame([(int(i), int(j), int(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "i long, j long, v long")


def dense(df, rows, columns):
    out = np.full((rows, columns), -1, dtype=object)
    for r in df.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def plain(a, p):
    """The packed form by the definition."""
    a = np.array(a, dtype=object) % p
    for k in range(min(a.shape)):
        for r in range(k + 1, a.shape[0]):
            m = -a[r, k] * pow(int(a[k, k]), -1, p) % p
            a[r, k] = m
            a[r, k + 1 :] = (a[r, k + 1 :] + a[k, k + 1 :] * m) % p
    return a


@pytest.mark.parametrize("how", ["tiles2", "tiles5", "fold", "rows", "halves"])
def test_golden_in_every_form(spark, how):
    m = matrices.deterministic(spark, 12, 12)
    made = {
        "tiles2": lambda: eliminate.eliminate_tiles(m, 12, 12, tile=2), "tiles5": lambda: eliminate.eliminate_tiles(m, 12, 12, tile=5),
        "fold": lambda: eliminate.eliminate_fold(m, 12, 12), "rows": lambda: eliminate.eliminate_by_rows(m, 12, 12), "halves": lambda: eliminate.eliminate_by_halves(m, 12, 12, leaf=2),
    }[how]()
    assert (dense(made, 12, 12) == GOLDEN).all()


def test_upper_only_keeps_cells_below(spark):
    a = matrices.deterministic(spark, 12, 12)
    upper = dense(layout.upper(eliminate.eliminate_fold(a, 12, 12, full=False)), 12, 12)
    assert all(upper[i, j] == GOLDEN[i, j] for i in range(12) for j in range(i, 12))


@pytest.mark.parametrize("tile", [1, 2, 3, 8])
def test_rectangular_goldens(spark, tile):
    tall = np.array([[2, 3, 5], [7, 11, 13], [17, 19, 23], [29, 31, 37], [41, 43, 47]])
    assert dense(eliminate.eliminate_tiles(cells(spark, tall), 5, 3, 101, tile), 5, 3).tolist() == [[2, 3, 5], [47, 51, 46], [42, 13, 23], [36, 25, 24], [30, 37, 36]]
    assert dense(eliminate.eliminate_tiles(cells(spark, tall.T), 3, 5, 101, tile), 3, 5).tolist() == [[2, 7, 17, 29, 41], [49, 51, 44, 38, 32], [48, 9, 23, 54, 81]]


@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([2, 3, 97, 251, 65521]), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_kernels_against_the_definition(rows, columns, p, seed):
    a = np.random.Generator(np.random.PCG64(seed)).integers(0, p, (rows, columns))
    try:
        expected = plain(a, p)
    except ValueError:
        return
    assert (kernels.factor_by_halves(a, p, leaf=2) == expected).all()


@pytest.mark.parametrize(("rows", "columns", "p", "tile"), [(13, 7, 65521, 4), (7, 13, 251, 3), (30, 30, 97, 96)])
def test_identity_of_the_factors(spark, rows, columns, p, tile):
    for seed in range(20):
        a = np.random.Generator(np.random.PCG64(seed)).integers(1, p, (rows, columns))
        try:
            plain(a, p)
            break
        except ValueError:
            continue
    m = cells(spark, a)
    packed = eliminate.eliminate_tiles(m, rows, columns, p, tile)
    found = verify.compare(m.where("v <> 0"), verify.rebuilt(packed, rows, columns, p).where("v <> 0"), upper_only=False).first()
    assert found["mismatching"] == 0


def test_singular_matrices(spark):
    for a, pivot in (([[0, 1], [1, 0]], 0), ([[1, 2, 3], [2, 4, 1], [1, 1, 1]], 1)):
        m = cells(spark, a)
        for run in (lambda m, n: eliminate.eliminate_tiles(m, n, n, 7, 2), lambda m, n: eliminate.eliminate_by_rows(m, n, n, 7)):
            with pytest.raises(field.SingularMatrixError) as e:
                run(m, len(a)).collect()
            assert e.value.pivot == pivot
    m = cells(spark, [[1, 2], [2, 4]])  # the last pivot is zero: U is whole, the status tells
    assert dense(eliminate.eliminate_tiles(m, 2, 2, 7), 2, 2).tolist() == [[1, 2], [5, 0]]
    one = m.selectExpr("1 as g", "*")
    assert {r["singular_at"] for r in eliminate.eliminate_groups(one, ["g"], 7).collect()} == {1}
    bad = cells(spark, [[0, 1], [1, 0]]).selectExpr("1 as g", "*")
    rows = eliminate.eliminate_groups(bad, ["g"], 7).collect()
    assert {r["singular_at"] for r in rows} == {0} and all(r["v"] is None for r in rows if r["i"] == 1)


def test_groups_are_factored_apart(spark):
    a, b = [[1, 2], [3, 5]], [[2, 1], [1, 3]]
    both = cells(spark, a).selectExpr("'a' as g", "*").union(cells(spark, b).selectExpr("'b' as g", "*"))
    rows = eliminate.eliminate_groups(both, ["g"], 101).collect()
    for name, m in (("a", a), ("b", b)):
        assert {(r["i"], r["j"]): r["v"] for r in rows if r["g"] == name} == {(i, j): plain(m, 101)[i, j] for i in range(2) for j in range(2)}


def test_products_in_every_form(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    a, b = rng.integers(0, 2**32, (9, 7)), rng.integers(0, 2**32, (5, 7))
    x, y = cells(spark, a), cells(spark, b)
    wrapped = np.array(a, dtype=object) @ np.array(b, dtype=object).T % 2**32
    for made in (multiply.multiply_cells(x, y, None), multiply.multiply_rows(x, y, None), multiply.multiply_tiles(x, y, 9, 5, 7, None, 3)):
        assert (dense(made, 9, 5) == wrapped).all()
    x, y = cells(spark, a % P), cells(spark, b % P)
    mod = np.array(a % P, dtype=object) @ np.array(b % P, dtype=object).T % P
    for made in (multiply.multiply_cells(x, y), multiply.multiply_rows(x, y), multiply.multiply_tiles(x, y, 9, 5, 7, P, 4)):
        assert (dense(made, 9, 5) == mod).all()
    small = multiply.multiply_cells(cells(spark, [[4294967295, 2147483648], [3, 5]]), cells(spark, [[4294967295, 2], [7, 2147483648]]), None)
    assert dense(small, 2, 2).tolist() == [[1, 4294967289], [7, 2147483669]]


def test_right_operand_has_a_size_bound(spark, monkeypatch):
    monkeypatch.setattr(multiply, "SMALL_SIDE", 8)
    with pytest.raises(ValueError, match="multiply_tiles"):
        multiply.multiply_rows(cells(spark, [[1, 2]]), cells(spark, [[1, 2]]))


def test_negated_inverses(spark):
    for p in (2, 7, 251):
        df = spark.range(0, 2 * p).withColumn("n", field.neg_inverse_col("id", p))
        for r in df.collect():
            assert r["n"] == (None if r["id"] % p == 0 else field.neg_inverse(r["id"], p))
    assert [field.neg_inverse(a, 7) for a in range(1, 7)] == [6, 3, 2, 5, 4, 1]
    assert field.neg_inverse(208) == 315
    with pytest.raises(ZeroDivisionError):
        field.neg_inverse(P)
    with pytest.raises(ValueError):
        field.check_prime(65520)


def test_work_models():
    assert field.elimination_flops(12, 12) == 6798
    assert field.elimination_flops(2000, 2000) == 31997993000
    assert field.multiply_flops(2, 3, 4) == 48
    assert field.thread_counts(1, 20) == [1, 2, 4, 8, 16] and field.thread_counts(3, 8) == [4, 8]
    assert field.size_sweep(100, 50, 2) == [100, 150, 200] and field.size_sweep(100, 0, 2) == [100, 200, 400]
    assert field.tile_counts(10, 8, 4) == (3, 2) and field.cache_tile(32768) == 36
    assert round(field.tiled_rate(12, 12, 6, 0.012), 3) == 0.016


def test_generators_do_not_hang_on_partitioning(spark):
    a = matrices.random_field(spark, 20, 10, 97, 5)
    assert sorted(a.collect()) == sorted(a.repartition(7).collect())
    assert a.selectExpr("min(v) >= 0 and max(v) < 97").first()[0]
    assert matrices.random_small(spark, 9, 9).selectExpr("max(v) < 20").first()[0]
    assert matrices.zeros(spark, 2, 3).count() == 6


def test_padding_and_layouts(spark):
    a = np.arange(1, 16).reshape(5, 3)
    wide = dense(matrices.padded(cells(spark, a), 5, 3, 4), 8, 4)
    assert wide.shape == (8, 4) and (wide[:5, :3] == a).all() and wide[3, 3] == 1 and wide[7].tolist() == [0, 0, 0, 0]
    back = layout.TileMatrix.of(cells(spark, a), 5, 3, 2).cells()
    assert (dense(back, 5, 3) == a).all()
    assert (dense(layout.from_rows(layout.to_rows(cells(spark, a))), 5, 3) == a).all()
    assert (dense(layout.transpose(cells(spark, a)), 3, 5) == a.T).all()
    assert layout.display(cells(spark, [[1, 2], [3, 4]])).split() == ["1", "2", "3", "4"]


def test_mismatches(spark):
    a, b = cells(spark, [[1, 2], [3, 4]]), cells(spark, [[1, 9], [7, 4]])
    assert verify.compare(a, b).first().asDict() == {"mismatching": 1, "compared": 3}
    assert verify.compare(a, b, upper_only=False).first()["mismatching"] == 2
    assert [(r["i"], r["j"]) for r in verify.mismatches(a, b).collect()] == [(0, 1)]
    assert verify.compare(a.where("i = 0"), b).first()["mismatching"] == 2


def forms(m, rows, columns, p):
    return {
        "driver": lambda: eliminate.eliminate_on_driver(m, rows, columns, p), "fold": lambda: eliminate.eliminate_fold(m, rows, columns, p), "halves": lambda: eliminate.eliminate_by_halves(m, rows, columns, p, leaf=2), "rows": lambda: eliminate.eliminate_by_rows(m, rows, columns, p),
        "tiles1": lambda: eliminate.eliminate_tiles(m, rows, columns, p, tile=1), "tiles2": lambda: eliminate.eliminate_tiles(m, rows, columns, p, tile=2), "tiles8": lambda: eliminate.eliminate_tiles(m, rows, columns, p, tile=8),
        "strip": lambda: eliminate.eliminate_strip(m, rows, columns, p, block_bytes=32),
    }


def by_rule(a, p):
    """The packed form by the definition, or the first pivot that is zero and needed."""
    a = np.array(a, dtype=object) % p
    for k in range(min(a.shape)):
        for r in range(k + 1, a.shape[0]):
            if a[r, k] == 0:
                continue
            if a[k, k] == 0:
                return k
            m = -a[r, k] * pow(int(a[k, k]), -1, p) % p
            a[r, k] = m
            a[r, k + 1 :] = (a[r, k + 1 :] + a[k, k + 1 :] * m) % p
    return a


RULES = {
    "swap": [[0, 1], [1, 0]], "empty column": [[0, 1], [0, 1]], "empty column, then needed": [[0, 0, 1], [0, 0, 2], [0, 3, 1]], "last pivot": [[1, 2], [2, 4]],
    "fails late": [[1, 2, 3, 4], [2, 4, 1, 1], [0, 0, 0, 2], [0, 5, 1, 1], [0, 0, 0, 3]], "two fail": [[1, 1, 1, 1], [1, 1, 2, 1], [1, 2, 2, 2], [0, 0, 0, 0], [0, 0, 3, 1]],
    "sparse": [[3, 0, 0, 1, 0], [0, 0, 0, 0, 0], [1, 0, 2, 0, 0], [0, 0, 0, 5, 0], [0, 0, 4, 0, 6], [0, 0, 0, 0, 0]], "wide": [[0, 0, 1, 5], [0, 2, 0, 0]], "zeros": [[0, 0], [0, 0], [0, 0]],
}


@pytest.mark.parametrize("name", RULES)
def test_one_rule_in_every_form(spark, name):
    a, p = np.array(RULES[name]), 7
    want = by_rule(a, p)
    for m in (cells(spark, a), cells(spark, a).where("v <> 0")) if name == "sparse" else (cells(spark, a).where("v <> 0"),):
        for form, run in forms(m, *a.shape, p).items():
            if form == "tiles1" and name != "fails late":
                continue
            if isinstance(want, int):
                with pytest.raises(field.SingularMatrixError) as e:
                    run().collect()
                assert e.value.pivot == want, form
            else:
                assert (dense(run(), *a.shape) == want).all(), form
    status = eliminate.eliminate_with_status(cells(spark, a).where("v <> 0"), *a.shape, p).collect()
    assert {r["singular_at"] for r in status} == {want if isinstance(want, int) else None}


@pytest.mark.parametrize(("rows", "columns"), [(0, 0), (0, 3), (3, 0)])
def test_empty_matrices(spark, rows, columns):
    none = cells(spark, np.zeros((1, 1), int)).where("false")
    assert all(run().count() == 0 for run in forms(none, rows, columns, 7).values())
    assert eliminate.eliminate(none, rows, columns).count() == 0
    assert eliminate.eliminate_groups(none.selectExpr("1 as g", "*"), ["g"]).count() == 0
    assert multiply.multiply_tiles(none, none, rows, rows, columns).count() == 0 if rows and columns else True
    assert multiply.multiply_rows(none, none).count() == 0 == multiply.multiply_cells(none, none).count()
    packed = spark.createDataFrame([([],), ([[]],), (None,)], "m array<array<bigint>>").withColumn("m", eliminate.fold("m")).withColumn("s", eliminate.singular_at("m")).collect()
    assert [r["m"] for r in packed] == [[], [[]], None] and {r["s"] for r in packed} == {None}


def test_forms_with_bounds_say_so(spark):
    none = cells(spark, [[1]])
    for run in (eliminate.eliminate_on_driver, eliminate.eliminate_fold, eliminate.eliminate_by_halves, eliminate.eliminate_by_rows, eliminate.eliminate_strip):
        with pytest.raises(ValueError, match="use eliminate"):
            run(none, 2000, 2000)


@pytest.mark.parametrize(("rows", "columns"), [(40, 9), (9, 40), (25, 25)])
def test_random_sparse_matrices(spark, rows, columns):
    rng = np.random.Generator(np.random.PCG64(rows))
    while True:
        a = rng.integers(1, 97, (rows, columns)) * (rng.random((rows, columns)) < 0.4)
        if not isinstance(want := by_rule(a, 97), int):
            break
        a[np.arange(min(a.shape)), np.arange(min(a.shape))] = rng.integers(1, 97, min(a.shape))
        if not isinstance(want := by_rule(a, 97), int):
            break
    m = cells(spark, a).where("v <> 0")
    for form, run in forms(m, rows, columns, 97).items():
        if form not in ("tiles1", "rows"):
            assert (dense(run(), rows, columns) == want).all(), form


@given(st.integers(1, 7), st.integers(1, 7), st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_kernels_find_the_first_failing_pivot(rows, columns, seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    a = rng.integers(0, 3, (rows, columns)) * (rng.random((rows, columns)) < 0.6)
    want = by_rule(a, 3)
    for leaf in (1, 2, 32):
        try:
            assert (kernels.factor_by_halves(a, 3, leaf=leaf) == want).all()
        except field.SingularMatrixError as e:
            assert e.pivot == want


@pytest.mark.parametrize(("split", "parts"), [("grid", 1), ("grid", 12), ("grid", 1000), ("rows", 3), ("rows", 1000)])
def test_products_on_any_grid(spark, split, parts):
    rng = np.random.Generator(np.random.PCG64(5))
    a, b = rng.integers(0, P, (11, 6)), rng.integers(0, P, (8, 6))
    a[3] = b[:, 2] = 0  # absent rows and columns
    x, y = cells(spark, a).where("v <> 0"), cells(spark, b).where("v <> 0")
    made = multiply.multiply_tiles(x, y, 11, 8, 6, P, 3, split, parts)
    assert (dense(made, 11, 8) == np.array(a, dtype=object) @ np.array(b, dtype=object).T % P).all()
    with pytest.raises(ValueError):
        multiply.multiply_tiles(x, y, 11, 8, 6, P, 3, "spiral")


def test_grids_have_enough_keys_and_no_more_copies_than_blocks():
    for down, across, inner in ((8, 8, 1), (1, 400, 1), (400, 1, 1), (30, 2, 5), (1, 1, 1)):
        g, h = multiply.grid_of(down, across, inner, 48, "grid")
        assert 1 <= g <= down and 1 <= h <= across and g * h * inner >= min(48, down * across * inner) / 2


def test_products_of_row_arrays_with_absent_cells(spark):
    a, b = np.array([[1, 0, 2], [0, 0, 3]]), np.array([[0, 5, 0], [4, 0, 6]])
    made = multiply.multiply_rows(cells(spark, a).where("v <> 0"), cells(spark, b).where("v <> 0"))
    assert (dense(made, 2, 2) == a @ b.T).all()


def test_engine(spark):
    from fieldloom.engine import MatrixEngine

    engine = MatrixEngine(spark)
    a = engine.deterministic(12)
    for strategy in ("auto", "driver", "fold", "rows", "halves", "strip", "tiles"):
        lu = a.eliminate(strategy, 5 if strategy == "tiles" else None)
        assert (dense(lu.df, 12, 12) == GOLDEN).all()
    assert lu.check(a.eliminate()).first().asDict() == {"mismatching": 0, "compared": 78}
    assert lu.rebuilt().check(a, upper_only=False).first()["mismatching"] == 0
    b = engine.random(5, 12, seed=2)
    products = [a.multiply_t(b, s, **({"tile": 4} if s == "tiles" else {})) for s in ("tiles", "rows", "cells")]
    assert products[0].rows == 12 and products[0].columns == 5
    assert products[0].check(products[1], upper_only=False).first()["mismatching"] == 0 == products[0].check(products[2], upper_only=False).first()["mismatching"]
    assert (b.transpose().rows, a.padded(8).columns, engine.zeros(2, 3).df.count()) == (12, 16, 6)
    assert engine.random(4, 4, p=None).df.selectExpr("max(v) >= 65536").first()[0]
    table = spark.createDataFrame([(0, 1, 2), (0, 1, 3), (1, 0, 4)], "r long, c long, x long")
    assert sorted(tuple(r) for r in engine.from_table(table, "r", "c", "x", 2, 2).df.collect()) == [(0, 1, 5), (1, 0, 4)]
    for call in (lambda: a.multiply_t(engine.zeros(2, 3)), lambda: a.eliminate("magic"), lambda: a.multiply_t(a, "magic"), lambda: engine.random(2, 2, p=None).eliminate()):
        with pytest.raises(ValueError):
            call()


def test_cuts_are_dropped(spark):
    from fieldloom.plans.cuts import cut, drop_cuts, made_so_far

    before = made_so_far(spark)
    a = cut(spark.range(3), "a")
    b = cut(a.selectExpr("id + 1 as id"), "b")
    drop_cuts(spark, before, keep=b)
    assert sorted(r["id"] for r in b.collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(a.inputFiles()[0])
