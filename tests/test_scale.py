"""What must not grow faster than the input: rows sent, bytes of tiles, edges, memory of a task."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom import queries
from fieldloom.functions.field import PRIME as P
from fieldloom.functions.field import SingularMatrixError
from fieldloom.operators import eliminate, kernels, layout, multiply, recursive, verify


def test_sparse_products_add_up_within_tasks(spark):
    """Blocks along the diagonal, one after the other: a task's terms meet before the shuffle, so few rows are sent."""
    blocks, edge, inner = 16, 6, 40
    k = F.col("id")
    a = spark.range(blocks * edge * inner).select((F.expr(f"id div {edge * inner}") * edge + k % edge).alias("i"), F.expr(f"id div {edge}").alias("j"), (k % 97 + 1).alias("v"))
    large = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as it is with large tables
    for name, value in large.items():
        spark.conf.set(name, value)
    try:
        made = multiply.multiply_cells(a, a)
        rows = made.collect()
    finally:
        for name in large:
            spark.conf.unset(name)
    assert len(rows) == blocks * edge * edge

    plan = made._jdf.queryExecution().executedPlan()
    while plan.nodeName() != "Exchange":  # the last one
        plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan() if "QueryStage" in plan.nodeName() else plan.children().apply(0)
    sent = plan.metrics().apply("shuffleRecordsWritten").value()
    assert 0 < sent <= 2 * len(rows)


@pytest.mark.parametrize("p", [P, None])
def test_sparse_products_of_long_lists(spark, monkeypatch, p):
    """Inner indices with more rows than a list holds, few pairs a task, and keys of which one is null."""
    monkeypatch.setattr(multiply, "PIECE", 3)
    monkeypatch.setattr(multiply, "PAIRS", 20)
    r = np.random.default_rng(1)
    cells = [(g, i, j, int(r.integers(P if p else 1 << 32))) for g in (None, 1) for i in range(11) for j in (0, 2, 5) if j or i % 2]
    a = spark.createDataFrame(cells, "g long, i long, j long, v long")
    found = {(x["g"], x["i"], x["j"]): x["v"] for x in multiply.multiply_cells(a, a, p, ("g",)).collect()}
    want: dict = {}
    for g, i, j, v in cells:
        for h, m, n, w in cells:
            if g == h and j == n:
                want[g, i, m] = (want.get((g, i, m), 0) + v * w) % (p or 1 << 32)
    assert found == want


@pytest.mark.parametrize("t", [np.zeros((5, 7)), np.arange(35).reshape(5, 7), np.eye(5, 7) * -3, np.eye(5, 7) * 65535, np.full((5, 7), 65536), np.full((5, 7), 1 << 32), np.eye(40) * (1 << 40), np.zeros((0, 3))])
def test_tiles_are_packed_without_loss(t):
    t = t.astype(np.int64)
    packed = layout.pack(t)
    assert (layout.unpack(packed, *t.shape) == t).all() and len(packed) <= layout.HEAD + 8 * t.size
    if not t.any():
        assert len(packed) == layout.HEAD


def test_tiles_hold_few_bytes(spark):
    """Residues below 2**16 take two bytes, a tile of zeros a head alone."""
    n, edge = 256, 64
    m = spark.range(n * n).select(F.expr(f"id div {n}").alias("i"), (F.col("id") % n).alias("j"), (F.col("id") % P).alias("v")).where(f"i div {edge} = j div {edge}")
    sizes = [r[0] for r in layout.TileMatrix.of(m, n, n, edge).df.select(F.length("t")).collect()]
    assert len(sizes) == 16 and sorted(sizes)[:12] == [layout.HEAD] * 12 and max(sizes) <= layout.HEAD + 2 * edge * edge


def test_recursive_tiles_have_a_greatest_edge(spark, monkeypatch):
    """An edge that grows with the matrix is cut to the greatest one; blocks along the diagonal leave tiles of zeros, and results are those of the whole."""
    monkeypatch.setattr(recursive, "LARGEST_TILE", 8)
    monkeypatch.setattr(recursive, "CELLS", 50)
    r, n = np.random.default_rng(5), 24
    a = np.zeros((n, n), dtype=np.int64)
    for at in range(0, n, 6):
        a[at : at + 6, at : at + 6] = r.integers(1, P, (6, 6))
    m = spark.createDataFrame([(int(i), int(j), int(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i long, j long, v long")
    made = recursive.factor(m, n, n, tile=24)
    assert made.tile == 8 and made.steps == 3
    got, inverse = np.full((n, n), -1), np.full((n, n), -1)
    for x in made.cells().collect():
        got[x["i"], x["j"]] = x["v"]
    assert (got == kernels.factor_by_halves(a, P)).all()
    for x in recursive.invert(m, n, tile=24).collect():
        inverse[x["i"], x["j"]] = x["v"]
    assert (kernels.product(a, inverse, P) == np.eye(n)).all()


def test_greatest_edge_of_a_tile(spark, monkeypatch):
    """A hundred tiles, the fewest that Parquet's writer holds, stay below 1 GB; a sparse matrix is eliminated up to the pivot that fails."""
    assert 100 * 8 * eliminate.tile_edge(60_000, 60_000) ** 2 < 1 << 30
    monkeypatch.setattr(eliminate, "TASK_EDGE", 8)
    monkeypatch.setattr(eliminate, "STRIP_EDGE", 8)
    n = 200
    m = spark.range(n).select("id", ((F.col("id") * 7 + F.col("id") % 3) % n).alias("j"), F.lit(1).cast("long").alias("v")).toDF("i", "j", "v")
    a = np.zeros((n, n), dtype=np.int64)
    a[np.arange(n), (np.arange(n) * 7 + np.arange(n) % 3) % n] = 1
    with pytest.raises(SingularMatrixError) as fault:
        kernels.factor(a, P)
    assert [r[0] for r in eliminate.eliminate_with_status(m, n, n).select("singular_at").distinct().collect()] == [fault.value.pivot]


@pytest.mark.parametrize("tall", [True, False])
def test_strips_are_taken_line_by_line(spark, monkeypatch, tall):
    """What a task is given at once are lines, not blocks of megabytes; an empty line and a passed-over pivot are kept."""
    n, many, written = 4, 3000, []
    a = np.random.default_rng(7).integers(0, P, (many, n))
    a[:, 2] = 0
    a[50] = 0
    a = a if tall else np.ascontiguousarray(a.T)
    if not tall:
        a[2] = a[0]  # a zero pivot with a zero line below it would fail instead
        a[2, 2] = (a[2, 2] + 1) % P
    m = spark.createDataFrame([(int(i), int(j), int(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i long, j long, v long")
    whole = eliminate.cut
    monkeypatch.setattr(eliminate, "cut", lambda df, name: written.append(whole(df, name)) or written[-1])
    got = np.full(a.shape, -1)
    for x in eliminate.eliminate_strip(m, *a.shape, block_bytes=1 << 10).collect():
        got[x["i"], x["j"]] = x["v"]
    assert (got == kernels.factor_by_halves(a, P)).all()
    assert [(df.columns, df.count()) for df in written] == [(["i", "v"], many - n)]


def test_small_systems_are_solved_line_by_line(spark, monkeypatch):
    """Right sides are no tiles, which a task would hold by the thousand; an empty right side has a solution of zeros."""
    monkeypatch.setattr(recursive, "LINE_BYTES", 8 * 7 * 3)
    r, n, many = np.random.default_rng(11), 7, 500
    a, b = r.integers(0, P, (n, n)), r.integers(0, P, (n, many))
    b[:, 3] = 0
    df = lambda x: spark.createDataFrame([(int(i), int(j), int(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "i long, j long, v long")
    of, tiled = layout.TileMatrix.of.__func__, []
    monkeypatch.setattr(layout.TileMatrix, "of", classmethod(lambda cls, m, rows, columns, *more, **named: tiled.append((rows, columns)) or of(cls, m, rows, columns, *more, **named)))
    x = np.full((n, many), -1)
    for c in recursive.solve(df(a), n, df(b), many, tile=3).collect():
        x[c["i"], c["j"]] = c["v"]
    assert (kernels.product(a, x, P) == b).all() and tiled == [(n, n)]


def test_status_of_keys_with_gaps(spark, tmp_path):
    """Suppliers whose keys are beyond their number have no place in the matrix: no error, and no part in a pivot."""
    nation = {0: 0, 1: 4, 2: 0, 3: 4, 8: 3, 9: 1}  # without the last two: ones at (0, 0), (1, 5), (2, 2), (3, 1)
    spark.createDataFrame(list(nation.items()), "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    assert {r["matrix"]: r["singular_at"] for r in queries.lu_status(spark, str(tmp_path)).collect()}["suppliers"] == 1


def shuffled_rows(df) -> list[int]:
    """Rows that each exchange of a plan that ran has written."""
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        plan = left.pop()
        if plan.nodeName() == "Exchange":
            found.append(plan.metrics().apply("shuffleRecordsWritten").value())
        below = plan.children()
        left += [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in plan.nodeName() else [below.apply(k) for k in range(below.size())]
    return found


@pytest.mark.parametrize("modulus", [P, None, (4194301, 4194287)])
def test_blocks_are_made_whole_in_a_task(spark, monkeypatch, modulus):
    """Many blocks of a product and several inner tiles: tiles are sent once to a row or column of the grid, and no partial sums are sent."""
    r, n, inner, edge = np.random.default_rng(41), 36, 20, 4
    monkeypatch.setattr(multiply, "HELD_BYTES", 10 * 8 * edge * edge)
    most = 5 if isinstance(modulus, tuple) else 10
    a, b, c = r.integers(0, 1 << 16, (n, inner)), r.integers(0, 1 << 16, (inner, n)), r.integers(0, 1 << 16, (n, n))
    a[4:8], b[:, 8:12], b[4:8], c[:, 12:16] = 0, 0, 0, 0
    df = lambda x: spark.createDataFrame([(i // edge, j // edge, bytearray(layout.pack(x[i : i + edge, j : j + edge]))) for i in range(0, x.shape[0], edge) for j in range(0, x.shape[1], edge)], "bi long, bj long, t binary")
    for k, plus in ((inner, None), (edge, None), (inner, df(c)), (edge, df(c))):  # several inner tiles and one
        x, y = df(a[:, :k]).toDF("bi", "bk", "x"), df(b[:k]).toDF("bk", "bj", "y")
        if isinstance(modulus, tuple) and plus is not None:
            continue
        made = multiply.sum_products(x, y, 9, 9, k // edge, (edge, edge, edge), modulus, plus=plus)
        tiles = made.collect()
        assert len({(t["bi"], t["bj"]) for t in tiles}) == len(tiles) == 81
        want = a[:, :k] @ b[:k] + (0 if plus is None else c)
        for t in tiles:
            block = want[t["bi"] * edge :, t["bj"] * edge :][:edge, :edge]
            assert (layout.unpack(t["t"], -1, edge, edge) == np.stack([block % q for q in (modulus if isinstance(modulus, tuple) else (modulus or 1 << 32,))])).all()
        high, wide = multiply.grid_of(9, 9, 1, multiply.WHOLE * 4, "grid", 1 if k == edge and plus is None else -(-81 // most))
        assert sum(shuffled_rows(made)) == 9 * (k // edge) * (high + wide) + (0 if plus is None else 81)


@pytest.mark.parametrize(("rows", "columns"), [(50, 50), (61, 40), (40, 61)])
def test_probable_check_shuffles_no_cells(spark, rows, columns):
    """From tiles, rows of sums alone are sent; one wrong cell is found, and both forms tell the same."""
    a = np.random.default_rng(31).integers(0, P, (rows, columns))
    m = spark.createDataFrame([(int(i), int(j), int(a[i, j])) for i, j in np.ndindex(*a.shape)], "i long, j long, v long")
    made = recursive.factor(m, rows, columns, tile=16)
    right = verify.probably_factored(made, m)
    assert tuple(right.collect()[0]) == (rows, 0, P**-2.0) == tuple(verify.probably_factors(made.cells(), m).first())
    assert 0 < max(shuffled_rows(right)) < rows * columns // 4
    for at in ((3, 7), (7, 3), (rows - 1, columns - 1)):
        wrong = made.with_added(*at, 1)
        assert verify.probably_factored(wrong, m).first()["failing"] == verify.probably_factors(wrong.cells(), m).first()["failing"] > 0
    assert tuple(verify.probably_factored(recursive.factor(m.where("false"), 0, 0), m.where("false")).first())[:2] == (0, 0)


@pytest.mark.parametrize("modulus", [P, None])
def test_symmetric_products_are_made_once_and_take_half_the_bytes(spark, tmp_path, monkeypatch, modulus):
    """A matrix times its own transpose: no block below the diagonal is made, every cell is there once, and files hold each value with its mirror image."""
    n, inner = 700, 40
    a = np.random.default_rng(51).integers(0, P, (n, inner)) * (1 if modulus else 65537)
    m = spark.createDataFrame([(i, j, int(a[i, j])) for i, j in np.ndindex(*a.shape)], "i long, j long, v long")
    multiply.multiply_tiles(m, m, n, n, inner, modulus, 256).coalesce(1).write.parquet(f"{tmp_path}/c")
    cells = spark.read.parquet(f"{tmp_path}/c").toPandas()
    want = a.astype(object) @ a.T.astype(object) % (modulus or 1 << 32)
    assert len(cells) == n * n and len(set(cells["i"] * n + cells["j"])) == n * n and (want[cells["i"], cells["j"]] == cells["v"]).all()
    assert sum(f.stat().st_size for f in (tmp_path / "c").glob("*.parquet")) < (2.6 if modulus else 4.6) * n * n  # 4.4 and 6.5 where images are not together (check_s)

    made, shape = [], {"tile": 256}
    tiles_of = multiply.sum_products
    monkeypatch.setattr(multiply, "sum_products", lambda *x, **y: made.append(tiles_of(*x, **y)) or made[-1])
    for parts in (1, 40):  # blocks made whole in a task, and partial sums
        assert multiply.multiply_tiles(m, m, n, n, inner, modulus, **shape, parts=None if parts == 1 else parts).count() == n * n
        assert sorted(map(tuple, made[-1].select("bi", "bj").collect())) == [(i, j) for i in range(3) for j in range(i, 3)]
    assert multiply.multiply_tiles(m, m.where("true"), n, n, inner, modulus, **shape).count() == n * n and made[-1].count() == 9
