"""Gaussian elimination without pivoting over GF(p).

The packed result has U on and above the diagonal and the negated multipliers
below it: with N the strictly lower part, (I - N) U equals the input mod p.

All forms agree on the rest: absent cells are zeros, a zero pivot is passed over
where the rows below have a zero in its column, and else the whole matrix raises
SingularMatrixError with the first such pivot (``eliminate_with_status`` and the
form for groups give a column instead).  A matrix without rows or columns has no
cells.  A cell occurs once at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.field import PRIME, SingularMatrixError, check_prime, inverse_expr, neg_inverse
from fieldloom.operators import kernels
from fieldloom.operators.layout import HEAD, TileMatrix, from_rows, pack, to_rows, unpack
from fieldloom.plans.cuts import cut

#: Edges up to which a matrix is folded within one row or gathered, factored within one task, and up to which its shorter side makes it a strip.
FOLD_EDGE, TASK_EDGE, STRIP_EDGE = 48, 1024, 1024
#: Least and greatest edge of a tile (2 MiB a tile at most, 8 as it is worked on), the block steps aimed at, bytes of a strip's blocks, and pivots that a pass each is allowed for.
SMALLEST_TILE, LARGEST_TILE, STEPS, BLOCK_BYTES, MOST_PASSES = 64, 1024, 12, 4 << 20, 256
_CELLS = "i long, j long, v long"


def fold(matrix: str, p: int = PRIME, full: bool = True) -> Column:
    """The packed form of an ``array<array<bigint>>`` column, inside code generation.

    For small matrices, one a row.  Where a zero pivot cannot be passed over, the
    rows that need it are null from its column on.  ``full`` False leaves cells
    below the diagonal as they were when their column was the pivot's.
    """
    shape = f"least(size({matrix}), coalesce(size(get({matrix}, 0)), 0))"
    keep = "m" if full else "if(m is null, m, x)"
    step = f"""
        element_at(transform(array(S[i]), P -> element_at(transform(array(nullif({p}L - {inverse_expr('P[i]', p)}, {p}L)), q ->
            transform(S, (row, r) -> if(r <= i or row[i] = 0L, row, element_at(transform(array(row[i] * q % {p}L), m ->
                transform(row, (x, c) -> if(c < i, x, if(c = i, {keep}, (x + P[c] * m) % {p}L)))), 1)))), 1)), 1)"""
    return F.expr(f"if({shape} < 1, {matrix}, aggregate(sequence(0, {shape} - 1), transform({matrix}, row -> transform(row, x -> pmod(x, {p}L))), (S, i) -> if(i + 1 >= size(S), S, {step})))")


def singular_at(packed: str) -> Column:
    """Index of the first zero pivot of a column that ``fold`` made, or null."""
    shape = f"least(size({packed}), coalesce(size(get({packed}, 0)), 0))"
    return F.expr(f"if({shape} < 1, null, nullif(array_position(transform(sequence(0, {shape} - 1), k -> coalesce({packed}[k][k], 0L)), 0L), 0L) - 1L)")


def _no_cells(matrix: DataFrame) -> DataFrame:
    return matrix.sparkSession.createDataFrame([], _CELLS)


def eliminate_groups(matrix: DataFrame, keys: list[str], p: int = PRIME) -> DataFrame:
    """Factor one small matrix per group: rows keys, i, j, v of the packed forms and singular_at, the first zero pivot.

    A group's matrix is as large as its greatest i and j say; null keys equal one
    another.  Rows that are whole or absent need no join to be filled.
    """
    rows = matrix.groupBy(*keys, "i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("c"))
    held = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("rows"), F.max("i").alias("last_i"), F.max(F.col("c")[F.size("c") - 1]["j"]).alias("last_j"))
    filled = """transform(sequence(0L, last_i), i -> transform(array(coalesce(element_at(rows, i), array())), c ->
        if(size(c) = last_j + 1, c.v, transform(sequence(0L, last_j), j -> coalesce(element_at(map_from_entries(c), j), 0L))))[0])"""
    whole = held.select(*keys, F.expr(filled).alias("m"))
    packed = whole.withColumn("m", fold("m", p)).withColumn("singular_at", singular_at("m"))
    by_row = packed.select(*keys, "singular_at", F.posexplode("m").alias("i", "row"))
    return by_row.select(*keys, F.col("i").cast("long").alias("i"), F.posexplode("row").alias("j", "v"), "singular_at").select(*keys, "i", F.col("j").cast("long").alias("j"), "v", "singular_at")


def eliminate_fold(matrix: DataFrame, rows: int, columns: int, p: int = PRIME, full: bool = True) -> DataFrame:
    """One small matrix (edges up to FOLD_EDGE) as a single row's fold: cells of the packed form, held by the driver."""
    check_prime(p)
    if max(rows, columns) > FOLD_EDGE:
        raise ValueError(f"a matrix of {rows} x {columns} is too large to fold; use eliminate")
    if not rows or not columns:
        return _no_cells(matrix)
    whole = to_rows(matrix, columns, rows).agg(F.array_sort(F.collect_list(F.struct("i", "v")))["v"].alias("m"))
    packed = whole.select(fold("m", p, full).alias("m")).first()["m"]
    failed = [row.index(None) for row in packed if None in row]
    if failed:
        raise SingularMatrixError(min(failed))
    return matrix.sparkSession.createDataFrame([(i, j, v) for i, row in enumerate(packed) for j, v in enumerate(row)], _CELLS)


def eliminate_by_rows(matrix: DataFrame, rows: int, columns: int, p: int = PRIME) -> DataFrame:
    """One written pass over the row arrays a pivot; the pivot row (one row) goes to every task.

    As many jobs as pivots, MOST_PASSES at most: ``eliminate_tiles`` needs a job
    for each of about STEPS blocks.
    """
    check_prime(p)
    pivots = min(rows - 1, columns)
    if pivots > MOST_PASSES:
        raise ValueError(f"{pivots} passes are too many; use eliminate")
    if not rows or not columns:
        return _no_cells(matrix)
    state = cut(to_rows(matrix, columns, rows).select("i", F.transform("v", lambda x: F.pmod(x, F.lit(p).cast("long"))).alias("v")), "rows")
    for k in range(pivots):
        pivot = state.where(F.col("i") == k).first()["v"]
        if pivot[k] == 0:
            if not state.where((F.col("i") > k) & (F.col("v")[k] != 0)).isEmpty():
                raise SingularMatrixError(k)
            continue
        line = F.lit(np.array(pivot, dtype=np.int64))
        m = F.col("v")[k] * neg_inverse(pivot[k], p) % p
        moved = F.zip_with(F.transform("v", lambda x, c: F.struct(x.alias("x"), c.alias("c"))), line, lambda s, y: F.when(s["c"] < k, s["x"]).when(s["c"] == k, F.col("m")).otherwise((s["x"] + y * F.col("m")) % p))
        state = state.withColumn("m", m).select("i", F.when(F.col("i") > k, moved).otherwise(F.col("v")).alias("v"))
        state = cut(state, "rows")
    return from_rows(state)


def leading_square(head: np.ndarray, p: int, first: int) -> tuple[np.ndarray, int | None]:
    """The factored form of a leading square, up to the pivot that fails in it, and that pivot."""
    try:
        return kernels.factor_by_halves(head, p, first=first), None
    except SingularMatrixError as fault:
        done = fault.pivot - first
        return kernels.factor_by_halves(head[:, :done], p, first=first)[:done], fault.pivot


def check_pivots(below: DataFrame, square: np.ndarray, failed: int | None, p: int, first: int, width: int) -> None:
    """Raise for the first pivot that fails, in the leading square or in what is below it: tiles ``t`` that are ``width`` wide, or row arrays ``v``."""
    found = [] if failed is None else [failed]
    done = len(square)
    if (np.diag(square) == 0).any():

        rows = "v" in below.columns

        def probe(frames):
            for pdf in frames:
                out = []
                for t in (np.array(v.tolist(), dtype=np.int64) for v in np.array_split(pdf["v"].to_numpy(), -(-len(pdf) // 1024))) if rows and len(pdf) else pdf["v" if rows else "t"]:
                    try:
                        kernels.solve_column(square, (t if rows else unpack(t, -1, width))[:, :done], p, first)
                    except SingularMatrixError as fault:
                        out.append(fault.pivot)
                yield pd.DataFrame({"pivot": np.array(out, dtype=np.int64)})

        found += [r["k"] for r in below.select("v" if rows else "t").mapInPandas(probe, "pivot long").agg(F.min("pivot").alias("k")).collect() if r["k"] is not None]
    if found:
        raise SingularMatrixError(min(found))


def tile_edge(rows: int, columns: int) -> int:
    """An edge that gives about STEPS block steps, a multiple of 8 between SMALLEST_TILE and LARGEST_TILE."""
    return max(SMALLEST_TILE, min(LARGEST_TILE, -(-min(rows, columns) // STEPS + 7) // 8 * 8))


def eliminate_tiles(matrix: DataFrame, rows: int, columns: int, p: int = PRIME, tile: int | None = None) -> DataFrame:
    """Right-looking elimination by tiles: cells of the packed form.

    A step factors the diagonal tile (one tile, on the driver), then updates
    its row and column of tiles, then joins both to the trailing tiles.  Each
    step's tiles are written, so plans stay short and a lost executor repeats
    one step's tasks at most.
    """
    check_prime(p)
    if not rows or not columns:
        return _no_cells(matrix)
    tile = tile or tile_edge(rows, columns)
    shape, steps = (tile, tile), min(-(-rows // tile), -(-columns // tile))
    schema = "bi long, bj long, t binary"
    left = cut(TileMatrix.of(matrix, rows, columns, tile, identity=True).df, "tiles")
    done = None

    def array(t) -> np.ndarray:
        return unpack(t, *shape)

    for k in range(steps):
        head = array(left.where(f"bi = {k} and bj = {k}").first()["t"])
        diagonal, failed = leading_square(head, p, k * tile)
        check_pivots(left.where(f"bi > {k} and bj = {k}"), diagonal, failed, p, k * tile, tile)

        def panel(frames, k=k, d=diagonal):
            for pdf in frames:
                out = []
                for bi, bj, t in zip(pdf["bi"], pdf["bj"], pdf["t"], strict=True):
                    if len(t) == HEAD and (bi, bj) != (k, k):
                        out.append(t)
                        continue
                    a = d if bi == k and bj == k else kernels.solve_row(d, array(t), p) if bi == k else kernels.solve_column(d, array(t), p, k * tile)
                    out.append(pack(a))
                yield pd.DataFrame({"bi": pdf["bi"], "bj": pdf["bj"], "t": out})

        panels = cut(left.where(f"bi = {k} or bj = {k}").mapInPandas(panel, schema), "panels")
        done = panels if done is None else done.unionByName(panels)
        if k + 1 == steps and -(-rows // tile) == steps and -(-columns // tile) == steps:
            break

        def trailing(frames):
            for pdf in frames:
                out = [c if HEAD in (len(x), len(y)) else pack(kernels.update(array(c), array(x), array(y), p)) for c, x, y in zip(pdf["t"], pdf["x"], pdf["y"], strict=True)]
                yield pd.DataFrame({"bi": pdf["bi"], "bj": pdf["bj"], "t": out})

        column = panels.where(f"bj = {k} and bi > {k}").select("bi", F.col("t").alias("x"))
        row = panels.where(f"bi = {k} and bj > {k}").select("bj", F.col("t").alias("y"))
        rest = left.where(f"bi > {k} and bj > {k}").join(column, "bi").join(row, "bj").select("bi", "bj", "t", "x", "y")
        left = cut(rest.mapInPandas(trailing, schema), "tiles")
    return TileMatrix(done, rows, columns, tile, tile).cells()


def eliminate_strip(matrix: DataFrame, rows: int, columns: int, p: int = PRIME, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A matrix with few columns or few rows (up to STRIP_EDGE) and any number of the others, in one pass.

    The leading square (8 MiB at most) is factored on the driver; the lines of the
    rest need nothing but it.  They are row arrays, of which a task holds one batch
    at a time and works on blocks of ``block_bytes``, so that its memory does not
    grow with their number.
    """
    check_prime(p)
    n, tall = min(rows, columns), rows > columns
    if n > STRIP_EDGE:
        raise ValueError(f"a matrix of {rows} x {columns} is no strip; use eliminate_tiles")
    if not n:
        return _no_cells(matrix)
    along, across = ("i", "j") if tall else ("j", "i")
    head = TileMatrix.of(matrix.where(F.col(along) < n), n, n, n).df.first()["t"]
    d, failed = leading_square(unpack(head, n, n), p, 0)
    lines = matrix.where(F.col(along) >= n).select((F.col(along) - n).alias("i"), F.col(across).alias("j"), "v")
    others = cut(to_rows(lines, n, max(rows, columns) - n), "lines")
    most = max(1, block_bytes // (8 * n))

    def arrays(batch: pa.RecordBatch):
        """Lines of the rest as rows of arrays, with their indices, in blocks."""
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            yield part.column("i"), part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)

    if tall:
        check_pivots(others.select(F.col("v")), d, failed, p, 0, n)
    elif failed is not None:
        raise SingularMatrixError(failed)

    def solve(batches):
        for batch in batches:
            for i, a in arrays(batch):
                out = kernels.solve_column(d, a, p) if tall else kernels.solve_row(d, a.T, p).T
                yield pa.RecordBatch.from_arrays([i, pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(out, dtype=np.int64).ravel()), n).cast(pa.list_(pa.int64()))], ["i", "v"])

    def leading(frames):
        for _ in frames:
            yield pd.DataFrame({"bi": [0], "bj": [0], "t": [pack(d)]})

    first = matrix.sparkSession.range(0, 1, 1, 1).mapInPandas(leading, "bi long, bj long, t binary")
    done = from_rows(others.mapInArrow(solve, "i long, v array<long>"))
    moved = done.select((F.col("i") + n).alias(along), F.col("j").alias(across), "v").select("i", "j", "v")
    return TileMatrix(first, n, n, n, n).cells().unionByName(moved)


def eliminate_by_halves(matrix: DataFrame, rows: int, columns: int, p: int = PRIME, leaf: int = 32) -> DataFrame:
    """One matrix that fits a task (edges up to TASK_EDGE), by recursive halving of the pivots."""
    check_prime(p)
    if max(rows, columns) > TASK_EDGE:
        raise ValueError(f"a matrix of {rows} x {columns} is too large for one task; use eliminate")
    if not rows or not columns:
        return _no_cells(matrix)

    def factor(frames):
        for pdf in frames:
            out = []
            for t in pdf["t"]:
                try:
                    out.append((pack(kernels.factor_by_halves(unpack(t, rows, columns), p, leaf)), -1))
                except SingularMatrixError as fault:
                    out.append((b"", fault.pivot))
            yield pd.DataFrame({"bi": pdf["bi"], "bj": pdf["bj"], "t": [t for t, _ in out], "failed": [k for _, k in out]})

    made = cut(TileMatrix.of(matrix, rows, columns, (rows, columns)).df.mapInPandas(factor, "bi long, bj long, t binary, failed long"), "whole")
    failed = made.select("failed").first()[0]
    if failed >= 0:
        raise SingularMatrixError(failed)
    return TileMatrix(made, rows, columns, rows, columns).cells()


def eliminate_on_driver(matrix: DataFrame, rows: int, columns: int, p: int = PRIME) -> DataFrame:
    """One small matrix (edges up to FOLD_EDGE, so 2,304 cells at most), gathered and factored without a shuffle."""
    check_prime(p)
    if max(rows, columns) > FOLD_EDGE:
        raise ValueError(f"a matrix of {rows} x {columns} is too large to gather; use eliminate")
    if not rows or not columns:
        return _no_cells(matrix)
    held = matrix.select("i", "j", "v").toArrow()
    a = np.zeros((rows, columns), dtype=np.int64)
    a[held["i"].to_numpy(), held["j"].to_numpy()] = held["v"].to_numpy()
    v = kernels.factor_by_halves(a, p)
    i, j = np.indices(v.shape, dtype=np.int64)
    return matrix.sparkSession.createDataFrame(pa.table({"i": i.ravel(), "j": j.ravel(), "v": v.ravel()}))


def eliminate(matrix: DataFrame, rows: int, columns: int, p: int = PRIME) -> DataFrame:
    """The packed form by the form that suits the size: on the driver, one task, a strip or tiles."""
    check_prime(p)
    if max(rows, columns) <= FOLD_EDGE:
        return eliminate_on_driver(matrix, rows, columns, p)
    if max(rows, columns) <= TASK_EDGE:
        return eliminate_by_halves(matrix, rows, columns, p)
    return (eliminate_strip if min(rows, columns) <= STRIP_EDGE else eliminate_tiles)(matrix, rows, columns, p)


def eliminate_with_status(matrix: DataFrame, rows: int, columns: int, p: int = PRIME) -> DataFrame:
    """(i, j, v, singular_at): the packed form, or a single row with the pivot that failed and nulls."""
    try:
        return eliminate(matrix, rows, columns, p).withColumn("singular_at", F.lit(None).cast("long"))
    except SingularMatrixError as fault:
        return matrix.sparkSession.createDataFrame([(None, None, None, fault.pivot)], _CELLS + ", singular_at long")
