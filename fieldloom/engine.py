"""The matrix engine's operations on one kind of object.

    engine = MatrixEngine(spark)
    a = engine.random(4096, 4096, seed=1)
    lu = a.eliminate(strategy="tiles", tile=512)
    lu.check(a.eliminate())
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.field import PRIME, check_prime
from fieldloom.operators import echelon, eliminate, layout, multiply, recursive, verify
from fieldloom.sources import matrices

#: Sizes where none are given, as the command line's: products, elimination by rows or halves, elimination by tiles, and the edge of its tiles.
PRODUCT_EDGE, ELIMINATION_EDGE, TILED_EDGE, TILE = 2000, 2000, 4096, 96
STRATEGIES = ("auto", "driver", "fold", "rows", "halves", "strip", "tiles", "recursive")


@dataclass(frozen=True)
class Matrix:
    """Cells (i, j, v) of a matrix mod ``p``, or of 32-bit words where p is None."""

    df: DataFrame
    rows: int
    columns: int
    p: int | None = PRIME

    def transpose(self) -> Matrix:
        return replace(self, df=layout.transpose(self.df), rows=self.columns, columns=self.rows)

    def padded(self, tile: int) -> Matrix:
        up = lambda n: -(-n // tile) * tile
        return replace(self, df=matrices.padded(self.df, self.rows, self.columns, tile), rows=up(self.rows), columns=up(self.columns))

    def multiply_t(self, other: Matrix, strategy: str = "tiles", tile: int = 256, split: str = "grid", parts: int | None = None) -> Matrix:
        """This matrix times the transpose of ``other``: "tiles", "rows" or "cells" (absent cells where nothing contributes)."""
        if self.columns != other.columns or self.p != other.p:
            raise ValueError("the operands must agree in columns and modulus")
        if strategy == "tiles":
            made = multiply.multiply_tiles(self.df, other.df, self.rows, other.rows, self.columns, self.p, tile, split, parts)
        elif strategy in ("rows", "cells"):
            made = (multiply.multiply_rows if strategy == "rows" else multiply.multiply_cells)(self.df, other.df, self.p)
        else:
            raise ValueError(f"no such strategy: {strategy}")
        return Matrix(made, self.rows, other.rows, self.p)

    def eliminate(self, strategy: str = "auto", tile: int | None = None) -> Matrix:
        """The packed form; ``tile`` is the edge for "tiles" and "recursive", the number of pivots in a leaf for "halves"."""
        if self.p is None:
            raise ValueError("elimination needs a field")
        if strategy not in STRATEGIES:
            raise ValueError(f"no such strategy: {strategy}")
        shape = (self.df, self.rows, self.columns, self.p)
        if strategy in ("tiles", "recursive"):
            made = (eliminate.eliminate_tiles if strategy == "tiles" else recursive.eliminate_recursive)(*shape, tile)
        elif strategy == "halves":
            made = eliminate.eliminate_by_halves(*shape, tile or 32)
        else:
            forms = {"auto": eliminate.eliminate, "driver": eliminate.eliminate_on_driver, "fold": eliminate.eliminate_fold, "rows": eliminate.eliminate_by_rows, "strip": eliminate.eliminate_strip}
            made = forms[strategy](*shape)
        return replace(self, df=made)

    def _square(self) -> int:
        if self.p is None or self.rows != self.columns:
            raise ValueError("only a square matrix over a field has an inverse or a determinant")
        return self.rows

    def solve(self, right: Matrix, tile: int | None = None) -> Matrix:
        """X with this matrix times X equal to ``right``."""
        if right.rows != self._square() or right.p != self.p:
            raise ValueError("the right side must agree in rows and modulus")
        return replace(right, df=recursive.solve(self.df, self.rows, right.df, right.columns, self.p, tile))

    def inverse(self, tile: int | None = None) -> Matrix:
        return replace(self, df=recursive.invert(self.df, self._square(), self.p, tile))

    def determinant(self, tile: int | None = None) -> int:
        return recursive.determinant(self.df, self._square(), self.p, tile)

    def rank(self) -> int:
        """By rows where columns are few, else by columns; one side must be 1024 at most."""
        tall = self.columns <= self.rows
        return echelon.rank(self.df if tall else layout.transpose(self.df), min(self.rows, self.columns), self.p)

    def check(self, other: Matrix, upper_only: bool = True) -> DataFrame:
        """One row: cells compared and cells that differ."""
        return verify.compare(self.df, other.df, upper_only)

    def rebuilt(self) -> Matrix:
        """The matrix that a packed form came from."""
        return replace(self, df=verify.rebuilt(self.df, self.rows, self.columns, self.p))

    def display(self, most: int = 32) -> str:
        return layout.display(self.df, most)


class MatrixEngine:
    """Makes matrices in a session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def random(self, rows: int = TILED_EDGE, columns: int | None = None, p: int | None = PRIME, seed: int = 0) -> Matrix:
        """Values below ``p``, or below 2**31 where p is None."""
        columns = rows if columns is None else columns
        made = matrices.random_words(self.spark, rows, columns, seed) if p is None else matrices.random_field(self.spark, rows, columns, check_prime(p), seed)
        return Matrix(made, rows, columns, p)

    def deterministic(self, rows: int, columns: int | None = None, p: int = PRIME) -> Matrix:
        columns = rows if columns is None else columns
        return Matrix(matrices.deterministic(self.spark, rows, columns, check_prime(p)), rows, columns, p)

    def zeros(self, rows: int, columns: int, p: int | None = PRIME) -> Matrix:
        return Matrix(matrices.zeros(self.spark, rows, columns), rows, columns, p)

    def from_table(self, table: DataFrame, row: Column | str, column: Column | str, value: Column | str, rows: int, columns: int, p: int = PRIME) -> Matrix:
        """``value`` summed over each (row, column) of a table, mod p; cells without rows are absent."""
        r, c, v = (F.col(x) if isinstance(x, str) else x for x in (row, column, value))
        return Matrix(matrices.from_pairs(table, r, c, v, check_prime(p)), rows, columns, p)

    def from_vectors(self, table: DataFrame, row: str, vector: str, rows: int, columns: int, scale: int = 1000, p: int = PRIME) -> Matrix:
        return Matrix(matrices.from_vectors(table, row, vector, scale, check_prime(p)), rows, columns, p)
