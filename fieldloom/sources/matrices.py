"""Matrices as relations (i, j, v), generated or taken from tables.

Every generator is a function of the cell's index alone, so it gives the same
matrix under any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.field import PRIME, WORD


def cells(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """All index pairs (i, j), from 0."""
    n = F.lit(columns).cast("long")
    return spark.range(rows * columns).select(F.floor(F.col("id") / n).cast("long").alias("i"), (F.col("id") % n).alias("j"))


#: Rounds of the generator: multipliers below MODULUS, the least prime above 2**31, so that no product leaves 63 bits.
MODULUS, MULTIPLIERS = 2147483659, (1103515245, 1597334677, 747796405)


def _drawn(seed: int, bound: int) -> Column:
    """A value below ``bound`` (at most MODULUS) from the cell's index, which must stay below 2**31, and the seed, by multiplication and shifts."""
    modulus = F.lit(MODULUS).cast("long")
    x = (F.col("i") * 1664525 + F.col("j") * 22695477 + F.lit(seed * 40503 + 12345).cast("long")) % modulus
    for m in MULTIPLIERS:
        x = x.bitwiseXOR(F.shiftright(x, 15)) % modulus * m % modulus
    return (x % bound).alias("v")


def random_words(spark: SparkSession, rows: int, columns: int, seed: int = 0) -> DataFrame:
    """Values 0 .. 2**31 - 1."""
    return cells(spark, rows, columns).select("i", "j", _drawn(seed, 1 << 31))


def random_small(spark: SparkSession, rows: int, columns: int, seed: int = 0) -> DataFrame:
    """Values 0 .. 19."""
    return cells(spark, rows, columns).select("i", "j", _drawn(seed, 20))


def random_field(spark: SparkSession, rows: int, columns: int, p: int = PRIME, seed: int = 0) -> DataFrame:
    """Values 0 .. p - 1."""
    return cells(spark, rows, columns).select("i", "j", _drawn(seed, p))


def deterministic(spark: SparkSession, rows: int, columns: int, p: int = PRIME) -> DataFrame:
    """0 right of the diagonal's cell, else j - columns + i + rows - 17 as a 32-bit word, mod p."""
    word = F.pmod(F.col("j") - columns + rows + F.col("i") - 17, F.lit(WORD).cast("long")) % p
    return cells(spark, rows, columns).select("i", "j", F.when(F.col("j") == F.col("i") + 1, F.lit(0).cast("long")).otherwise(word).alias("v"))


def zeros(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    return cells(spark, rows, columns).select("i", "j", F.lit(0).cast("long").alias("v"))


def padded(matrix: DataFrame, rows: int, columns: int, tile: int) -> DataFrame:
    """``matrix`` (rows x columns) with a border up to multiples of ``tile``: 1 on the diagonal, 0 elsewhere."""
    high, wide = -(-rows // tile) * tile, -(-columns // tile) * tile
    border = cells(matrix.sparkSession, high, wide).where((F.col("i") >= rows) | (F.col("j") >= columns))
    return matrix.select("i", "j", "v").unionByName(border.select("i", "j", (F.col("i") == F.col("j")).cast("long").alias("v")))


def from_vectors(table: DataFrame, row: str, vector: str, scale: int = 1000, p: int = PRIME) -> DataFrame:
    """Rows of float vectors, times ``scale``, rounded down, mod p."""
    long = table.select(F.col(row).cast("long").alias("i"), F.posexplode(vector).alias("j", "x"))
    return long.select("i", F.col("j").cast("long").alias("j"), F.pmod(F.floor(F.col("x").cast("double") * scale), F.lit(p).cast("long")).alias("v"))


def from_pairs(table: DataFrame, row: Column, column: Column, value: Column, p: int = PRIME) -> DataFrame:
    """A sparse matrix: ``value`` summed over the rows of each (row, column), mod p; cells without rows are absent."""
    return table.groupBy(row.cast("long").alias("i"), column.cast("long").alias("j")).agg((F.sum(value.cast("long")) % p).alias("v"))
