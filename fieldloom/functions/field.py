"""Arithmetic in GF(p) and in Z/2**32 as column expressions, and work models.

Column expressions run under ANSI mode: nothing here overflows BIGINT for the
stated ranges.  Residues are kept in 0..p-1.
"""

from __future__ import annotations

from math import floor, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest prime below 2**16, the default field.
PRIME = 65521
WORD = 2**32


class SingularMatrixError(ValueError):
    """Elimination without pivoting met a zero pivot; ``pivot`` is its index."""

    def __init__(self, pivot: int):
        super().__init__(f"singular leading minor: pivot {pivot} is zero")
        self.pivot = pivot


def check_prime(p: int) -> int:
    """``p`` if it is a prime below 2**16, else ValueError."""
    if not 2 <= p < 1 << 16 or any(p % d == 0 for d in range(2, int(sqrt(p)) + 1)):
        raise ValueError(f"{p} is not a prime below 65536")
    return p


def neg_inverse(a: int, p: int = PRIME) -> int:
    """p minus the inverse of a; ZeroDivisionError where a is a multiple of p."""
    if a % p == 0:
        raise ZeroDivisionError(f"{a} has no inverse mod {p}")
    return p - pow(a, -1, p)


def inverse_expr(a: str, p: int) -> str:
    """SQL for the inverse of ``a`` mod ``p`` by Fermat, one multiplication chain over the bits of p - 2; 0 for 0."""
    bits = ", ".join(f"{b}L" for b in bin(p - 2)[2:]) if p > 2 else "1L"
    return f"aggregate(array({bits}), 1L, (s, b) -> (s * s % {p}L) * if(b = 1L, pmod({a}, {p}L), 1L) % {p}L)"


def neg_inverse_col(a: str | Column, p: int = PRIME) -> Column:
    """The negated inverse of a BIGINT column; null where there is none."""
    if isinstance(a, str):
        return F.expr(f"nullif({p}L - {inverse_expr(a, p)}, {p}L)")
    holder = F.transform(F.array(a.cast("long")), lambda v: _neg_inverse_of(v, p))
    return holder[0]


def _neg_inverse_of(v: Column, p: int) -> Column:
    one, bits = F.lit(1).cast("long"), F.array(*(F.lit(int(b)).cast("long") for b in (bin(p - 2)[2:] if p > 2 else "1")))
    found = F.aggregate(bits, one, lambda s, b: (s * s % p) * F.when(b == 1, F.pmod(v, F.lit(p).cast("long"))).otherwise(one) % p)
    return F.nullif(F.lit(p).cast("long") - found, F.lit(p).cast("long"))


def mul_u32(a: Column, b: Column) -> Column:
    """a * b mod 2**32 for the full range of both operands, by 16-bit halves of ``a``."""
    high = (F.shiftright(a, 16) * b) % 65536
    return (high * 65536 + a.bitwiseAND(F.lit(65535).cast("long")) * b).bitwiseAND(F.lit(WORD - 1).cast("long"))


def wrap_u32(a: Column) -> Column:
    return a.bitwiseAND(F.lit(WORD - 1).cast("long"))


#: The work model's cost of an inverse mod 65521 (fixed value).
INVERSE_COST = 10


def elimination_flops(m: int, n: int, cost: int = INVERSE_COST) -> int:
    """Operations of eliminating an m x n matrix, an inverse counting as ``cost``."""
    return sum((2 * (n - i) + 1 + cost) * (m - i) + cost * (n - i) * (m - i) for i in range(1, min(m, n) + 1))


def elimination_flops_expr(m: str, n: str, cost: int = INVERSE_COST) -> str:
    """The same as SQL over columns."""
    return f"if(least({m}, {n}) < 1, 0L, aggregate(sequence(1L, least({m}, {n})), 0L, (s, i) -> s + (2 * ({n} - i) + {1 + cost}) * ({m} - i) + {cost} * ({n} - i) * ({m} - i)))"


def multiply_flops(rows: int, inner: int, columns: int) -> int:
    return 2 * rows * inner * columns


def tiled_rate(rows: int, columns: int, tiles: int, seconds: float) -> float:
    """The rate that tiled runs report: 2/9 of rows * columns * tiles, in millions a second."""
    return 2.0 * rows * columns * tiles / 9 / 1e6 / seconds


def elimination_rate(n: int, seconds: float) -> float:
    """Billions of operations a second of eliminating an n x n matrix: 2/3 n**3."""
    return 2.0 * n**3 / 3 / 1e9 / seconds


def cache_tile(level1_bytes: int) -> int:
    """Edge of a tile of which three, of eight-byte values, fit the cache."""
    return floor(sqrt(level1_bytes / 24))


def cache_tile_col(level1_bytes: str) -> Column:
    """:func:`cache_tile` of a column."""
    return F.floor(F.sqrt(F.col(level1_bytes) / 24))


def tile_counts(rows: int, columns: int, tile: int) -> tuple[int, int]:
    """Tiles down and across, the last ones padded."""
    return -(-rows // tile), -(-columns // tile)


def thread_counts(first: int, last: int) -> list[int]:
    """Powers of two from ``first`` to ``last``."""
    return [2**k for k in range(last.bit_length()) if first <= 2**k <= last]


def size_sweep(start: int, step: int, count: int) -> list[int]:
    """``count`` + 1 sizes: ``step`` added each time, or doubling where ``step`` is 0."""
    return [start * 2**k if step == 0 else start + step * k for k in range(count + 1)]
