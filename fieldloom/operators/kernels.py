"""Numpy kernels on dense tiles over GF(p), p < 2**16.

A factored tile holds U on and above the diagonal and negated multipliers below:
with N its strictly lower part, (I - N) U is the tile it came from, mod p.
"""

from __future__ import annotations

import numpy as np

from fieldloom.functions.field import SingularMatrixError, neg_inverse


def product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b mod p; exact in doubles while inner * (p - 1)**2 stays below 2**53."""
    step = max(1, (2**53 - 1) // (p - 1) ** 2)
    if a.shape[1] <= step:
        return (a.astype(np.float64) @ b.astype(np.float64) % p).astype(np.int64)
    return sum(product(a[:, k : k + step], b[k : k + step], p) for k in range(0, a.shape[1], step)) % p


def product_u32(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b mod 2**32, by 16-bit halves: their products are exact in doubles, and the one of both high halves vanishes."""
    step = 1 << 20
    if a.shape[1] > step:
        return sum(product_u32(a[:, k : k + step], b[k : k + step]) for k in range(0, a.shape[1], step)) & 0xFFFFFFFF
    al, ah, bl, bh = (x.astype(np.float64) for x in (a & 0xFFFF, a >> 16, b & 0xFFFF, b >> 16))
    middle = (ah @ bl).astype(np.int64) + (al @ bh).astype(np.int64)
    return ((al @ bl).astype(np.int64) + ((middle & 0xFFFF) << 16)) & 0xFFFFFFFF


def factor(t: np.ndarray, p: int, first: int = 0) -> np.ndarray:
    """The factored form of a tile; ``first`` is the index of its first pivot, for the error."""
    a = t % p
    for k in range(min(a.shape)):
        if k + 1 == a.shape[0]:
            break
        if a[k, k] == 0:
            if a[k + 1 :, k].any():
                raise SingularMatrixError(first + k)
            continue
        a[k + 1 :, k] = a[k + 1 :, k] * neg_inverse(int(a[k, k]), p) % p
        a[k + 1 :, k + 1 :] = (a[k + 1 :, k + 1 :] + np.outer(a[k + 1 :, k], a[k, k + 1 :])) % p
    return a


def solve_row(d: np.ndarray, t: np.ndarray, p: int, leaf: int = 32) -> np.ndarray:
    """A tile right of the factored diagonal tile ``d``, after d's row operations."""
    n = len(d)
    if n > leaf:
        h = n // 2
        top = solve_row(d[:h, :h], t[:h], p, leaf)
        return np.vstack([top, solve_row(d[h:, h:], update(t[h:], d[h:, :h], top, p), p, leaf)])
    a = t % p
    for k in range(n - 1):
        a[k + 1 :] = (a[k + 1 :] + np.outer(d[k + 1 :, k], a[k])) % p
    return a


def solve_column(d: np.ndarray, t: np.ndarray, p: int, first: int = 0, leaf: int = 32) -> np.ndarray:
    """Negated multipliers that clear a tile below the factored diagonal tile ``d``; ``first``: the index of its first pivot."""
    n = len(d)
    if n > leaf:
        h = n // 2
        left = solve_column(d[:h, :h], t[:, :h], p, first, leaf)
        return np.hstack([left, solve_column(d[h:, h:], update(t[:, h:], left, d[:h, h:], p), p, first + h, leaf)])
    a = t % p
    for k in range(n):
        if d[k, k] == 0:
            if a[:, k].any():
                raise SingularMatrixError(first + k)
            continue
        a[:, k] = a[:, k] * neg_inverse(int(d[k, k]), p) % p
        a[:, k + 1 :] = (a[:, k + 1 :] + np.outer(a[:, k], d[k, k + 1 :])) % p
    return a


def update(c: np.ndarray, a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    return (c + product(a, b, p)) % p


def factor_by_halves(t: np.ndarray, p: int, leaf: int = 32, first: int = 0) -> np.ndarray:
    """``factor`` for any shape: the columns of the pivots are halved until a panel has at most ``leaf`` of them.

    Panels are as high as the matrix, so the first pivot that fails is the one found.
    """
    a = t % p
    n = min(a.shape)
    if a.shape[1] > n:  # wide: the square first, then what is right of it
        left = factor_by_halves(a[:, :n], p, leaf, first)
        return np.hstack([left, solve_row(left, a[:, n:], p, leaf)])
    if n <= leaf:
        return factor(a, p, first)
    h = n // 2
    left = factor_by_halves(a[:, :h], p, leaf, first)
    right = solve_row(left[:h], a[:h, h:], p, leaf)
    rest = factor_by_halves(update(a[h:, h:], left[h:], right, p), p, leaf, first + h)
    return np.block([[left[:h], right], [left[h:], rest]])


def first_independent(a: np.ndarray, p: int) -> np.ndarray:
    """Indices of the rows that are no combination of the rows before them."""
    left, basis, pivots, found = a % p, np.zeros((0, a.shape[1]), dtype=np.int64), [], []
    for r in range(len(left)):
        row = left[r]
        if pivots and row[pivots].any():
            row = (row + product((p - row[pivots])[None, :], basis, p)[0]) % p
        at = np.flatnonzero(row)
        if not at.size:
            continue
        c = int(at[0])
        row = row * (p - neg_inverse(int(row[c]), p)) % p
        basis = (basis - basis[:, c : c + 1] * row) % p if len(basis) else basis
        basis = np.vstack([basis, row])
        pivots.append(c)
        found.append(r)
        if len(found) == a.shape[1]:
            break
    return np.array(found, dtype=np.int64)


def reduced(a: np.ndarray, p: int) -> tuple[np.ndarray, list[int], list[int]]:
    """The reduced echelon form without its zero rows, its pivot columns, and the row of ``a`` that each pivot was taken from (the first that served)."""
    m, pivots, order = a % p, [], []
    free = np.ones(len(m), dtype=bool)
    for c in range(m.shape[1]):
        at = np.flatnonzero(free & (m[:, c] != 0))
        if not at.size:
            continue
        r = int(at[0])
        m[r] = m[r] * (p - neg_inverse(int(m[r, c]), p)) % p
        others = np.arange(len(m)) != r
        m[others] = (m[others] + (p - m[others, c : c + 1]) * m[r]) % p
        free[r] = False
        pivots.append(c)
        order.append(r)
    return m[order], pivots, order
