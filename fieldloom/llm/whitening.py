"""Embedding whitening from a compensated covariance.

Vectors are quantised to integers; each distinct one counts once in the fit.
Centred outer products are summed in double-double: a block of centred vectors is
split into slices of so few bits that the products of two slices, summed over the
block, are exact doubles (an error-free transformation of the whole block), and
these sums are added with two-sum, so that only the low parts are ever rounded.
Tasks emit the high and low parts of their sums, which are merged in two levels.
The covariance (dimension squared, whatever the number of vectors) is the only
thing that reaches the driver; LAPACK's ``syevd`` reduces it to a tridiagonal
matrix and solves that by divide and conquer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import cut, table
from fieldloom.llm.memory import tidy

#: Components kept, and the integers that stand for an entry c: floor(SCALE * c) + ORIGIN.
COMPONENTS, SCALE, ORIGIN = 16, 64, 1_000_000
#: Vectors in a block, slices of a value and bits of a slice: BLOCK * 2**(2 * BITS) stays below 2**53.
BLOCK, SLICES, BITS = 1024, 4, 21
#: Groups that the parts of the sums meet in before they meet in one.
FAN = 64
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b rounded, and what the rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def added(high: np.ndarray, low: np.ndarray, more: np.ndarray, more_low: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The double-double high + low with another one added."""
    s, lost = two_sum(high, more)
    lost = lost + (low + more_low)
    total = s + lost
    return total, lost - (total - s)


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """SLICES matrices that sum to high + low up to 2**-(BITS * SLICES) of each column's largest value.

    A slice's values are multiples of a unit of its column and at most 2**BITS of it.
    """
    top = np.frexp(np.abs(high).max(axis=0))[1]
    out = []
    for k in range(1, SLICES + 1):
        unit = np.ldexp(1.0, top - BITS * k)
        piece = np.rint(high / unit) * unit
        out.append(piece)
        high, low = added(high - piece, low, np.zeros_like(high))
    return out


def outer_sums(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the outer products of the rows of high + low (BLOCK at most), in double-double."""
    parts = slices(high, low)
    total = rest = np.zeros((high.shape[1], high.shape[1]))
    for a in range(SLICES):
        for b in range(a, SLICES - a):
            exact = parts[a].T @ parts[b]
            for term in (exact,) if a == b else (exact, exact.T):
                total, rest = added(total, rest, term)
    return total, rest


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _partial_sums(width: int, centre: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]):
    """A partition's sum of outer products of centred vectors, a row a dimension."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = rest = None
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            for at in range(0, len(x), BLOCK):
                more = outer_sums(*centre(x[at : at + BLOCK]))
                total, rest = more if total is None else added(total, rest, *more)
        if total is not None:
            part = np.full(len(total), TaskContext.get().partitionId(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.arange(len(total))), pa.array(list(total)), pa.array(list(rest))], ["part", "i", "high", "low"])

    return run


def _merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    total, rest = np.asarray(pdf["high"].iloc[0]), np.asarray(pdf["low"].iloc[0])
    for high, low in zip(pdf["high"].iloc[1:], pdf["low"].iloc[1:], strict=True):
        total, rest = added(total, rest, np.asarray(high), np.asarray(low))
    return pd.DataFrame({"i": [key[0]], "high": [total.tolist()], "low": [rest.tolist()]})


def second_moments(vectors: DataFrame, width: int, centre: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Sum of the outer products of ``centre(x)`` over all rows (x array), over n; every group has as many rows as tasks over FAN, or FAN."""
    sums = vectors.select("x").mapInArrow(_partial_sums(width, centre), "part long, i long, high array<double>, low array<double>")
    once = sums.groupBy("i", (F.col("part") % FAN).alias("part")).applyInPandas(_merged, "i long, high array<double>, low array<double>")
    rows = sorted(once.groupBy("i").applyInPandas(_merged, "i long, high array<double>, low array<double>").collect(), key=lambda r: r["i"])
    return np.array([r["high"] for r in rows]) / n + np.array([r["low"] for r in rows]) / n


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` learns; ``axes`` has a unit component a column, ``variances`` their eigenvalues, falling."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """sums / n in double-double."""
        high = np.array([s / self.n for s in self.sums])
        low = []
        for s, h in zip(self.sums, high, strict=True):
            a, b = h.as_integer_ratio()
            low.append((s * b - a * self.n) / (self.n * b))
        return high, np.array(low)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high, low = self.mean
        return added(x.astype(np.float64), -low, -high)

    def project(self, x: np.ndarray) -> np.ndarray:
        high, low = self.centred(x)
        return (high @ self.axes + low @ self.axes) / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - sums)**2, exactly; OverflowError beyond 63 bits."""
        near = np.array([s // self.n for s in self.sums], dtype=np.int64)
        left = np.array([s % self.n for s in self.sums], dtype=np.int64)
        far = x - near
        if len(x) and (float(np.abs(far).max()) + 1) ** 2 * float(self.n) ** 2 * x.shape[1] >= 2**63:
            raise OverflowError("a deviation does not fit 63 bits")
        return ((far * self.n - left) ** 2).sum(axis=1)


def quantised(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE, origin: int = ORIGIN) -> DataFrame:
    """(vec_id, x): rows whose vector is whole, its entries c as the integers floor(scale * c) + origin.

    Rows whose vector is null or has null or non-finite entries are dropped, and
    so are those whose vectors have another length than most (ties: the longer):
    entries that are not there count as null.  Empty vectors are no vectors.
    """
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    lengths = whole.groupBy(F.size("v").alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("k")).limit(1).collect()
    if not lengths:
        return whole.select("vec_id", F.col("v").cast("array<bigint>").alias("x"))
    return whole.where(F.size("v") == lengths[0]["k"]).select("vec_id", F.expr(f"transform(v, c -> floor({scale}D * c) + {origin}L)").alias("x"))


def _totals(width: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, dtype=np.int64)
        for batch in batches:
            n += batch.num_rows
            total += _matrix(batch.column("x"), width).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], ["n", "total"])

    return run


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on each distinct vector of ``quantised`` rows once; None without rows.

    Components without spread (eigenvalue within rounding of 0) are left out, so
    a single distinct vector has none.
    """
    distinct = cut(x.select("x").distinct(), "fit")
    first = distinct.select(F.size("x").alias("k")).first()
    if first is None:
        return None
    width = first["k"]
    parts = distinct.mapInArrow(_totals(width), "n long, total array<long>")
    sums = parts.select("n", F.posexplode("total").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    model = Whitening(sums[0]["n"], tuple(r["s"] for r in sums), np.zeros((width, 0)), np.zeros(0), 0.0)
    covariance = second_moments(distinct, width, model.centred, model.n)
    variances, axes = np.linalg.eigh(covariance)
    kept = [k for k in range(width - 1, -1, -1) if variances[k] > width * np.finfo(float).eps * variances[-1]][:components]
    model = Whitening(model.n, model.sums, axes[:, kept], variances[kept], float(np.trace(covariance)))
    if not kept:
        return model
    spread = second_moments(distinct, width, lambda v, m=model: (m.project(v), np.zeros((len(v), len(m.variances)))), model.n)
    return Whitening(model.n, model.sums, model.axes, model.variances, model.trace, float(np.abs(spread - np.eye(len(kept))).max()))


def whitened(x: DataFrame, model: Whitening) -> DataFrame:
    """A row per quantised row and component, numbered from 1: n, deviation, whitened, explained, identity_error."""
    width, many = len(model.sums), len(model.variances)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("x"), width)
            rows = len(v)
            columns = [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), many))), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), rows)), pa.array(np.full(rows * many, model.n)),
                pa.array(np.repeat(model.deviations(v), many)), pa.array(model.project(v).ravel()), pa.array(np.tile(model.variances / model.trace, rows)), pa.array(np.full(rows * many, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, _OUT)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole vectors of ``embeddings`` on their first components.

    Repeated rows each have their own result; null vec_ids stay; a table without
    whole vectors gives no rows.
    """
    x = quantised(table(spark, sf_dir, "embeddings"))
    model = fit(x)
    return spark.createDataFrame([], _OUT) if model is None else whitened(x, model)


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
#: No SQL: the eigenvectors are tested against exact rational sums and their defining equations.
ORACLES: dict[str, str] = {}
