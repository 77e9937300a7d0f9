"""Rank, echelon form and pivoted factors of matrices of any rank, with any number of rows and few columns.

Rows are chosen by tournament: each task keeps those of its rows that are no
combination of its earlier ones, at most as many as there are columns, and groups of
FAN such sets are merged by the same rule until one is left.  A row that depends on
earlier rows of its own task depends on earlier rows of the whole, so the winners
are the first independent rows of the matrix, however it was divided.  What depends
on the winners alone (columns squared at most, 8 MiB) is made in one task.

Wide matrices are transposed by the caller: the first independent rows of the
transpose are the first independent columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.field import PRIME, check_prime
from fieldloom.operators import kernels
from fieldloom.operators.eliminate import STRIP_EDGE, eliminate_strip
from fieldloom.operators.layout import to_rows
from fieldloom.plans.cuts import cut

#: Sets of rows that are merged at once, and rows that a task reduces at once.
FAN, BLOCK = 8, 1024
_ROWS = "part long, i long, v array<long>"


def _winners(rows: pd.DataFrame, p: int) -> pd.DataFrame:
    """The first independent ones of rows (i, v)."""
    rows = rows.sort_values("i", kind="stable")
    kept = kernels.first_independent(np.array(rows["v"].tolist(), dtype=np.int64), p)
    return rows.iloc[kept]


def independent_rows(matrix: DataFrame, columns: int, p: int = PRIME) -> DataFrame:
    """(i, v): the rows that are no combination of rows of smaller i, as arrays of ``columns`` residues; as many as the rank.

    Absent cells are 0, so rows without cells are never among them.
    """
    check_prime(p)
    if columns > STRIP_EDGE:
        raise ValueError(f"{columns} columns are too many; transpose the matrix or eliminate it by tiles")
    rows = to_rows(matrix.withColumn("v", F.pmod("v", F.lit(p).cast("long"))), columns).withColumn("part", F.spark_partition_id().cast("long"))
    if not columns:
        return rows.where("false").select("i", "v")

    def local(frames):
        held, part = None, 0
        for pdf in frames:
            part = int(pdf["part"].iloc[0]) if len(pdf) else part
            for at in range(0, len(pdf), BLOCK):
                more = pdf.iloc[at : at + BLOCK]
                held = _winners(more if held is None else pd.concat([held, more]), p)
        if held is not None:
            yield held.assign(part=part)[["part", "i", "v"]]

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        return _winners(pdf, p).assign(part=pdf["part"].iloc[0] // FAN)[["part", "i", "v"]]

    sets = rows.sortWithinPartitions("i").mapInPandas(local, _ROWS)
    left = int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        sets = sets.groupBy((F.col("part") / FAN).cast("long").alias("group")).applyInPandas(merged, _ROWS)
        left = -(-left // FAN)
        if left <= 1:
            return sets.select("i", "v")


def rank(matrix: DataFrame, columns: int, p: int = PRIME) -> int:
    return independent_rows(matrix, columns, p).count()


def reduced(matrix: DataFrame, columns: int, p: int = PRIME) -> DataFrame:
    """(r, pivot_j, i, v): the reduced echelon form, a row a pivot, numbered from 0 by pivot column; ``i``: the row of the matrix that the pivot was taken from.

    A matrix of zeros has no rows here.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        m, pivots, order = kernels.reduced(np.array(pdf["v"].tolist(), dtype=np.int64), p)
        return pd.DataFrame({"r": np.arange(len(pivots)), "pivot_j": pivots, "i": pdf["i"].to_numpy()[order], "v": m.tolist()})

    return independent_rows(matrix, columns, p).groupBy().applyInPandas(run, "r long, pivot_j long, i long, v array<long>")


def pluq(matrix: DataFrame, rows: int, columns: int, p: int = PRIME) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Row order (i, at), column order (j, at) and the packed factors of the matrix so permuted.

    The first ``rank`` rows and columns carry the pivots, the others follow as they
    were; below and right of the pivots the packed form holds zeros.
    """
    found = cut(reduced(matrix, columns, p).select("r", "pivot_j", "i"), "pivots")
    n = found.count()

    def order(name: str, taken: str, size: int) -> DataFrame:
        """The chosen ones first; any other keeps its place among the others, by how many chosen ones are before it."""
        chosen = found.select(F.col(taken).alias(name), F.col("r").alias("at"))
        ahead = F.broadcast(found.agg(F.array_sort(F.collect_list(taken)).alias("all")))  # ``columns`` at most
        others = matrix.sparkSession.range(size).select(F.col("id").alias(name)).join(F.broadcast(chosen.select(name)), name, "left_anti").join(ahead)
        place = F.col(name) - F.expr(f"size(filter(all, x -> x < {name}))") + n
        return chosen.unionByName(others.select(name, place.alias("at")))

    row_order, column_order = cut(order("i", "i", rows), "row_order"), cut(order("j", "pivot_j", columns), "column_order")
    moved = matrix.join(row_order.withColumnRenamed("at", "to_i"), "i").join(F.broadcast(column_order.withColumnRenamed("at", "to_j")), "j")
    packed = eliminate_strip(moved.select(F.col("to_i").alias("i"), F.col("to_j").alias("j"), "v"), rows, columns, p)
    return row_order, column_order, packed
