"""Which runs a benchmark makes: methods, thread counts and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.field import size_sweep, thread_counts

#: Labels that reports carry, by family (fixed values).
SEQUENTIAL = "Raw sequential"
METHODS = {
    "multiply": ["pthreads", "Open MP", "KAAPIC", "Intel TBB 1D auto partitioner", "Intel TBB 1D affinity partitioner", "Intel TBB 1D simple partitioner", "Intel TBB 2D simple partitioner", "StarPU"],
    "naive": ["pthreads", "Open MP", "KAAPIC", "Intel TBB 1D auto partitioner", "Intel TBB 1D affinity partitioner", "Intel TBB 1D simple partitioner"],
    "recursive": ["pthreads", "Open MP parallel sections", "KAAPIC Spawn", "Intel TBB Invoke"],
    "tiled": ["Intel TBB", "StarPU"],
}


def methods(family: str, first_threads: int) -> list[str]:
    """A family's labels, the sequential one first where runs begin with one thread."""
    return ([SEQUENTIAL] if first_threads == 1 and family != "tiled" else []) + METHODS[family]


def run_matrix(spark: SparkSession, family: str, first: int, last: int) -> DataFrame:
    """Every run: method, threads; the sequential method runs once."""
    rows = [(m, t) for m in methods(family, first) for t in ([1] if m == SEQUENTIAL else thread_counts(first, last))]
    return spark.createDataFrame(rows, "method string, threads long")


def run_matrix_of(reports: DataFrame) -> DataFrame:
    """(method, threads): the runs that would cover what was reported, each method with the powers of two up to its most threads."""
    most = reports.groupBy("method").agg(F.max("threads").cast("long").alias("most"))
    return most.select("method", F.explode(F.expr("filter(transform(sequence(0, 30), k -> shiftleft(1L, k)), t -> t <= most)")).alias("threads"))


def sweep_of(sizes: DataFrame, step: int, count: int) -> DataFrame:
    """(step, rows, columns) after the other columns of ``sizes``: every size grown ``count`` times, by ``step`` or, where that is 0, doubling."""
    grown = (lambda c: F.col(c) * F.expr("shiftleft(1L, step)")) if step == 0 else lambda c: F.col(c) + F.col("step") * step
    every = sizes.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(count))))
    return every.withColumns({"step": F.col("step").cast("long"), "rows": grown("rows"), "columns": grown("columns")})


def sweep(spark: SparkSession, rows: int, columns: int, step: int, count: int) -> DataFrame:
    """Sizes of an incremental benchmark: step, rows, columns."""
    sizes = zip(size_sweep(rows, step, count), size_sweep(columns, step, count), strict=True)
    return spark.createDataFrame([(k, r, c) for k, (r, c) in enumerate(sizes)], "step long, rows long, columns long")
