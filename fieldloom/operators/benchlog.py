"""From benchmark log lines to records, series, speedups and rates.

A log's lines are few (reports of one benchmark), so windows over one file's
lines are bounded by that; files are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.sources.benchlog import in_order

_NUMBER = r"([-+]?(?:[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?|inf))"


def _escaped(label: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in label)


def label_of(methods: list[str]) -> Column:
    """The last of ``methods``, in the order given, that the line contains; else null."""
    found = F.lit(None).cast("string")
    for m in methods:
        found = F.when(F.col("line").contains(m), F.lit(m)).otherwise(found)
    return found


def _value(label: str, kind: str = "double") -> Column:
    raw = F.regexp_extract("line", rf"{_escaped(label)}\s*{_NUMBER}", 1)
    return F.when(raw == "inf", F.lit(-1.0)).when(raw != "", raw.cast("double")).cast(kind)


def parse(lines: DataFrame, methods: list[str]) -> DataFrame:
    """Records: file, seq, method, threads, chunk, real_s, cpu_s, ratio, gflops.

    A method's label holds for the lines that follow it; a record begins at each
    "Real time:" line and takes thread and chunk numbers from the lines since the
    last label and the other figures from the lines up to the next "Real time:".
    An infinite rate is -1.  ``seq`` counts a method's records in file order.
    """
    w = in_order()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("label", label_of(methods)).withColumn("real", _value("Real time:"))
    marked = marked.withColumn("method", F.last("label", ignorenulls=True).over(upto))
    marked = marked.withColumn("section", F.count("label").over(upto)).withColumn("record", F.count("real").over(upto))
    fields = marked.select("file", "line_no", "method", "section", "record", "real", _value("#Threads:", "int").alias("t"), F.coalesce(_value("Chunk size:", "int"), _value("Blocksize:", "int")).alias("c"), _value("CPU time:").alias("cpu"), _value("CPU/real time:").alias("r"), _value("GFLOPS/sec:").alias("g"))
    heads = fields.groupBy("file", "section").agg(F.max("t").alias("threads"), F.max("c").alias("chunk"))
    bodies = fields.where("record > 0").groupBy("file", "record").agg(
        F.min_by("method", "line_no").alias("method"), F.min_by("section", "line_no").alias("section"), F.min("line_no").alias("line_no"),
        F.max("real").alias("real_s"), F.max("cpu").alias("cpu_s"), F.max("r").alias("ratio"), F.max("g").alias("gflops"),
    )
    seq = F.row_number().over(Window.partitionBy("file", "method").orderBy("line_no")) - 1
    return bodies.join(heads, ["file", "section"]).where("method is not null").withColumn("seq", seq).select("file", "seq", "method", "threads", "chunk", "real_s", "cpu_s", "ratio", "gflops")


def series(records: DataFrame) -> DataFrame:
    """Per file and method, arrays of times and rates in order of seq."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "real_s", "gflops")))
    return records.groupBy("file", "method").agg(ordered.alias("s")).select("file", "method", F.col("s.real_s").alias("times"), F.col("s.gflops").alias("rates"))


def speedup_global(records: DataFrame, per_file: bool = False) -> DataFrame:
    """``speedup`` over the least first time of any method, of all files or ``per_file``."""
    keys = ["file"] if per_file else []
    base = records.where("seq = 0").groupBy(*keys).agg(F.min("real_s").alias("base"))
    both = records.join(base, keys) if per_file else records.join(F.broadcast(base))  # one row
    return both.select("file", "method", "seq", "real_s", (F.col("base") / F.col("real_s")).alias("speedup"))


def speedup_own(records: DataFrame) -> DataFrame:
    """``speedup`` over the method's own first time in the file."""
    base = F.first("real_s").over(Window.partitionBy("file", "method").orderBy("seq"))
    return records.select("file", "method", "seq", "real_s", (base / F.col("real_s")).alias("speedup"))


def with_speedups(records: DataFrame, n: int) -> DataFrame:
    """``records`` with speedup_global (over the file's least first time), speedup_own and ``rate`` of eliminating an n x n matrix.

    Both baselines in one pass; a file's records meet in one task, so a file
    should be one report, not a table of raw events.
    """
    file, own = Window.partitionBy("file"), Window.partitionBy("file", "method").orderBy("seq")
    base = F.min(F.when(F.col("seq") == 0, F.col("real_s"))).over(file)
    return records.withColumns({"speedup_global": base / F.col("real_s"), "speedup_own": F.first("real_s").over(own) / F.col("real_s"), "rate": F.lit(2.0 * n**3 / 3e9) / F.col("real_s")})


def throughput(records: DataFrame, n: int) -> DataFrame:
    """Rates recomputed as 2/3 n**3 operations, in billions a second."""
    return records.select("file", "method", "seq", (F.lit(2.0 * n**3 / 3e9) / F.col("real_s")).alias("rate"))


def rates(records: DataFrame, rows: int, columns: int, tiles: int) -> DataFrame:
    """Of each record: ``ratio`` of CPU to real time (null below 1e-10 seconds of CPU), and the rate that tiled runs report."""
    used = F.when((F.col("cpu_s") > 1e-10) & (F.col("real_s") > 0), F.col("cpu_s") / F.col("real_s"))
    return records.select("file", "method", "seq", used.alias("ratio"), (F.lit(2.0 * rows * columns * tiles / 9 / 1e6) / F.col("real_s")).alias("tiled_rate"))


def path_parameters(paths: DataFrame) -> DataFrame:
    """(path, incremental, block): the parts of a results folder's name that tell its settings."""
    parts = F.split("path", "-")
    growing = parts[3] == "inc"
    return paths.select("path", growing.alias("incremental"), F.when(growing, parts[6]).otherwise(parts[5]).cast("long").alias("block"))
