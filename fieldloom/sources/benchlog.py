"""Benchmark logs: text files with a head of two lines and appended run reports.

A log holds the reports of one benchmark, a few lines a run, so the driver
writes it, in whatever store Spark reaches.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines of one log file stay in order by their offset, which the text source does not tell; files are read whole.
LINES = "file string, line_no int, line string"


def read_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no, line) of each file that ``paths`` (a glob or a list) names, line numbers from 0."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r?\n$", "").alias("value"))
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def lines_of(spark: SparkSession, name: str, text: str) -> DataFrame:
    """The same for a text at hand."""
    return spark.createDataFrame([(name, k, line) for k, line in enumerate(text.splitlines())], LINES)


def header(lines: DataFrame) -> DataFrame:
    """One row a file: dims and threads, from its first two lines."""
    numbers = F.transform(F.split(F.regexp_replace("line", r"\s", ""), ","), lambda x: x.cast("long"))
    return lines.where("line_no < 2").groupBy("file").agg(F.max(F.when(F.col("line_no") == 0, numbers)).alias("dims"), F.max(F.when(F.col("line_no") == 1, numbers)).alias("threads"))


def format_report(method: str, threads: int, chunk: int, real_s: float, cpu_s: float, gflops: float) -> str:
    """A run's report; its labels are fixed values, those that the parser and older logs have."""
    ratio = f"CPU/real time:      {cpu_s / real_s:.2f}\n" if cpu_s > 1e-10 and real_s > 0 else ""
    return f"Method:           {method}\n#Threads:         {threads}\nChunk size:       {chunk}\nReal time:        {real_s} sec\nCPU time:         {cpu_s} sec\n{ratio}GFLOPS/sec:       {gflops}\n"


def report_text() -> Column:
    """The same report as an expression over the columns method, threads, chunk, real_s, cpu_s and gflops (null: infinite), figures in full."""
    said = {"Method:           ": "method", "#Threads:         ": "threads", "Chunk size:       ": "chunk", "Real time:        ": "real_s", "CPU time:         ": "cpu_s", "CPU/real time:      ": "ratio", "GFLOPS/sec:       ": "gflops"}
    values = {"ratio": F.when((F.col("cpu_s") > 1e-10) & (F.col("real_s") > 0), F.col("cpu_s") / F.col("real_s")).cast("string"), "gflops": F.coalesce(F.col("gflops").cast("string"), F.lit("inf"))}
    seconds = {"real_s": " sec", "cpu_s": " sec"}
    return F.concat_ws("\n", *(F.concat(F.lit(label), values.get(c, F.col(c).cast("string")), F.lit(seconds.get(c, ""))) for label, c in said.items()))


def write_logs(reports: DataFrame, path: str) -> None:
    """Write a log for each ``file`` of reports (columns of :func:`report_text`, ``runs`` made), by method and threads, to folders ``log=<file>``.

    A log's head tells how many runs and reports it has, and its thread counts.
    """
    said = F.array_sort(F.collect_list(F.struct("method", "threads", report_text().alias("text"))))["text"]
    logs = reports.groupBy("file").agg(F.concat_ws(", ", F.sum("runs"), F.count(F.lit(1))).alias("dims"), F.array_join(F.array_sort(F.collect_set("threads")).cast("array<string>"), ", ").alias("threads"), F.array_join(said, "\n").alias("reports"))
    logs.select(F.concat_ws("\n", "dims", "threads", "reports").alias("value"), F.col("file").alias("log")).write.partitionBy("log").text(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all logs that :func:`write_logs` wrote, ``file`` being their names."""
    return read_log(spark, f"{path}/log=*/*").withColumn("file", F.regexp_extract("file", "log=([^/]*)/", 1))


def _store(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, hadoop


def start_log(spark: SparkSession, path: str, dims: list[int], threads: list[int]) -> None:
    """A new log of the two lines that tell sizes and thread counts; an old one is replaced."""
    _write(spark, path, ", ".join(map(str, dims)) + "\n" + ", ".join(map(str, threads)) + "\n")


def append_report(spark: SparkSession, path: str, report: str) -> None:
    """Add a run's report to a log.  Stores need not know appending: the log is written anew beside it and takes its place."""
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    _write(spark, path, text + report)


def _write(spark: SparkSession, path: str, text: str) -> None:
    store, at, hadoop = _store(spark, path)
    beside = hadoop.Path(posixpath.join(posixpath.dirname(path), f"_{posixpath.basename(path)}.new"))
    out = store.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(at, False)
    if not store.rename(beside, at):
        raise OSError(f"cannot write {path}")


def append_reports(reports: DataFrame, path: str) -> None:
    """Append parsed or measured records to a table of results."""
    reports.write.mode("append").parquet(path)


def in_order() -> Window:
    return Window.partitionBy("file").orderBy("line_no")
