"""Speed-up report of measurement events, one partition a day.

    python -m jobs.speedups --events PATH --out PATH [--first-day D] [--last-day D] [--config FILE]

An event is a measurement: ``event_type`` is the method, the hour of ``ts`` (plus
one) the setting that a run had, ``value`` its seconds.  Each day's best time by
method and setting makes a series, with speed-ups over the day's best first
setting and over the method's own, and the rate at which a matrix of the
configured size was eliminated.  Only the days asked for are read and replaced, so
late events are taken in by a rerun of their day; a rerun gives the same files'
contents again.
"""

from __future__ import annotations

import argparse
import logging
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.operators import benchlog
from fieldloom.plans.cuts import cut
from jobs.settings import read_config, start_log

log = logging.getLogger("jobs.speedups")
CONFIG = Path(__file__).with_suffix(".json")
#: Edge of the matrix that a run eliminates, and files that a day's partition is written to.
DEFAULTS = {"size": 1000, "files_per_day": 1}
SCHEMA = "method string, threads int, seq int, runs long, real_s double, speedup_global double, speedup_own double, rate double, day string"


def best_times(events: DataFrame) -> DataFrame:
    """(file, method, threads, seq, runs, real_s) of usable events: method and time known, seconds finite and above 0.

    The reduction to a row a day, method and hour is combined before it is
    shuffled, so a method that holds most events makes no large group.
    """
    usable = events.where("event_type is not null and ts is not null and value > 0 and value < double('infinity')")
    keys = [F.to_date("ts").cast("string").alias("file"), F.col("event_type").alias("method"), (F.hour("ts") + 1).alias("threads")]
    best = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.min(F.col("value").cast("double")).alias("real_s"))
    return best.withColumn("seq", F.row_number().over(Window.partitionBy("file", "method").orderBy("threads")) - 1)  # 24 rows at most


def report(events: DataFrame, size: int) -> DataFrame:
    """The report's rows, columns as in SCHEMA."""
    made = benchlog.with_speedups(best_times(events), size)
    return made.select("method", "threads", "seq", "runs", "real_s", "speedup_global", "speedup_own", "rate", F.col("file").alias("day"))


def run(spark: SparkSession, events: str, out: str, config: dict = DEFAULTS, first_day: str | None = None, last_day: str | None = None) -> dict[str, int]:
    """Read the events of some days (all by default) and replace their partitions; returns rows read and written.

    Days without usable events are left as they are.  Unusable events are counted
    as read but give nothing; an empty table writes nothing.
    """
    table = spark.read.parquet(events)
    if first_day:
        table = table.where(F.col("ts") >= F.lit(date.fromisoformat(first_day)).cast(table.schema["ts"].dataType))
    if last_day:
        table = table.where(F.col("ts") < F.lit(date.fromisoformat(last_day) + timedelta(days=1)).cast(table.schema["ts"].dataType))
    rows = cut(report(table, config["size"]), "report")  # small, and counted before it is written
    place = F.pmod(F.xxhash64("method", "threads"), F.lit(config["files_per_day"]))
    rows.repartition("day", place).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(out)
    done = {"read": table.count(), "written": rows.count()}
    log.info("read %d events from %s, wrote %d rows to %s", done["read"], events, done["written"], out)
    return done


def result(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(out)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Speed-up report of measurement events")
    for name in ("events", "out"):
        parser.add_argument(f"--{name}", required=True, help="path, local or remote")
    parser.add_argument("--first-day", help="YYYY-MM-DD; earlier events are not read")
    parser.add_argument("--last-day", help="YYYY-MM-DD; later events are not read")
    parser.add_argument("--config", default=str(CONFIG))
    given = parser.parse_args(argv)
    start_log()
    spark = SparkSession.builder.appName("speedups").getOrCreate()
    try:
        run(spark, given.events, given.out, read_config(given.config, DEFAULTS), given.first_day, given.last_day)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
