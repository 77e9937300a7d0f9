"""Factors of the word counts of sources, kept up to date as documents arrive.

    python -m jobs.source_factors --documents PATH --out PATH --checkpoint PATH [--config FILE]

For each language the matrix of sources (in ``edge`` buckets) by words (in
``columns`` buckets) is counted mod ``prime``, multiplied by its transpose and
eliminated: exact arithmetic, so buckets that depend on one another (or are empty)
show as zero pivots, of which ``singular_at`` is the first, and two tables of equal
counts give equal factors.

The job is a stream over the files of the documents' folder: each run takes the
files that the checkpoint does not know.  Counts are additive, so a batch leaves its
own beside the stream's progress (a partition a batch, replaced whole when a batch
is repeated after a failure), and the factors are made from the sum of all batches
and replace those in ``out``, a partition a language.  Sums mod a prime do not
depend on how the input was cut into batches: runs over a growing folder end at the
same factors as one run over all of it.
"""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.field import check_prime
from fieldloom.operators.eliminate import eliminate_groups
from fieldloom.operators.multiply import multiply_cells
from jobs.settings import read_config, start_log

log = logging.getLogger("jobs.source_factors")
CONFIG = Path(__file__).with_suffix(".json")
#: Buckets of sources and of words, the field, and the files that a batch takes at most.
DEFAULTS = {"edge": 12, "columns": 256, "prime": 65521, "files_per_batch": 64}
#: Buckets of sources up to which a language's matrix is factored within one row.
LARGEST_EDGE = 48
COUNTS = "lang string, i long, j long, v long, batch long"
SCHEMA = "i long, j long, gram long, v long, singular_at long, lang string"


def bucket(name: Column, many: int) -> Column:
    """A bucket by the first 32 bits of the name's MD5."""
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % many


def word_counts(docs: DataFrame, edge: int, columns: int, p: int) -> DataFrame:
    """(lang, i, j, v): words of whole texts by language, bucket of the source and bucket of the word, mod p.

    Words are runs of anything but ASCII white space.  Null and empty languages
    are "none", null sources are empty, null texts have no words.  Counts are
    combined before they are shuffled: a task sends a row for each language and
    pair of buckets at most, whatever source or word is frequent.
    """
    lang = F.when(F.coalesce("lang", F.lit("")) == "", "none").otherwise(F.col("lang"))
    words = docs.select(lang.alias("lang"), bucket(F.coalesce("source", F.lit("")), edge).alias("i"), F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word"))
    return words.groupBy("lang", "i", bucket(F.col("word"), columns).alias("j")).agg((F.count(F.lit(1)) % p).alias("v"))


def factors(counts: DataFrame, edge: int, p: int) -> DataFrame:
    """(i, j, gram, v, singular_at, lang) from (lang, i, j, v), cells of one bucket adding up: products of rows, and their packed form."""
    total = counts.groupBy("lang", "i", "j").agg((F.sum("v") % p).alias("v"))
    side = F.sequence(F.lit(0).cast("long"), F.lit(edge - 1).cast("long"))
    empty = counts.select("lang").distinct().select("lang", F.explode(side).alias("i")).select("lang", "i", F.explode(side).alias("j"), F.lit(0).cast("long").alias("v"))
    gram = multiply_cells(total, total, p, keys=("lang",)).unionByName(empty).groupBy("lang", "i", "j").agg((F.sum("v") % p).alias("v"))
    packed = eliminate_groups(gram, ["lang"], p)
    return packed.join(gram.withColumnRenamed("v", "gram"), ["lang", "i", "j"]).select("i", "j", "gram", "v", "singular_at", "lang")


def _only(path: str) -> str:
    """A pattern that only ``path`` matches: streams take a folder or a pattern, and this may be a single file."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def add_counts(batch: DataFrame, number: int, path: str, config: dict) -> int:
    """Write a batch's counts as its own partition, in place of what an earlier attempt at it wrote; returns the documents read."""
    made = word_counts(batch, config["edge"], config["columns"], config["prime"]).withColumn("batch", F.lit(number).cast("long"))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    return batch.count()  # by the files' footers


def counts_so_far(spark: SparkSession, path: str) -> DataFrame | None:
    """All batches' counts, or None before the first one."""
    try:
        return spark.read.schema(COUNTS).parquet(path)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict = DEFAULTS) -> dict[str, int]:
    """Take what is new, then replace the factors in ``out``; returns rows read, batches taken and rows written.

    ``checkpoint`` holds both the stream's progress and the counts that belong to
    it, so whoever deletes it starts over.  Before any document has come there are
    no factors.
    """
    if not 0 < config["edge"] <= LARGEST_EDGE:
        raise ValueError(f"edge must be 1 to {LARGEST_EDGE}")
    check_prime(config["prime"])
    read: list[int] = []
    new = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(_only(documents))
    writer = new.select("lang", "source", "text").writeStream.option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True)
    writer.foreachBatch(lambda batch, number: read.append(add_counts(batch, number, f"{checkpoint}/counts", config))).start().awaitTermination()
    done = {"read": sum(read), "batches": len(read), "written": 0}
    counts = counts_so_far(spark, f"{checkpoint}/counts")
    if counts is not None:
        factors(counts, config["edge"], config["prime"]).repartition("lang").write.mode("overwrite").partitionBy("lang").parquet(out)
        done["written"] = result(spark, out).count()
    log.info("read %d new documents from %s in %d batches, wrote %d cells to %s", done["read"], documents, done["batches"], done["written"], out)
    return done


def result(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(out)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Factors of the word counts of sources, kept up to date")
    for name in ("documents", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True, help="path, local or remote")
    parser.add_argument("--config", default=str(CONFIG))
    given = parser.parse_args(argv)
    start_log()
    spark = SparkSession.builder.appName("source-factors").getOrCreate()
    try:
        run(spark, given.documents, given.out, given.checkpoint, read_config(given.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
