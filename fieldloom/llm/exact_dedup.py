"""Exact duplicates through counting quotient filters and a byte comparison.

Each task adds its texts' 64-bit fingerprints to a counting quotient filter and
emits it dealt out by leading bits; the parts of one leading value merge in one
task, losslessly, by sorted remainders.  Only fingerprints counted more than
once lead to texts being moved: these are grouped by their whole normalised
bytes, so a fingerprint collision never joins two different texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import LOWER, UPPER, ascii_lower, cut, table
from fieldloom.llm.memory import tidy
from fieldloom.llm.quotient_filter import CountingQuotientFilter

#: Fingerprints that a task gathers before it emits a filter; bounds its memory.
FLUSH = 1 << 22
#: Fingerprints meant for one merging task, and the least power of two of such tasks.
PER_SEGMENT, LEAST_BITS = 1 << 22, 8


def _filters(bits: int):
    @tidy
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            whole = CountingQuotientFilter.of(np.concatenate(held).view(np.uint64))
            parts = [(k, f.to_bytes()) for k, f in whole.split(bits)]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], ["segment", "filter"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            n += len(held[-1])
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return build


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    values, counts = CountingQuotientFilter.merge(map(CountingQuotientFilter.from_bytes, pdf["filter"])).items()
    return pd.DataFrame({"fp": values[counts > 1].view(np.int64)})


def repeated_fingerprints(fps: DataFrame, bits: int) -> DataFrame:
    """Of the one long column ``fp``: the values that occur more than once, as rows ``fp``."""
    parts = fps.select("fp").mapInArrow(_filters(bits), "segment int, filter binary")
    return parts.groupBy("segment").applyInPandas(_repeated, "fp long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as the
    empty text, and empty texts equal one another.  The largest doc_id of a
    group stays (``keep_id``); null doc_ids never win over others.  Rows that
    repeat the kept doc_id with an equal text are all marked kept, and so are
    all rows of a group of null doc_ids alone, whose keep_id is null.  Other
    columns are ignored.
    """
    slim = docs.select("doc_id", F.xxhash64(ascii_lower(F.col("text"))).alias("fp"), F.sha2(ascii_lower(F.col("text")).cast("binary"), 256).alias("text_sha256"))
    slim = cut(slim, "fingerprints")
    bits = max(LEAST_BITS, int(np.ceil(np.log2(max(1, slim.count() / PER_SEGMENT)))))
    suspects = cut(repeated_fingerprints(slim, bits), "suspects")
    texts = docs.select("doc_id", ascii_lower(F.col("text")).alias("norm")).withColumn("fp", F.xxhash64("norm"))
    groups = (
        texts.join(suspects, "fp", "left_semi").groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1").select(F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    groups = cut(groups, "groups")
    return slim.join(groups, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has no equal with a larger doc_id; of rows tied on doc_id (null ones tie) one stays.

    No text is lost: each group of equal texts keeps one row.
    """
    kept = cut(exact_groups(docs).where("kept").select("doc_id", "text_sha256"), "kept")
    kept = cut(kept.groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).agg(F.count(F.lit(1)).alias("n")), "counted")
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("doc_id"), F.sha2(ascii_lower(F.col("text")).cast("binary"), 256).alias("text_sha"))
    rows = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_sha") == F.col("sha")))
    if not kept.where("n > 1").isEmpty():
        rows = rows.where("n = 1").unionByName(rows.where("n > 1").dropDuplicates(["id", "sha"]))
    return rows.select("doc.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLES = {
    "op3_exact_dedup": f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = max(doc_id) OVER w, max(doc_id) OVER w IS NULL) AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)"""
}
