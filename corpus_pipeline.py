"""From raw documents to packed training windows, in five stages.

Each stage gets what its predecessor kept as a DataFrame, and its result is
written as Parquet and read again before the next.  All but the last return the
columns of ``documents``, and other columns besides as they are; the last returns
pieces of windows.

Null texts count as empty.  An empty table stays empty in every stage.  Rows of a
null doc_id are documents of their own, subject to quality and exact copies like
any others; no label and no near copy is known of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import exact_dedup, mixing, near_dedup, packing, quality
from fieldloom.llm.common import cut, table
from fieldloom.plans.cuts import drop_cuts, made_so_far

#: Passes over the most repeated source at most when sources are evened out; every source is used at least once throughout.
#: Half the mixing operator's own limit, since here every repetition is packed beside all else: see the README for the weights.
MAX_REPEAT = 2.0
#: Words that a packing worker keeps ids of, in each of two generations: fewer than the operator's own, since its executors keep some of the other stages' memory.
WORDS_KEPT = 150_000
#: The near-copy stage links texts when 100 * intersection >= NEAR_PERCENT * union.
NEAR_PERCENT = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's threshold.

    Equal texts score alike, so repeated rows stay or go together; with labels of
    one kind alone, or none, all score alike (without any, all stay).
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, model, "__score").where(f"__score >= {quality.THRESHOLD}").drop("__score")


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the largest doc_id (ties: any one of them); null and empty texts equal one another."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id, with all its rows; texts without words all stay."""
    return near_dedup.drop_near_copies(docs, percent=NEAR_PERCENT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Smaller sources repeated towards even shares, as far as MAX_REPEAT allows, copies far apart; no document is left out.

    A null source is a source; rows equal in doc_id and text are repeated alike.
    """
    return mixing.mixture(docs, entropy_share=None, max_repeat=MAX_REPEAT, whole=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of token ids; a repeated row is packed as often as it occurs, an empty text as its end id."""
    return packing.pack(docs, cached=WORDS_KEPT)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_exact_copies),
    ("near dedup", without_near_copies),
    ("source mixing", mixed),
    ("packing", packed),
]

#: No SQL: training, signatures and online packing are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote on its way is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = made_so_far(spark)
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        drop_cuts(spark, before, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
