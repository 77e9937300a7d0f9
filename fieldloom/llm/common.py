"""What the text operators share: input columns and the cut points of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.plans.cuts import cut, fresh_path, shared_dir

__all__ = ["LOWER", "UPPER", "ascii_lower", "cut", "fresh_path", "held_out", "shared_dir", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col) -> F.Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def held_out(doc_id) -> F.Column:
    """True for the fifth of ids whose crc32 (of the id as text) is divisible by 5; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
