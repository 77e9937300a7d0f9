"""Factoring a stream of small matrices.

A stream delivers whole matrices, one a row (key, m array of rows).  Each is
factored where it arrives, so the query keeps no state and needs no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from fieldloom.functions.field import PRIME
from fieldloom.operators.eliminate import fold, singular_at


def factored(stream: DataFrame, p: int = PRIME) -> DataFrame:
    """The stream's columns with ``m`` in packed form and ``singular_at``."""
    return stream.withColumn("m", fold("m", p)).withColumn("singular_at", singular_at("m"))


def to_table(stream: DataFrame, path: str, checkpoint: str, p: int = PRIME) -> DataStreamWriter:
    """A writer of the factored stream to Parquet files, exactly once for each matrix."""
    return factored(stream, p).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
