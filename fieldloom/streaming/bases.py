"""The rank of what has come so far, kept for each key of a stream of vectors.

A key's state is the reduced echelon basis of its vectors mod p: as many rows as the
rank, so bounded by the width whatever has come.  Each task first reduces its own
vectors of a key to such a basis, so that a key with most of the stream sends a few
rows from each task.  A basis does not depend on the order or the batches in which
vectors come, so late ones need no watermark, and any cut of a stream into batches
ends at the same ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldloom.functions.field import PRIME, check_prime
from fieldloom.operators import kernels


def _reduced(rows: np.ndarray, p: int) -> np.ndarray:
    return kernels.reduced(rows, p)[0]


def ranks(vectors: DataFrame, key: str, vector: str, width: int, p: int = PRIME) -> DataFrame:
    """(key, rows, rank) of each key that got vectors, after each batch: how many came so far and how many are independent.

    ``vector``: an array of ``width`` integers; rows where it is null or of another
    length are left out.  Null keys are a key.  A key's state, of ``width`` rows at
    most, is kept for good.
    """
    check_prime(p)
    kind = vectors.schema[key].dataType.simpleString()
    held = vectors.where(F.size(vector) == width).where(F.expr(f"forall({vector}, x -> x is not null)"))
    named = held.select(F.col(key).alias("key"), F.transform(vector, lambda x: F.pmod(x.cast("long"), F.lit(p).cast("long"))).alias("v"))

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for value, group in pdf.groupby("key", dropna=False):
                basis = _reduced(np.array(group["v"].tolist(), dtype=np.int64), p)
                sent = basis if len(basis) else np.zeros((1, width), dtype=np.int64)
                yield pd.DataFrame({"key": [None if pd.isna(value) else value] * len(sent), "n": [len(group)] + [0] * (len(sent) - 1), "v": sent.tolist()})

    def update(value: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else (b"", 0)
        basis, rows = np.frombuffer(old[0], "<i8").reshape(-1, width), old[1]
        for pdf in frames:
            rows += int(pdf["n"].sum())
            basis = _reduced(np.vstack([basis, np.array(pdf["v"].tolist(), dtype=np.int64)]), p)
        state.update((basis.astype("<i8").tobytes(), rows))
        yield pd.DataFrame({"key": [value[0]], "rows": [rows], "rank": [len(basis)]})

    sent = named.mapInPandas(local, f"key {kind}, n long, v array<long>").groupBy("key")
    return sent.applyInPandasWithState(update, f"key {kind}, rows long, rank long", "basis binary, rows long", "update", GroupStateTimeout.NoTimeout).withColumnRenamed("key", key)


def ranks_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run the stream over what is there and write each batch's ranks to its own folder ``batch=<n>`` of ``path``; a repeated batch replaces its own."""
    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")).start().awaitTermination()


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, rows, rank) as the last batch that had the key left it."""
    last = F.max(F.struct("batch", "rows", "rank"))
    return spark.read.parquet(path).groupBy(key).agg(last.alias("last")).select(key, "last.rows", "last.rank")
