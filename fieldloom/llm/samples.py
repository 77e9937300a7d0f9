"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import cut, held_out


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """Distinct (doc_id, label) outside the held-out fifth, label 0 or 1; null ids and labels are left out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    return known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()


def _fitting(sizes: DataFrame, rows: int, nbytes: int) -> list:
    """(doc_id, label) in hashed order: texts that do not fit what is left of ``nbytes`` are passed over, the next ones are tried."""
    chosen, left, after = [], nbytes, F.lit(True)
    place = F.struct("hash", "doc_id", "label")
    while len(chosen) < rows:
        found = sizes.where(after & (F.col("size") <= left)).orderBy("hash", "doc_id", "label").limit(rows - len(chosen)).collect()
        for r in found:
            if r["size"] <= left:
                chosen.append((r["doc_id"], r["label"]))
                left -= r["size"]
        if not found:
            break
        last = found[-1]
        after = place > F.struct(*(F.lit(last[c]).cast(sizes.schema[c].dataType).alias(c) for c in ("hash", "doc_id", "label")))
    return chosen


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, nbytes: int, each: bool = False, most: int | None = None) -> DataFrame:
    """(doc_id, text, label) of labelled documents, whole texts, at most ``rows`` and ``nbytes`` of text (of ``each`` label).

    Documents are taken by hashed doc_id; a text that does not fit what is left
    of ``nbytes`` is passed over.  No text counts as more than ``most`` bytes.
    A label of which nothing was taken gives its shortest text whatever the
    bounds, with a warning.  Of rows that repeat a doc_id the least text counts,
    as long as the longest of them; null texts are empty.
    """
    known = known_labels(labels, label)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sizes = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(size if most is None else F.least(size, F.lit(most))).alias("size"))
    sizes = cut(known.join(sizes, "doc_id").withColumn("hash", F.xxhash64("doc_id")), "sizes")
    parts = [sizes.where(f"label = {k}") for k in (0, 1)] if each else [sizes]
    chosen = [x for p in parts for x in _fitting(p, rows, nbytes)]
    for k in {0, 1} - {k for _, k in chosen}:
        for r in sizes.where(f"label = {k}").orderBy("size", "hash", "doc_id").limit(1).collect():
            warnings.warn(f"no text with {label} = {k} is within the sample's bounds: the shortest, of {r['size']} bytes, is taken", stacklevel=2)
            chosen.append((r["doc_id"], k))
    wanted = docs.sparkSession.createDataFrame(chosen, known.schema)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id")  # about ``rows`` ids at most
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
