"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

A text's features say which byte n-grams (1 to 4 bytes, hashed to 2**BITS) occur
in it, whatever their number, and which n-grams (1 to 6) occur in the sequence
that tells of each word whether it repeats the word before.  Each indicator is scaled by the log ratio of the
shares of good and bad texts that have it (smoothed by one), and a linear
hinge-loss model is fitted to the scaled indicators by dual coordinate descent.
Margins become scores by a logistic curve fitted to margins of held-back folds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import held_out, table
from fieldloom.llm.linear_text import folds, logistic_fit, sigmoid
from fieldloom.llm.memory import release, tidy
from fieldloom.llm.samples import labelled_sample
from fieldloom.llm.shingles import word_hashes

BITS, ORDERS, ECHO = 18, 4, 6
#: Labelled rows that the model is fitted on at most (those of least hashed doc_id), bytes of their texts at most, and the score from which a text counts as good.
TRAIN_ROWS, TRAIN_BYTES, THRESHOLD = 6000, 40 << 20, 0.3
_MULT = np.uint64(0x9E3779B97F4A7C15)


def indicators(text: str | None) -> np.ndarray:
    """Ascending feature numbers of a text; none for null and empty texts."""
    seen = np.zeros(1 << BITS, dtype=bool)
    data = np.frombuffer((text or "").encode(), np.uint8)
    for at in range(0, len(data), 1 << 16):  # overlapping blocks: every n-gram lies in one
        block = data[at : at + (1 << 16) + ORDERS - 1].astype(np.uint64)
        gram = np.zeros(len(block), np.uint64)
        for n in range(1, ORDERS + 1):
            if len(block) < n:
                break
            gram = (gram[: len(block) - n + 1] << np.uint64(8)) | block[n - 1 :]
            seen[((gram + np.uint64(n << 40)) * _MULT >> np.uint64(64 - BITS)).astype(np.int64)] = True
    words, _ = word_hashes(data, np.array([0, len(data)]))
    echo = (words[1:] == words[:-1]).astype(np.uint64)
    gram = np.zeros(len(echo), np.uint64)
    for n in range(1, min(ECHO, len(echo)) + 1):
        gram = (gram[: len(echo) - n + 1] << np.uint64(1)) | echo[n - 1 :]
        seen[((gram + np.uint64((n + 100) << 40)) * _MULT >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(seen)


@dataclass
class NaiveBayesSVM:
    weights: np.ndarray  # one for each feature, the log ratio included
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum()) + self.bias

    def score(self, features: np.ndarray) -> float:
        return float(sigmoid(self.slope * self.margin(features) + self.shift))


def log_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    seen = np.zeros((2, 1 << BITS))
    for r, k in zip(rows, y, strict=True):
        seen[int(k), r] += 1.0  # a row's features are distinct
    n = np.maximum(1, np.bincount(y, minlength=2))
    return np.log((seen[1] + 1.0) / (n[1] + 2.0)) - np.log((seen[0] + 1.0) / (n[0] + 2.0))


def _descend(rows: list[np.ndarray], y: np.ndarray, cost: float, passes: int, seed: int = 7) -> NaiveBayesSVM:
    """Hinge loss and half the squared norm, minimised over the dual variables one at a time."""
    ratios = log_ratios(rows, y)
    sign = np.where(y == 1, 1.0, -1.0)
    squares = ratios * ratios
    norms = np.array([squares[r].sum() + 1.0 for r in rows])
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(passes):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            values = ratios[rows[i]]
            slack = sign[i] * (w[rows[i]] @ values + bias) - 1.0
            new = min(max(alpha[i] - slack / norms[i], 0.0), cost)
            if (step := (new - alpha[i]) * sign[i]) != 0.0:
                w[rows[i]] += step * values
                bias += step
                largest = max(largest, abs(step) * norms[i])
                alpha[i] = new
        if largest < 1e-3:
            break
    return NaiveBayesSVM(w * ratios, bias)


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, passes: int = 12, parts: int = 4) -> NaiveBayesSVM:
    """Model and calibration; a training set without both labels gives a constant score."""
    y = np.asarray(y)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return NaiveBayesSVM(np.zeros(1 << BITS), 0.0, 0.0, 20.0 if share > 0.5 else -20.0 if share < 0.5 else 0.0)
    part, margins = folds(len(rows), parts, 11), np.zeros(len(rows))
    for k in range(parts):
        model = _descend([rows[i] for i in np.flatnonzero(part != k)], y[part != k], cost, passes)
        for i in np.flatnonzero(part == k):
            margins[i] = model.margin(rows[i])
    model = _descend(rows, y, cost, passes)
    slope, shift = logistic_fit(margins[:, None], y.astype(float))
    model.slope, model.shift = float(slope), float(shift)
    return model


@tidy
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [indicators(x.as_py()).astype(np.int32).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], ["doc_id", "features", "label"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, nbytes: int = TRAIN_BYTES) -> NaiveBayesSVM:
    """Fit on labelled documents outside the held-out fifth, at most ``rows`` and ``nbytes`` of text.

    However long, a text has at most 2**BITS indicators and counts as no more bytes.
    See :func:`fieldloom.llm.samples.labelled_sample` for nulls and repeats.
    """
    sample = labelled_sample(docs, labels, label, rows, nbytes, most=1 << BITS).select("doc_id", "text", "label")
    data = sample.mapInArrow(_features, "doc_id long, features binary, label int").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    found = [np.frombuffer(x.as_buffer(), np.int32) for x in data["features"]]  # views of the one table, no copies
    model = fit(found, data["label"].to_numpy())
    del data, found
    release()
    return model


def _scores(shared):
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        try:
            for part in texts:
                yield pd.Series([model.score(indicators(t)) for t in part], dtype="float64")
        finally:
            release()

    return F.pandas_udf(score, "double")


def with_score(docs: DataFrame, model: NaiveBayesSVM, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of every whole text, null and empty texts included, in place of a column of that name; equal texts score alike."""
    return docs.withColumn(name, _scores(docs.sparkSession.sparkContext.broadcast(model))(F.coalesce("text", F.lit(""))))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLES: dict[str, str] = {}
