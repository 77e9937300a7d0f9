"""Toxicity by compression distance under two trained zstandard dictionaries.

One dictionary is trained on toxic text, one on ordinary text.  A text is cut
into windows, here its lower-cased words and the runs of signs between them, so
that all of it is scored but blanks, and each window is compressed under both;
the difference of the lengths says which kind of text it resembles.  A
fixed tail that both dictionaries hold follows every window, since zstandard
looks for no match in a block's last eight bytes and stores very short blocks
raw.  The toxic dictionary is trained on windows that toxic texts have markedly
more often.  Training alternates: windows of ordinary text that it codes better
go into the ordinary dictionary, and it is trained again on the windows that
then still stand out.  Both are held as plain content: with the entropy tables
of a trained dictionary, and with windows of several words, held-out texts are
told apart less well (figures in the README).

How many windows differ by at least each of the thresholds, their number and
the largest difference give the score through a logistic curve fitted on
labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import held_out, table
from fieldloom.llm.linear_text import folds, logistic_fit, sigmoid
from fieldloom.llm.memory import release
from fieldloom.llm.memo import Memo
from fieldloom.llm.samples import known_labels, labelled_sample

LEVEL, TOXIC_BYTES, ORDINARY_BYTES, ROUNDS = 12, 4096, 32768, 2
#: How many times commoner among toxic texts a window must be to train their first dictionary.
MARKED = 4
#: Labelled rows of each label that the model is fitted on at most (those of least hashed doc_id), bytes of their texts at most, and the score from which a text counts as toxic.
TRAIN_ROWS, TRAIN_BYTES, THRESHOLD = 2500, 24 << 20, 0.5
#: Bytes saved from which a window counts, at each of several strengths.
STRENGTHS = (1, 2, 3, 4, 5)
_TAIL = bytes(np.random.Generator(np.random.PCG64(5)).integers(128, 250, 48, dtype=np.uint8))
_PARTS = re.compile(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff\s]+")
_WIDTH = 60


def windows(text: str | None) -> list[bytes]:
    """The words and the runs of other signs of a whole text, each between spaces; longer ones are cut into consecutive windows."""
    out = []
    for word in _PARTS.findall((text or "").lower().encode()):
        out += [b" %b " % word] if len(word) <= _WIDTH else [b" %b " % word[i : i + _WIDTH] for i in range(0, len(word), _WIDTH)]
    return out


def whole_windows(parts: list[bytes], size: int) -> bytes:
    """The most frequent windows that fit ``size``, the most frequent last, where matches cost least."""
    chosen, used = [], 0
    for window, _ in sorted(Counter(parts).items(), key=lambda x: (-x[1], x[0])):
        used += len(window)
        if used > size:
            break
        chosen.append(window)
    return b"".join(chosen[::-1])


def train_dictionary(parts: list[bytes], size: int) -> bytes:
    """A dictionary that the library trains on windows; whole windows where they are too few for it."""
    try:
        return zstandard.train_dictionary(size, [b"".join(parts[i : i + 24]) for i in range(0, len(parts), 24)], level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return whole_windows(parts, size)


@dataclass
class CompressionDistance:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray | None = None

    def __post_init__(self):
        self._open()

    def _open(self):
        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            held = zstandard.ZstdCompressionDict(content + _TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)

        a, b = compressor(self.toxic).compress, compressor(self.ordinary).compress
        self.saved = Memo(lambda window: len(b(window + _TAIL)) - len(a(window + _TAIL))).get

    def __getstate__(self):
        return {"toxic": self.toxic, "ordinary": self.ordinary, "weights": self.weights}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._open()

    def features(self, text: str | None) -> list[float]:
        found = Counter(windows(text))
        saved = np.array([self.saved(w) for w in found], dtype=np.int64)
        often = np.array(list(found.values()), dtype=np.int64)
        counts = [np.log1p(x) for k in STRENGTHS for x in ((saved >= k).sum(), often[saved >= k].sum())]
        return [*counts, float(min(9, saved.max(initial=0))), float(np.log1p(often.sum()))]

    def score(self, text: str | None) -> float:
        return float(sigmoid(np.dot(self.weights[:-1], self.features(text)) + self.weights[-1]))


def fit(texts: list[str], y: np.ndarray, share: float) -> CompressionDistance:
    """Dictionaries from three quarters of the texts, the curve from the rest; ``share``: of toxic among all labelled rows."""
    part = folds(len(texts), 4, 13)
    words = [sorted(set(windows(t))) for t in texts]
    kinds = [[w for i in np.flatnonzero((y == k) & (part > 0)) for w in words[i]] for k in (1, 0)]
    common = Counter(kinds[1])
    odds = MARKED * max(1, int(((y == 1) & (part > 0)).sum())) / max(1, int(((y == 0) & (part > 0)).sum()))
    marked = {w: n for w, n in Counter(kinds[0]).items() if n > 1 and n >= odds * common[w]}
    toxic = [w for w, n in sorted(marked.items()) for _ in range(n)]

    def of_toxic() -> bytes:  # the trainer cuts across windows, so those it may have cut stand behind its dictionary whole
        return train_dictionary(toxic, TOXIC_BYTES) + whole_windows(toxic, TOXIC_BYTES)

    model = CompressionDistance(of_toxic(), train_dictionary(kinds[1], ORDINARY_BYTES))
    for _ in range(ROUNDS):
        mistaken = [w for w in kinds[1] if model.saved(w) >= 2]
        if mistaken:
            model = CompressionDistance(model.toxic, whole_windows(mistaken, ORDINARY_BYTES // 2) + model.ordinary)
        toxic = [w for w in toxic if model.saved(w) >= 2] or toxic
        model = CompressionDistance(of_toxic(), model.ordinary)
    held = np.flatnonzero(part == 0)
    if len(set(y[held].tolist())) < 2:
        held = np.arange(len(texts))
    x = np.array([model.features(texts[i]) for i in held])
    if len(set(y.tolist())) < 2:
        model.weights = np.append(np.zeros(len(model.features(""))), 20.0 if len(y) and y[0] else -20.0)
        return model
    rate = max(1e-6, min(1 - 1e-6, y[held].mean()))
    weight = np.where(y[held] == 1, share / rate, (1 - share) / (1 - rate))
    model.weights = logistic_fit(x, y[held].astype(float), weight=weight)
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, nbytes: int = TRAIN_BYTES) -> CompressionDistance:
    """Fit on labelled documents outside the held-out fifth, at most ``rows`` and ``nbytes`` of each label.

    The curve is weighted back to the labels' true shares.  Without labels, or with
    those of ordinary texts alone, every score is near 0; with toxic ones alone, near
    1.  Conflicting labels of one document both count.  See
    :func:`fieldloom.llm.samples.labelled_sample` for nulls and repeats.
    """
    totals = {r["label"]: r["n"] for r in known_labels(labels, "toxic").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    data = labelled_sample(docs, labels, "toxic", rows, nbytes, each=True).toPandas().sort_values(["doc_id", "label"])
    return fit(data["text"].tolist(), data["label"].to_numpy(), totals.get(1, 0) / max(1, sum(totals.values())))


def _scores(shared):
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        try:
            for part in texts:
                yield pd.Series([model.score(t) for t in part], dtype="float64")
        finally:
            release()

    return F.pandas_udf(score, "double")


def with_score(docs: DataFrame, model: CompressionDistance, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of every whole text, null and empty texts included, in place of a column of that name; equal texts score alike."""
    return docs.withColumn(name, _scores(docs.sparkSession.sparkContext.broadcast(model))(F.coalesce("text", F.lit(""))))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
