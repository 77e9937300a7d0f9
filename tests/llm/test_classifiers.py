from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from fieldloom.llm import linear_text, quality, toxicity
from fieldloom.llm.common import held_out
from fieldloom.llm.samples import labelled_sample
from tests.llm.conftest import ODD

INSULTS = ["blockhead", "nitwit", "dunce", "twerp"]


def corpus(kind, n=240, seed=5):
    rng = random.Random(seed)
    syllables = ["ba", "tor", "en", "li", "sa", "mu", "ke", "ro", "di", "fal"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(30, 90))]
        y = int(rng.random() < 0.3)
        if kind == "toxic" and y:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(INSULTS)
        if kind == "quality":
            y = 1 - y
            if not y:
                words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w for w in words[:20] for _ in range(3)]
        docs.append((i, " ".join(words)))
        labels.append((i, y))
    return docs, labels


def frames(spark, make, kind):
    docs, labels = corpus(kind)
    other = {"toxic": "quality", "quality": "toxic"}[kind]
    return make(docs, "label features share"), spark.createDataFrame([(i, y, 0) for i, y in labels], f"doc_id long, {kind} int, {other} int")


@pytest.mark.parametrize(("module", "kind"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, make, module, kind):
    docs, labels = frames(spark, make, kind)
    scored = module.with_score(docs, module.train(docs, labels)).withColumn("out", held_out(docs["doc_id"])).join(labels, "doc_id").collect()
    out = [r for r in scored if r["out"]]
    right = [int(r["score"] >= module.THRESHOLD) == r[kind] for r in out]
    assert len(out) > 20 and np.mean(right) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in scored)


@pytest.mark.parametrize(("module", "kind"), [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows_and_labels(spark, make, module, kind):
    docs, labels = frames(spark, make, kind)
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None), (10**9, 1, 1)], labels.schema)
    model = module.train(docs, labels.union(nulls))
    scores = module.with_score(make(ODD, "score"), model).collect()
    assert len(scores) == len(ODD) and all(0 <= r["score"] <= 1 for r in scores)
    assert len({r["score"] for r in scores if r["text"] in (None, "")}) == 1
    assert module.with_score(make(ODD).where("false"), model).count() == 0


@pytest.mark.parametrize(("module", "kind"), [(quality, "quality"), (toxicity, "toxic")])
def test_few_labels(spark, make, module, kind):
    docs, labels = frames(spark, make, kind)
    for some in (labels.where("false"), labels.where(f"{kind} = 1")):
        model = module.train(docs, some)
        s = {round(r["score"], 6) for r in module.with_score(docs.limit(5), model).collect()}
        assert len(s) == 1 and 0 <= min(s) and max(s) <= 1


def test_held_out_labels_are_never_read(spark, make):
    docs, labels = frames(spark, make, "quality")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert (a.weights == b.weights).all() and (a.slope, a.shift) == (b.slope, b.shift)


def test_indicators_of_long_texts_join_across_blocks():
    text = "".join(chr(97 + k % 26) for k in range(200_000))
    assert set(quality.indicators(text)) == set(quality.indicators(text[:200]))
    assert len(quality.indicators(None)) == len(quality.indicators("")) == 0


def test_dual_descent_separates():
    rng = np.random.Generator(np.random.PCG64(3))
    rows = [np.unique(rng.integers(0, 500, 40)) if k % 2 else np.unique(np.append(rng.integers(0, 500, 40), [600 + k % 7])) for k in range(200)]
    y = np.arange(200) % 2
    model = quality.fit(rows, y)
    assert np.mean([(model.score(r) >= 0.5) == bool(k) for r, k in zip(rows, y, strict=True)]) == 1.0


def test_logistic_fit_matches_its_gradient():
    rng = np.random.Generator(np.random.PCG64(4))
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(float)
    w = linear_text.logistic_fit(x, y, ridge=0.01)
    p = linear_text.sigmoid(x @ w[:2] + w[2])
    assert np.abs(x.T @ (y - p) - 0.01 * 300 * w[:2]).max() < 1e-5


def test_windows_cover_whole_texts():
    assert toxicity.windows("Ab, c! " + "z" * 150) == [b" ab ", b" , ", b" c ", b" ! ", b" " + b"z" * 60 + b" ", b" " + b"z" * 60 + b" ", b" " + b"z" * 30 + b" "]
    assert toxicity.windows(None) == toxicity.windows(" \t\n") == [] and toxicity.windows("a1 12!?") == [b" a1 ", b" 12 ", b" !? "]


def test_a_text_beyond_the_bound_costs_no_other(spark, make):
    ids = [r["doc_id"] for r in spark.range(60).selectExpr("id as doc_id").where("crc32(cast(id as string)) % 5 <> 0").orderBy(F.xxhash64("doc_id")).collect()]
    docs = make([(i, "x" * (5000 if k in (0, 7) else 600 if k == 9 else 10)) for k, i in enumerate(ids)])
    labels = spark.createDataFrame([(i, k % 2, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"] for r in labelled_sample(docs, labels, "quality", 20, 1000).collect()}
    assert got == {i for k, i in enumerate(ids[:22]) if k not in (0, 7)}
    by_label = labelled_sample(docs, labels, "toxic", 5, 1000, each=True).collect()
    assert {r["doc_id"] for r in by_label} == {ids[k] for k in (2, 4, 6, 8, 10, 1, 3, 5, 9, 11)}
    assert {r["doc_id"] for r in labelled_sample(docs, labels, "quality", 20, 1000, most=100).collect()} == set(ids[:20])


@pytest.mark.parametrize(("module", "kind"), [(quality, "quality"), (toxicity, "toxic")])
def test_a_long_text_first_does_not_empty_the_model(spark, make, module, kind):
    docs, labels = frames(spark, make, kind)
    first = docs.where(~held_out(docs["doc_id"])).selectExpr("doc_id").orderBy(F.xxhash64("doc_id")).first()[0]
    docs = docs.selectExpr("doc_id", f"if(doc_id = {first}, repeat('lorem ', 100000), text) as text")
    model = module.train(docs, labels, nbytes=400_000)
    out = module.with_score(docs.where(held_out(docs["doc_id"])), model).join(labels, "doc_id").collect()
    assert np.mean([int(r["score"] >= module.THRESHOLD) == r[kind] for r in out]) >= 0.95


def test_a_label_of_long_texts_only_keeps_one(spark, make):
    ids = [r["doc_id"] for r in spark.range(40).selectExpr("id as doc_id").where("crc32(cast(id as string)) % 5 <> 0").collect()]
    docs = make([(i, "x" * (10 if k % 2 else 5000 + k)) for k, i in enumerate(ids)])
    labels = spark.createDataFrame([(i, k % 2, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="toxic = 0"):
        got = labelled_sample(docs, labels, "toxic", 50, 1000, each=True).collect()
    assert [r["doc_id"] for r in got if r["label"] == 0] == [ids[0]] and len(got) == 1 + len(ids) // 2


def test_quality_sample_has_its_documented_size(spark, make):
    assert (quality.TRAIN_ROWS, quality.TRAIN_BYTES) == (6000, 40 << 20)
    ids = [r["id"] for r in spark.range(8000).collect()]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in ids], "doc_id long, quality int, toxic int")
    docs = make([(i, "a" if i % 2 else "b") for i in ids])
    assert labelled_sample(docs, labels, "quality", quality.TRAIN_ROWS, quality.TRAIN_BYTES, most=1 << quality.BITS).count() == 6000


def test_toxicity_against_plain_compression():
    docs, labels = corpus("toxic", n=160)
    y = np.array([k for _, k in labels])
    model = toxicity.fit([t for _, t in docs], y, float(y.mean()))

    def length(window, content):  # a fresh compressor for every window
        held = zstandard.ZstdCompressionDict(content + toxicity._TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=held, write_content_size=False, write_dict_id=False).compress(window + toxicity._TAIL))

    for _, text in docs[:12]:
        parts = [" " + w + " " for w in re.findall(r"[^\W_]+|[^\w\s]+", text.lower())]
        saved = {w: length(w.encode(), model.ordinary) - length(w.encode(), model.toxic) for w in set(parts)}
        counts = []
        for k in toxicity.STRENGTHS:
            counts += [math.log1p(sum(x >= k for x in saved.values())), math.log1p(sum(saved[w] >= k for w in parts))]
        z = [*counts, min(9, max(0, *saved.values())), math.log1p(len(parts))]
        assert model.features(text) == pytest.approx(z)
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-(float(np.dot(model.weights[:-1], z)) + model.weights[-1]))))


def test_log_ratios_against_counts():
    rng = np.random.Generator(np.random.PCG64(8))
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(50)]
    y = rng.integers(0, 2, 50)
    got = quality.log_ratios(rows, y)
    for f in range(30):
        held = [sum(f in r for r, k in zip(rows, y, strict=True) if k == c) for c in (0, 1)]
        n = [int((y == c).sum()) for c in (0, 1)]
        assert got[f] == pytest.approx(math.log((held[1] + 1) / (n[1] + 2)) - math.log((held[0] + 1) / (n[0] + 2)))
    text = "Ab ab ab, éx"
    grams = {text.encode()[i : i + n] for n in range(1, 5) for i in range(len(text.encode()) - n + 1)}
    words = text.lower().split()
    echo = [a == b for a, b in zip(words, words[1:], strict=False)]
    repeats = {tuple(echo[i : i + n]) for n in range(1, 7) for i in range(len(echo) - n + 1)}
    assert len(quality.indicators(text)) <= len(grams) + len(repeats) <= len(quality.indicators(text)) + 3  # but for hash collisions


def test_dual_optimum_against_projected_gradient():
    rng = np.random.Generator(np.random.PCG64(2))
    rows = [np.unique(rng.integers(0, 60, 12)) for _ in range(80)]
    y = (np.array([r[:3].sum() for r in rows]) + rng.integers(-12, 12, 80) > 25).astype(int)
    model = quality._descend(rows, y, 1.0, 3000)
    ratios = quality.log_ratios(rows, y)
    x = np.zeros((80, 61))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r]
    x[:, 60] = 1.0  # the bias, counted in the norm
    sign = np.where(y == 1, 1.0, -1.0)
    q = (sign[:, None] * x) @ (sign[:, None] * x).T
    alpha, step = np.zeros(80), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(40_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, 1)
    w = x.T @ (alpha * sign)
    loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - sign * (x @ w)).sum()
    found = np.append(np.divide(model.weights[:60], ratios[:60], out=np.zeros(60), where=ratios[:60] != 0), model.bias)
    assert loss(found) == pytest.approx(loss(w), rel=1e-3) and loss(found) == pytest.approx(alpha.sum() - 0.5 * alpha @ q @ alpha, rel=1e-3)
