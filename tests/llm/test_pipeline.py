from __future__ import annotations

import re

import pytest

import corpus_pipeline
from fieldloom.llm import mixing, quality
from fieldloom.llm.common import cut
from tests.llm.conftest import ODD
from tests.llm.test_classifiers import corpus
from tests.llm.test_exact import brute
from tests.llm.test_near import brute_groups
from tests.llm.test_near import corpus as corpus_near


@pytest.fixture(scope="module")
def sf_dir(spark, make, tmp_path_factory):
    base = tmp_path_factory.mktemp("sf")
    docs, labels = corpus("quality")
    rows = [(i, t, f"s{min(i % 7, 2)}") for i, t in docs]
    good = next(t for (i, t), (_, y) in zip(docs, labels, strict=True) if y)
    rows += [(300, good, "s1"), (301, good, "s0"), (302, good.replace(good.split()[7], "changed", 1), "s1")]
    make(rows).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base)


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for (name, stage), check in zip(corpus_pipeline.STAGES, ("quality", "exact", "near", "mix", "pack"), strict=True):
        before = [tuple(r) for r in docs.collect()]
        after = cut(stage(spark, docs, sf_dir), check)
        got = [tuple(r) for r in after.collect()]
        pairs = [(r[0], r[1]) for r in before]
        if check == "quality":
            assert sorted(got) == sorted(r for r in before if model.score(quality.indicators(r[1])) >= quality.THRESHOLD) and len(got) < len(before)
        elif check == "exact":
            keep = {i for i, k, _, kept, _ in brute(pairs) if kept}
            assert sorted(got) == sorted(r for r in before if r[0] in keep) and len(got) < len(before)
        elif check == "near":
            groups = brute_groups(pairs)
            assert sorted(got) == sorted(r for r in before if groups[r[0]][1] == r[0]) and len(got) < len(before)
        elif check == "mix":
            plan = mixing.plan(docs, entropy_share=None, max_repeat=corpus_pipeline.MAX_REPEAT, whole=True).collect()
            copies = {r["doc_id"]: r["copies"] for r in plan}
            assert sorted(got) == sorted(r for r in before for _ in range(copies[r[0]])) and len(got) > len(before) and min(copies.values()) == 1
        else:
            assert {r[0] for r in got} == {r[0] for r in before} and after.columns[0] == "doc_id"
        if check != "pack":
            assert after.columns == columns
        docs = after


def test_run(spark, sf_dir):
    first, second = ({tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "ids_crc32").collect()} for _ in range(2))
    assert first == second and first


def test_odd_documents(spark, make, tmp_path):
    rows = [(*r, "s") for r in ODD]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    make(rows).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_every_operator_is_registered():
    import __spark_entry__

    names = {re.match(r"op(\d+)_", q)[1] for q in __spark_entry__.queries() if q.startswith("op")}
    assert names == {str(n) for n in range(1, 13)} and "pipeline" in __spark_entry__.queries()


def test_near_stage_links_from_eighty_on(spark, make):
    rows = corpus_near(seed=11)
    words = [f"w{k}" for k in range(80)]
    rows += [(1000, " ".join(words)), (1001, " ".join(words[:40] + ["other"] + words[41:])), (1002, " ".join([*words[:20], "p", *words[21:40], "q", *words[41:60], "r", *words[61:]]))]
    before = make([*rows[:-2], rows[-1], (1003, " ".join([*words[:78], "x", "y"])), (1004, " ".join(["v", *words[1:40], "u", *words[41:]]))])
    pairs = [(r["doc_id"], r["text"]) for r in before.collect()]
    groups, strict = brute_groups(pairs, percent=80), brute_groups(pairs)
    kept = {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, before, "").collect()}
    assert kept == {i for i, (_, c) in groups.items() if c == i} != {i for i, (_, c) in strict.items() if c == i}
