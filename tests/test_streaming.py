from __future__ import annotations

import numpy as np
from fieldloom.operators import kernels
from fieldloom.streaming import bases

P = 101
SCHEMA = "label int, x array<long>, extra string"


def vectors(seed, many, of_rank=3, width=7):
    r = np.random.default_rng(seed)
    base = r.integers(0, P, (of_rank, width))
    return [(k % 3 if k % 10 else None, ((r.integers(0, P, of_rank) @ base[: 1 + k % 3 if k % 3 < 2 else of_rank].sum(axis=0, keepdims=True).repeat(of_rank, axis=0)) % P).tolist() if k % 4 else r.integers(-P, P, width).tolist(), "x") for k in range(many)]


def expected(rows):
    out = {}
    for label in {r[0] for r in rows}:
        mine = [r[1] for r in rows if r[0] == label and r[1] is not None and len(r[1]) == 7 and None not in r[1]]
        if mine:
            out[label] = (len(mine), len(kernels.reduced(np.array(mine), P)[0]))
    return out


def found(spark, path):
    return {r["label"]: (r["rows"], r["rank"]) for r in bases.latest(spark, path, "label").collect()}


def test_ranks_grow_with_the_stream(spark, tmp_path):
    source, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    first = [*vectors(1, 11), (5, None, "x"), (5, [1, 2], "x"), (5, [1, None, 3, 4, 5, 6, 7], "x"), (6, [0] * 7, "x")]
    second = [*vectors(2, 30), *vectors(1, 11), (6, [P] * 7, "x"), (6, [1] * 7, "x")]
    read = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    spark.createDataFrame(first, SCHEMA).repartition(3).write.parquet(source)
    bases.ranks_to(bases.ranks(read(), "label", "x", 7, P), out, ck)
    assert found(spark, out) == expected(first) and found(spark, out)[6] == (1, 0)
    spark.createDataFrame(second, SCHEMA).repartition(3).write.mode("append").parquet(source)
    bases.ranks_to(bases.ranks(read(), "label", "x", 7, P), out, ck)
    assert found(spark, out) == expected(first + second) and found(spark, out)[6] == (3, 1)
    bases.ranks_to(bases.ranks(read(), "label", "x", 7, P), out, ck)
    assert found(spark, out) == expected(first + second)
