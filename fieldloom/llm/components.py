"""Connected components of an edge table by local union-find and contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import cut


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one partition's edges: every node but the roots with its root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    for pdf in frames:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    pairs = [(x, find(x)) for x in list(parent)]
    yield pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["a", "b"], dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of ``edges`` (a, b: long); component is the least node reachable.

    Each round replaces a partition's edges by the forest that union-find makes
    of them, lets every node follow its neighbour of least hashed priority
    (itself included) and contracts the edges along that choice.  Hashed
    priorities make the expected number of nodes fall by a constant factor a
    round whatever the ids' order.  No edges, no rows.
    """
    rank = F.xxhash64("b")
    left, steps = cut(edges.mapInPandas(_forest, "a long, b long"), "edges"), []
    while not left.isEmpty():
        both = left.union(left.select("b", "a")).union(left.select("a", F.col("a").alias("b"))).union(left.select("b", F.col("b").alias("a")))
        chosen = cut(both.toDF("a", "b").groupBy(F.col("a").alias("node")).agg(F.min(F.struct(rank.alias("rank"), "b"))["b"].alias("parent")), "chosen")
        steps.append(chosen)
        moved = (
            left.join(chosen.toDF("a", "pa"), "a").join(chosen.toDF("b", "pb"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
            .where("a <> b").distinct()
        )
        left = cut(moved.mapInPandas(_forest, "a long, b long"), "edges")
    if not steps:
        return cut(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0), "components")
    label = steps[0]
    for step in steps[1:]:
        label = label.join(step.toDF("parent", "next"), "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"))
    label = cut(label, "roots")
    least = cut(label.groupBy("parent").agg(F.min("node").alias("component")), "least")
    return cut(label.join(least, "parent").select("node", "component"), "components")
