"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find.

1.  Texts with the same shingle set form one class; its least doc_id stands for it.
2.  Each class gives one key per band of its signature.  Keys held by one class
    only are dropped after a count that combines within tasks.
3.  Every class is compared, on whole sets, with one leader: the most central
    of the leaders of its buckets.  This is linear in the classes, and the
    links it confirms are grouped by union-find.
4.  A bucket whose classes are then all in one group needs nothing more.  The
    classes of the other buckets go through an exact prefix filter: two sets of
    Jaccard similarity t or more share one of their rarest shingles, the
    smaller set within its first n - ceil(2t/(1+t) n) + 1 and the larger within
    n - ceil(t n) + 1.  The order that says which are rarest is exact: shingles
    that one group alone holds come first, since they make no pair, then the
    others by the number of sets that hold them.  Only pairs of different groups
    that also pass the bounds on size and position are compared, on whole sets.
5.  All confirmed links are grouped by union-find.

Nothing is capped: big buckets are handled by their leader and the filter, and
the joins on hot keys read written tables on both sides, so adaptive execution
splits them.  Nothing that grows with the input reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import LOWER, UPPER, cut, table
from fieldloom.llm.components import components
from fieldloom.llm.memory import tidy
from fieldloom.llm.shingles import mix, sets_of
from fieldloom.llm.superminhash import band_keys, signature

#: Sets are linked when 100 * intersection >= PERCENT * union.
PERCENT = 85

_FEATURES = "doc_id long, n long, h1 long, h2 long, bands array<long>"


@tidy
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt1, salt2 = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)
    for batch in batches:
        for at in range(0, max(1, len(batch)), 1024):
            part = batch.slice(at, 1024)
            sets = list(sets_of(part.column(1)))
            h = [np.array([mix(s ^ salt).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64) for salt in (salt1, salt2)]
            full = [s for s in sets if len(s)]
            keys = band_keys(np.array([signature(s) for s in full])).view(np.int64) if full else np.zeros((0, 1), np.int64)
            widths = np.array([len(s) > 0 for s in sets], dtype=np.int64) * keys.shape[1]
            edges = np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(keys.ravel(), pa.int64()))
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), n, pa.array(h[0], pa.int64()), pa.array(h[1], pa.int64()), bands], ["doc_id", "n", "h1", "h2", "bands"])


@tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, max(1, len(batch)), 1024):
            part = batch.slice(at, 1024)
            packed = [s.tobytes() for s in sets_of(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(p) // 8 for p in packed], pa.int64()), pa.array(packed, pa.binary())], ["node", "n", "shingles"])


def _confirm(percent: int):
    @tidy
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            linked = np.zeros(len(batch), dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                shared = int(np.count_nonzero(t[at] == s))
                linked[i] = 100 * shared >= percent * (len(s) + len(t) - shared)
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return confirm


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose whole sets reach ``percent``."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")


@tidy
def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per shingle of each set."""
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            shingles = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(3)]
            sizes = [len(s) for s in shingles]
            columns = [np.concatenate(shingles), *(np.repeat(part.column(k).to_numpy(), sizes) for k in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "set", "n", "grp"])


def prefix_pairs(open_sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different groups among ``open_sets`` (node, grp, set, n, shingles) that may reach ``percent``.

    A set's shingles that only its own group holds take its first places; those
    of several groups (``mixed``) follow by the number of sets that hold them.
    """
    whole = ["set", "n", "grp"]  # a set, once for each group that has it
    held = cut(open_sets.dropDuplicates(whole).select(*whole, "shingles").mapInArrow(_exploded, "shingle long, set long, n long, grp long"), "shingles")
    mixed = cut(held.groupBy("shingle").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count(F.lit(1)).alias("held")).where("lo <> hi").select("shingle", "held"), "mixed")
    ranked = held.join(mixed, "shingle").groupBy(*whole).agg(F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("m")).withColumn("own", F.col("n") - F.size("m"))
    first = F.expr(f"slice(m, 1, cast(greatest(0L, n - ({percent} * n + 99) div 100 + 1 - own) as int))")
    rows = open_sets.select("node", *whole).join(ranked, whole).select("node", "n", "grp", "own", F.posexplode(first).alias("at", "s"))
    rows = rows.select(F.col("s.shingle").alias("shingle"), (F.col("own") + F.col("at")).alias("place"), "node", "n", "grp")
    rows = cut(rows.withColumn("indexed", F.expr(f"place < n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1")), "prefixes")
    x = rows.where("indexed").select("shingle", *(F.col(c).alias(f"{c}_a") for c in ("place", "node", "n", "grp")))
    y = rows.select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("place", "node", "n", "grp")))
    fits = F.expr(f"""
        grp_a <> grp_b and (n_a < n_b or n_a = n_b and node_a < node_b) and 100 * n_a >= {percent} * n_b
        and {100 + percent} * least(n_a - place_a, n_b - place_b) >= {percent} * (n_a + n_b)""")
    return x.join(y, "shingle").where(fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _same_documents(seen: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of doc_ids that several rows with different sets repeat."""
    whole = F.struct("h1", "h2", "n")
    known = seen.where("n > 0 and doc_id is not null")
    repeated = cut(known.groupBy("doc_id").agg(F.min(whole).alias("lo"), F.max(whole).alias("hi")).where("lo <> hi").select("doc_id"), "repeated")
    held = known.join(repeated, "doc_id", "left_semi").select("doc_id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"]).select("doc_id", "node").distinct()
    held = cut(held, "several")
    return held.groupBy("doc_id").agg(F.min("node").alias("a")).join(held, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked when 100 * intersection >= percent * union of their shingle
    sets; component_id is the least doc_id reachable, the row's own included.
    Null and empty texts and texts without words have no shingles and are linked
    with nothing.  Rows that repeat a doc_id are one document: its links are
    those of all its texts.  A null doc_id is linked with nothing and has a
    null component_id; it is kept.  Other columns are ignored.
    """
    seen = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_features, _FEATURES), "features")
    whole = ["h1", "h2", "n"]
    classes = cut(seen.where("n > 0 and doc_id is not null").groupBy(*whole).agg(F.min("doc_id").alias("node")), "classes")
    reps = cut(seen.join(classes.withColumnRenamed("node", "doc_id"), ["doc_id", *whole], "left_semi").select(F.col("doc_id").alias("node"), *whole, "bands").dropDuplicates(["node", *whole]), "representatives")
    keys = reps.select("node", "n", F.explode("bands").alias("key"))
    shared = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "keys")
    members = cut(keys.join(shared, "key"), "members")
    weights = cut(members.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    leaders = cut(members.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("lead")), "leaders")
    stars = (
        members.join(leaders, "key").where(f"100 * least(n, lead.n) >= {percent} * greatest(n, lead.n)")
        .groupBy(F.col("node").alias("b")).agg(F.max("lead").alias("lead"))
        .select(F.col("lead.node").alias("a"), "b").where("a <> b")
    )
    stars = cut(stars, "stars")
    candidates = cut(weights.select(F.col("node").alias("doc_id")), "candidates")
    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(candidates, "doc_id", "left_semi")
    sets = cut(chosen.mapInArrow(_sets, "node long, n long, shingles binary").where("n > 0").withColumn("set", F.xxhash64("shingles")).dropDuplicates(["node", "n", "set"]), "sets")
    links = cut(confirmed(stars, sets, percent).union(_same_documents(seen, classes)), "links")
    groups = components(links)
    placed = members.select("key", "node").join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("grp"))
    placed = cut(placed, "placed")
    unsettled = cut(placed.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("key"), "unsettled")
    left_open = cut(placed.join(unsettled, "key", "left_semi").select("node", "grp").distinct(), "open")
    pairs = cut(prefix_pairs(cut(sets.join(left_open, "node").select("node", "grp", "set", "n", "shingles"), "open_sets"), percent), "pairs")
    more = cut(confirmed(pairs, sets, percent), "more_links")
    if not more.isEmpty():
        groups = components(links.union(more))
    named = cut(classes.join(groups, "node", "left").select(*whole, F.coalesce("component", "node").alias("component_id")), "named")
    return seen.select("doc_id", *whole).join(named, whole, "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group; rows of a null doc_id all stay."""
    gone = cut(near_groups(docs, percent).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op1_minhash_near_dedup": op1_minhash_near_dedup}
ORACLES = {
    "op1_minhash_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM d, LATERAL unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, b.y FROM reach r JOIN edges b ON r.y = b.x),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""
}
