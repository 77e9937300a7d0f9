"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent, divided
by their sum.  The exponent, from 1 (as found) to 0 (all sources alike), is found
by sections: every pass over the source table evaluates PROBES exponents at once
and keeps the gap that holds the target, which may be an entropy of the weights,
a limit on how often a source repeats, or both.

The weights become budgets of tokens.  A source's documents lie in blocks, dealt
by hash; its budget is as many whole passes as it holds, and for the rest blocks
in the order of a keyed permutation, the last one cut within by a permutation of
its documents.  Sources, however hot, are only ever aggregated or joined on
written tables; ordering happens among the blocks of a source and the documents
of one block.

The mixture is written in that order too: a document's place in its source's
permuted blocks, from 0 to 1, divided by its copies, is its place in the whole, and
every further copy comes a whole pass later.  So all sources are spread evenly from
the first row to the last, and copies of a document lie as far apart as they can.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm.common import cut, table

#: Documents meant for one block at least (the root of the source's documents where that is more, so that neither blocks nor their documents are too many to sort), exponents evaluated in a pass, and passes; these fix the exponent to about 1e-7.
PER_BLOCK, PROBES, PASSES = 4096, 16, 6
#: Production parameters: entropy of the weights as a share of the greatest possible, and passes over a source at most.
ENTROPY_SHARE, MAX_REPEAT = 0.99, 4.0


def _measured(sources: DataFrame, exponents: list[float], whole: bool) -> list[tuple[float, float]]:
    """For each exponent: the entropy of the weights and the passes over the most repeated source."""
    columns = []
    for k, a in enumerate(exponents):
        power = F.pow("share", F.lit(a))
        columns += [F.sum(power).alias(f"z{k}"), F.sum(power * F.log("share")).alias(f"l{k}"), F.max(F.pow("share", F.lit(a - 1))).alias(f"hi{k}"), F.min(F.pow("share", F.lit(a - 1))).alias(f"lo{k}")]
    r = sources.where("share > 0").agg(*columns).first()
    out = []
    for k, a in enumerate(exponents):
        z = r[f"z{k}"]
        out.append((float(math.log(z) - a * r[f"l{k}"] / z), r[f"hi{k}"] / (r[f"lo{k}"] if whole else z)))
    return out


def exponent(sources: DataFrame, entropy: float | None, max_repeat: float | None, budget_share: float, whole: bool) -> float:
    """The greatest exponent in [0, 1] whose weights reach ``entropy``, raised where needed to keep to ``max_repeat``."""

    def section(holds) -> tuple[float, float]:
        """Around the place where ``holds`` is lost for good as exponents grow: where it still holds and where it no longer does."""
        low, high = 0.0, 1.0
        at_most, at_least = _measured(sources, [0.0, 1.0], whole)
        if holds(*at_least):
            return 1.0, 1.0
        if not holds(*at_most):
            return 0.0, 0.0
        for _ in range(PASSES):
            at = [low + (high - low) * (k + 1) / (PROBES + 1) for k in range(PROBES)]
            for a, found in zip(at, _measured(sources, at, whole), strict=True):
                if holds(*found):
                    low = a
                else:
                    high = a
                    break
        return low, high

    found = math.floor(section(lambda h, _: h >= entropy)[0] * 1e6) / 1e6 if entropy is not None else 0.0
    if max_repeat is not None:  # the side that keeps to the limit
        kept = section(lambda _, r: r * (1.0 if whole else budget_share) > max_repeat)[1]
        found = max(found, min(1.0, math.ceil(kept * 1e6) / 1e6))
    return found


def plan(docs: DataFrame, entropy_share: float | None = ENTROPY_SHARE, max_repeat: float | None = MAX_REPEAT, budget: int | None = None, whole: bool = False, seed: int = 17) -> DataFrame:
    """How often each document is used: doc_id, source, text_hash, n_tokens, mix_block, weight, copies, place.

    ``place`` is the document's position, from 0 to 1, in a pass over its source.
    Tokens are words, maximal runs of bytes other than 0x20 and 0x09-0x0D.
    ``budget`` defaults to the tokens there are; with ``whole`` it is instead the
    least that uses every source at least once throughout.  A null source is the
    empty source; documents without tokens (null and empty texts too) cost
    nothing and come along with their block; other columns are ignored; an empty
    table gives no rows.  Rows that agree in doc_id and text stand or fall
    together.  No source is used more than ``max_repeat`` times, also where the
    budget then cannot be met.
    """
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    named = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), tokens.alias("n_tokens"), named.alias("__source"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("__order"))
    rows = cut(rows, "rows")
    sources = rows.groupBy("__source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    total = sources.agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("k")).first()
    n, k = total["n"] or 0, total["k"]
    sources = cut(sources.withColumn("share", F.col("tokens") / F.lit(max(1, n)).cast("double")), "sources")
    if n:
        goal = None if entropy_share is None else entropy_share * math.log(k)
        a = exponent(sources, goal, max_repeat, (budget if budget is not None else n) / n, whole)
        sums = sources.where("share > 0").agg(F.sum(F.pow("share", F.lit(a))).alias("z"), F.min(F.pow("share", F.lit(a - 1))).alias("lo")).first()
        size = n * sums["z"] / sums["lo"] if whole else (budget if budget is not None else n)
        weight = F.when(F.col("share") > 0, F.pow("share", F.lit(a)) / F.lit(sums["z"])).otherwise(0.0)
        wanted = F.floor(weight * F.lit(float(size)) + F.lit(1e-6))
        wanted = F.greatest(wanted, F.col("tokens")) if whole else wanted
        if max_repeat is not None:  # exact where rounding is not
            wanted = F.least(wanted, F.floor(F.col("tokens") * F.lit(float(max_repeat))))
    else:
        weight, wanted = F.lit(0.0), F.lit(0).cast("long")
    budgets = sources.withColumn("weight", weight).withColumn("wanted", wanted).select(
        "__source", "weight",
        F.when(F.col("tokens") > 0, F.floor(F.col("wanted") / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("long").alias("passes"),
        F.when(F.col("tokens") > 0, F.col("wanted") % F.greatest("tokens", F.lit(1))).otherwise(0).cast("long").alias("rest"),
        F.ceil(F.col("docs") / F.greatest(F.lit(float(PER_BLOCK)), F.sqrt("docs"))).cast("long").alias("blocks"),
    )
    budgets = cut(budgets, "budgets")
    placed = cut(rows.join(budgets, "__source").withColumn("mix_block", F.pmod("__order", "blocks")), "placed")
    blocks = placed.groupBy("__source", "mix_block").agg(F.sum("n_tokens").alias("held"), F.first("rest").alias("rest"))
    in_order = W.partitionBy("__source").orderBy(F.xxhash64(F.lit(seed + 1), "mix_block"), "mix_block").rowsBetween(W.unboundedPreceding, W.currentRow)
    blocks = blocks.withColumn("upto", F.sum("held").over(in_order)).withColumn("left", F.col("rest") - (F.col("upto") - F.col("held")))
    rank = F.row_number().over(W.partitionBy("__source").orderBy(F.xxhash64(F.lit(seed + 1), "mix_block"), "mix_block")) - 1
    blocks = cut(blocks.select("__source", "mix_block", "held", "left", rank.alias("rank")), "blocks")
    joined = placed.join(blocks, ["__source", "mix_block"])
    within = W.partitionBy("__source", "mix_block").orderBy(F.xxhash64(F.lit(seed + 2), "__order"), "__order").rangeBetween(W.unboundedPreceding, W.currentRow)
    last = joined.where("left > 0 and left < held").withColumn("extra", (F.sum("n_tokens").over(within) <= F.col("left")).cast("long"))
    others = joined.where("not (left > 0 and left < held)").withColumn("extra", ((F.col("left") > 0) & (F.col("left") >= F.col("held"))).cast("long"))
    place = (F.col("rank") + F.pmod(F.xxhash64(F.lit(seed + 2), "__order"), F.lit(1 << 30)) / F.lit(float(1 << 30))) / F.col("blocks")
    return others.unionByName(last).select("doc_id", "source", "text_hash", "n_tokens", "mix_block", "weight", (F.col("passes") + F.col("extra")).alias("copies"), place.alias("place"))


def mixture(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`plan` says, in the planned order; columns as in ``docs``, whatever their names.

    Partitions are consecutive stretches of the order, as many as the session's
    shuffle partitions, and sorted; rows that agree in doc_id and text stand
    together.  Places are hashes, so stretches are about equally long whatever
    source is hot.
    """
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.col("source").alias("origin"), F.xxhash64("text").alias("text"))
    used = cut(plan(docs, **parameters).select("doc_id", "source", "text_hash", "copies", "place").distinct(), "used")
    same = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("origin").eqNullSafe(F.col("source")) & (F.col("text") == F.col("text_hash"))
    rows = keyed.join(used, same).where("copies > 0").select("doc", "copies", "place", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select("doc", ((F.col("copy") - 1 + F.col("place")) / F.col("copies")).alias("at"))
    stretch = F.least(F.floor(F.col("at") * parts), F.lit(parts - 1)).cast("int")
    return placed.repartitionById(parts, stretch).sortWithinPartitions("at").select("doc.*")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"))


QUERIES = {"op5_source_mixing": op5_source_mixing}
ORACLES: dict[str, str] = {}
