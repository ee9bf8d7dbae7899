"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a target of words: its weight's share of the budget, but never more than `most` times its
size; what a capped source leaves is shared out again by weight. A source is then taken floor(target / size)
whole times, and the rest of its target comes from the documents whose hash lies below a threshold. The
threshold is found without sorting documents: sum words by source and hash bucket, locate the bucket in which
the running sum passes the rest, and refine that bucket alone. Thresholds are nested: of two budgets with the
same whole part, the larger one's threshold takes every document that the smaller one's takes. What is then
missing, less than one document, is filled from below with documents that fit, the largest first, until none
fits. If the smallest document left would go beyond the target, it goes in and documents that are in make room
for it in the same way, where that comes nearer. So a source falls short of its target by less than its smallest
document that is out, or goes beyond it by less than the smallest that is in.

Nulls: a null text has no words; null sources form one source, last in order; a null doc_id is hashed as null.
Repeated rows with the same doc_id and text share one decision. An empty table gives an empty result, and
sources without words get the target 0. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import SMALL_ROWS, ranked, table, word_count, written

#: Hash bits that one round of refinement resolves, and rounds.
BITS, ROUNDS = 12, 3


def source_targets(by_source: DataFrame, weights: list[float], most: float, share: float = 1.0) -> DataFrame:
    """One row per source (source, source_size) -> with target. Rows here are sources, not documents."""
    x = ranked(by_source, [F.col("source").asc_nulls_last()]).withColumnRenamed("position", "place")
    x = x.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") - 1).cast("int") % len(weights) + 1))
    x = x.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    # words per weight if the sources before this one, by ratio, stand at their cap: the largest such level is the one at which nothing is left over
    x = written(ranked(x, [F.col("ratio"), F.col("place")], {"capped": "cap", "used": "weight"}), "mix-ranked")
    whole = x.agg(F.sum("source_size").cast("double").alias("words"), F.sum("weight").alias("weights")).first()
    budget, total = share * (whole["words"] or 0.0), whole["weights"] or 1.0
    # weights are sums of a few constants: what is free is never less than the row's own weight
    level = x.agg(F.max((F.lit(budget) - F.col("capped")) / F.greatest(F.lit(total) - F.col("used"), F.col("weight")))).first()[0] or 0.0
    return x.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def _beside(docs: DataFrame, state: DataFrame, sources: int) -> DataFrame:
    """Joins the sources' rows to documents: broadcast if they were counted to be few, else by key with AQE's skew splitting."""
    state = state.withColumnRenamed("source", "_source")
    return docs.join(F.broadcast(state) if sources <= SMALL_ROWS else state, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _sized(docs: DataFrame) -> list[Column]:
    """source, size and hash of a row of docs."""
    return [F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("hash")]


def plan(slim: DataFrame, weights: list[float], most: float = 3.0, share: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    """What attaches source_size, target and copies to rows with source, size and hash, as the written table slim (of just these, for all documents) decides."""
    by_source = written(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    sources = by_source.count()
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = (
        source_targets(by_source, weights, most, share)
        .withColumn("base", F.floor(rate))
        .withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
    )
    state = written(state, "mix-state")
    for k in range(1, ROUNDS + 1):
        left = 64 - BITS * k
        bucket = F.shiftrightunsigned("hash", left)
        inside = _beside(slim, state.select("source", "prefix"), sources).where(F.shiftrightunsigned(bucket, BITS) == F.col("prefix") if k > 1 else F.lit(True))
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        # the bucket that holds the crossing: the last one that starts at or below the rest
        crossing = _beside(sums, state.select("source", "rest"), sources).where(F.col("before") <= F.col("rest"))
        cut = crossing.groupBy("source").agg(F.max_by(F.struct("bucket", "before", "words"), "bucket").alias("x")).select("source", "x.*")
        state = _beside(state.drop("prefix"), cut, sources).withColumn("rest", F.col("rest") - F.col("before"))
        state = written(state.withColumnRenamed("bucket", "prefix").drop("before", "words"), "mix-state")
    state = state.select("source", "source_size", "target", "base", "rest", F.col("prefix").alias("threshold"))
    chosen = F.when(F.col("base") >= most, False).otherwise(F.shiftrightunsigned("hash", 64 - BITS * ROUNDS) < F.col("threshold"))
    placed = _beside(slim, state.select("source", "base", "rest", "threshold"), sources).where((F.col("base") < most) & (F.col("size") > 0))
    placed = written(placed.select("source", "size", "hash", chosen.alias("in")), "mix-placed")
    outside, inside = (placed.where(c).select("source", "size", "hash") for c in ("not in", "in"))
    rest = state.select("source", F.col("rest").cast("double").alias("rest"))
    added, rest = _filled(outside, rest, sources)
    # where the smallest document left goes beyond the target, documents that are in make room for it
    over = written(_units(outside, rest, sources, [added], F.col("rest") > 0, []), "mix-over")
    beyond = over.select("source", (F.col("words") - F.col("rest")).alias("rest"))
    removed, beyond = _filled(_among(inside, added, True).union(_among(outside, added, False)), beyond, sources)
    nearer = rest.select(F.col("source").alias("_from"), F.col("rest").alias("without")).join(beyond, F.col("source").eqNullSafe(F.col("_from"))).where("rest < without").select(F.col("source").alias("_from"))
    swapped = over.select("source", "hash", F.lit(1).alias("by")).union(removed.select("source", "hash", F.lit(-1)))
    changes = added.select("source", "hash", F.lit(1).alias("by")).union(swapped.join(F.broadcast(nearer) if sources <= SMALL_ROWS else nearer, F.col("source").eqNullSafe(F.col("_from")), "left_semi"))
    changes = written(changes.groupBy(F.col("source").alias("_from"), F.col("hash").alias("_one")).agg(F.sum("by").alias("by")), "mix-changes")
    changes = F.broadcast(changes) if changes.count() <= SMALL_ROWS else changes

    def attach(rows: DataFrame) -> DataFrame:
        out = _beside(rows.withColumn("_same", F.col("source")), state, sources)
        out = out.join(changes, (F.col("hash") == F.col("_one")) & F.col("_same").eqNullSafe(F.col("_from")), "left")
        copies = F.col("base") + F.when(chosen, 1).otherwise(0) + F.coalesce("by", F.lit(0))
        return out.select(*[F.col("_same").alias(c) if c == "source" else c for c in rows.columns], "source_size", "target", copies.cast("long").alias("copies"))

    return attach


def mix(docs: DataFrame, weights: list[float], most: float = 3.0, share: float = 1.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, hash (of doc_id and text) for each document."""
    slim = written(docs.select("doc_id", *_sized(docs)), "mix")
    out = plan(slim.drop("doc_id"), weights, most, share)(slim).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", "hash")


def mixed(docs: DataFrame, weights: list[float], most: float = 3.0, share: float = 1.0) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Texts stay where they are read unless many documents fill gaps."""
    slim = written(docs.select(*_sized(docs)), "mix")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_sized(docs))
    out = plan(slim, weights, most, share)(rows).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def _among(pool: DataFrame, listed: DataFrame, out: bool) -> DataFrame:
    """The documents of `pool` that are listed (or, with `out`, that are not)."""
    listed = listed.select(F.col("source").alias("_from"), F.col("hash").alias("_one"))
    few = F.broadcast(listed) if listed.count() <= SMALL_ROWS else listed
    return pool.join(few, (F.col("hash") == F.col("_one")) & F.col("source").eqNullSafe(F.col("_from")), "left_anti" if out else "left_semi")


def _filled(pool: DataFrame, rest: DataFrame, sources: int) -> tuple[DataFrame, DataFrame]:
    """(source, hash) of documents of `pool` that fill each source's `rest` from below, the largest first, till none fits; and what is left of it."""
    picked, large = [pool.select("source", "hash").limit(0)], []
    while True:
        units = written(_units(pool, rest, sources, picked + large, F.col("size") <= F.col("rest"), [F.col("size"), F.pmod("hash", 2 * F.ceil(F.col("rest") / F.col("size")))]), "mix-units")
        if units.isEmpty():
            break
        large.append(units.where("words > rest").select("source", "hash"))  # with their repetitions; what is missing only gets less
        took = F.aggregate(
            F.array_sort(F.collect_list(F.struct((-F.col("words")).alias("less"), "hash"))),
            F.struct(F.max("rest").alias("rest"), F.array().cast("array<bigint>").alias("picked")),
            lambda acc, u: F.when(-u["less"] <= acc["rest"], F.struct((acc["rest"] + u["less"]).alias("rest"), F.concat(acc["picked"], F.array(u["hash"])).alias("picked"))).otherwise(acc),
        )
        took = written(units.groupBy("source").agg(took.alias("t")), "mix-took")
        picked.append(took.select("source", F.explode("t.picked").alias("hash")))
        less = took.select(F.col("source").alias("_from"), F.col("t.rest").alias("left"))
        rest = written(rest.join(less, F.col("source").eqNullSafe(F.col("_from")), "left").select("source", F.coalesce("left", "rest").alias("rest")), "mix-rest")
    return written(reduce(DataFrame.union, picked), "mix-picked"), rest


def _units(open_: DataFrame, rest: DataFrame, sources: int, passed: list[DataFrame], may: Column, by: list[Column]) -> DataFrame:
    """source, hash, words, rest: of the documents that `passed` does not list, the first by size and hash in each group, with its repetitions."""
    open_ = _among(open_, reduce(DataFrame.union, passed), True)
    first = _beside(open_, rest, sources).where(may).groupBy("source", *[c.alias(f"_b{k}") for k, c in enumerate(by)])
    first = written(first.agg(F.min(F.struct("size", "hash")).alias("f"), F.max("rest").alias("rest")).select(F.col("source").alias("_from"), F.col("f.hash").alias("_one"), "rest"), "mix-first")
    few = F.broadcast(first) if first.count() <= SMALL_ROWS else first
    same = open_.join(few, (F.col("hash") == F.col("_one")) & F.col("source").eqNullSafe(F.col("_from")))
    return same.groupBy("source", "hash").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weights 5, 2, 1 repeating over the sources in code point order, targets of at most three sizes."""
    return mix(table(spark, sf_dir, "documents"), [5.0, 2.0, 1.0]).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: Size, source_size and target of each document; which documents are taken depends on the hash, so `taken` is tested beside it.
QUERIES = {"op5_mixing": op5_mixing}
SQL: dict[str, str] = {}
