"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is a few aggregations and joins on node keys; no neighbourhood is collected, so a hub with any
number of edges costs a partial minimum per task. Edges of a round are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.shared import written


def _seal(edges: DataFrame) -> tuple:
    """Tells equal edge sets from different ones: their number and two order-free sums of hashes."""
    h = F.xxhash64("a", "b")
    x = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).alias("s")).first()
    return x["n"], x["x"], x["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node that it sees."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("at"), F.least("a", "low").alias("low"))
    return both.join(least, F.col("a") == F.col("at")).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them. Needs a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    under = edges.join(least.withColumnRenamed("a", "at"), F.col("a") == F.col("at")).where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return under.union(least.select("a", F.col("low").alias("b"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of an edge, component being the smallest node reachable.

    edges: two columns of one orderable type; loops, nulls and repeats are ignored. Nodes that are the
    smallest of their component are listed too.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seal = _seal(edges)
    for _ in range(rounds):
        if not seal[0]:
            break
        after = written(_small_star(_large_star(edges)), "edges")
        new = _seal(after)
        edges, done, seal = after, new == seal, new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.union(edges.select("b", "b").distinct()).toDF("node", "component")
