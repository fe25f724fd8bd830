"""Connected components of a graph of any size by alternating large and small stars.

Only edges move: in each round every node hands its neighbours the smallest node it knows of. Nothing is collected; each round is cut by
a table in the shared folder. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.session import forget, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", limit: int = 100) -> DataFrame:
    """``node, component`` for every node of an edge; the component is its smallest node. Loops and repeated edges are allowed.

    NULL ends are left out; an empty table gives no rows. ``limit`` stops a run that cannot end and raises instead of guessing.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    now = materialize(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(limit):
        nxt = materialize(_small(_large(now)), "edges")
        new = _mark(nxt)
        forget(now)
        now = nxt
        if new == mark:
            found = now.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("component"))
            return nodes.join(found, F.col("node") == F.col("n"), "left").select("node", F.coalesce("component", "node").alias("component"))
        mark = new
    raise RuntimeError(f"components not settled after {limit} rounds")


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.where("v > u").join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    low = e.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
    hop = e.join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return hop.union(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()
