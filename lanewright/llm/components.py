"""Connected components of a link table, by alternating large and small stars; all state stays in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import discard, materialize


def _hang(directed: DataFrame, keep_larger: bool) -> DataFrame:
    """Every neighbour v of u hangs on the least of u and its neighbours: the larger ones, or the smaller and u."""
    if keep_larger:
        least = directed.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        return directed.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    down = directed.where("v < u")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, on which nothing else is hung: one grouping of two numbers a node."""
    end = lambda of, hangs: F.struct(F.col(of).alias("node"), F.lit(hangs).alias("hangs"), F.lit(1 - hangs).alias("holds"))
    ends = edges.select(F.explode(F.array(end("a", 1), end("b", 0))).alias("e"))
    of_node = ends.select("e.*").groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return of_node.where("hangs > 1 OR hangs = 1 AND holds = 1").isEmpty()


def components(links: DataFrame, tasks: int | None = None, most_rounds: int | None = None) -> DataFrame:
    """node, component (its least node) for every node of ``links`` (a, b); ids of any type that has an order.

    A null id is no node, a link of a node with itself links nothing, repeated links count once. Each round is written
    to the shared folder (by ``tasks`` tasks at most) and the one before it deleted. The number of rounds grows with the logarithm of the longest
    chain, so it has no limit unless the caller sets one. A hub's links are joined to its least neighbour by a
    sort-merge join whose large side the adaptive planner splits; minima are taken partially before they are moved.
    """
    edges = materialize(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", tasks)
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    done = 0
    while not _settled(edges):
        if done == most_rounds:
            raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
        both = edges.select(F.explode(F.array(*(F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in ("ab", "ba")))).alias("e")).select("e.*")
        large = _hang(both, True).where("a <> b").distinct()
        small = _hang(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False)
        before, edges = edges, materialize(small.where("a <> b").distinct(), "edges", tasks)
        discard(before)
        done += 1
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
