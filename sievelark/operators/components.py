"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and joins on the node id; no neighbourhood is ever
collected into one row, so a hub holding a third of all edges is only a skewed join
(which adaptive execution splits), and rounds grow with the logarithm of the longest
chain. Every round is cut to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelark.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (a, b) with a > b."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(low, "a").select(F.col("b").alias("x"), "m").where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(low.select("a", F.col("m").alias("b")))
        moved = moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges`; root is the smallest node of its component.

    Null ends are ignored; self-edges give a component of one; repeated edges are no matter;
    an empty input gives an empty result."""
    raw = edges.select(F.col(left).alias("l"), F.col(right).alias("r")).where("l is not null and r is not null")
    nodes = raw.select(F.explode(F.array("l", "r")).alias("node")).distinct()
    work = cut(raw.where("l <> r").select(F.greatest("l", "r").alias("a"), F.least("l", "r").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        work = cut(_star(_star(work, True), False))
        now = work.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = work.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.join(roots, nodes.node == roots.a, "left").select("node", F.coalesce("root", "node").alias("root"))
