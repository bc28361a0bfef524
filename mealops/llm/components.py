"""Connected components by alternating large-star and small-star rounds.

Every round links each node to the smallest node it knows of; edges shrink to
stars around the smallest node of each component in a logarithmic number of
rounds. Minima are aggregates (combined before the shuffle), written and
joined back to the edges: broadcast if they are few, and else by a join of two
plain exchanges, which Spark can split at a node with very many edges (it
cannot split a join with an aggregate). Each round is checkpointed; only two
numbers per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_small, shared_folder, written


def _star(e: DataFrame, large: bool) -> DataFrame:
    """``e``: (a, b) with a > b. Large star links the larger neighbours of a node to the smallest
    node it touches, small star the smaller ones and itself."""
    if large:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), "star-low")
        out = both.join(broadcast_small(low), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        low = written(e.groupBy("a").agg(F.min("b").alias("low")), "star-low")
        out = e.join(broadcast_small(low), "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select("a", F.col("low").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long, any order) -> (node, root): root is the smallest node of the component.

    Nodes without an edge to another node do not appear; null ends are ignored.
    """
    shared_folder(edges.sparkSession, "components")           # a checkpoint folder is set
    e = (edges.where("a is not null and b is not null and a != b")
         .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint())
    state = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or now[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now
        e = _star(_star(e, large=True), large=False).checkpoint()
