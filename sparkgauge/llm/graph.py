"""Connected components by alternating large-star and small-star steps over an edge table (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node hands its neighbours (large: the larger; small: the smaller, and itself) to the least of them."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = both.join(least, "a")
    if large:
        return moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    own = least.where("m < a").select("a", F.col("m").alias("b"))
    return moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).distinct()


def _settled(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges``, by rounds. Edges stay distributed and are written after each round;
    two sums come to the driver."""
    edges = edges.select("a", "b").where("a <> b").distinct()
    before = None
    for _ in range(rounds):
        edges = common.materialize(_star(_star(edges, True), False), "components")
        sums = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if sums == before:
            break
        before = sums
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long): the component is its smallest node.

    Loops and repeated edges don't matter; no edges give an empty result. Each edge's first end counts as a hub: nodes
    are first gathered under the hubs they hang on, and the rounds only run over links between hubs, so a star of any
    size is one node there. A node is expected to hang on a bounded number of hubs.
    """
    edges = edges.select("a", "b").where("a <> b")
    hangs = edges.unionByName(edges.select("a", F.col("a").alias("b"))).groupBy(F.col("b").alias("node")).agg(F.sort_array(F.collect_set("a")).alias("hubs"))
    hangs = common.materialize(hangs, "hubs")
    between = hangs.where(F.size("hubs") > 1).select(F.col("hubs")[0].alias("a"), F.explode(F.slice("hubs", F.lit(2), F.size("hubs") - 1)).alias("b")).distinct()
    joined = _settled(between).select(F.col("node").alias("hub"), F.col("component").alias("_to"))
    first = hangs.select("node", F.col("hubs")[0].alias("hub"))
    first = common.materialize(first, "hub-of")
    counts = first.groupBy("hub").agg(F.count("*").alias("_rows"))
    gathered = common.salted_join(first, joined, "hub", counts, "node", how="left").select("node", F.coalesce("_to", "hub").alias("_c"))
    gathered = common.materialize(gathered, "gathered")
    # the smallest hub isn't always the smallest node
    least = common.materialize(gathered.groupBy("_c").agg(F.min("node").alias("component"), F.count("*").alias("_rows")), "heads")
    return common.salted_join(gathered, least.select("_c", "component"), "_c", least.select("_c", "_rows"), "node").select("node", "component")
