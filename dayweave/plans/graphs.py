"""Iterative work on pair tables; every round is written to the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayweave.session import ensure_checkpoint_dir


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Component of every node as ``(node, component)``; the component is its smallest node.

    Alternates the large-star and small-star steps, which shorten paths by half per round. Minima are
    combined before the shuffle, so a hub node does not meet its neighbours in one task.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct().checkpoint()
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = small.where("u <> v").distinct().checkpoint()
        # Both are sets: equal sizes and no new link means nothing changed.
        same = after.count() == links.count() and after.join(links, ["u", "v"], "left_anti").isEmpty()
        links = after
        if same:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes a greedy pass in rank order accepts when it rejects neighbours of accepted nodes.

    ``nodes`` is ``(node, rank)``, ``edges`` is ``(earlier, later)`` by rank. A node is accepted once
    all its earlier neighbours are rejected, and rejected once one of them is accepted.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    state = nodes.select("node", F.lit(None).cast("boolean").alias("accepted")).checkpoint()
    edges = edges.select("earlier", "later").checkpoint()
    while not state.where("accepted is null").isEmpty():
        seen = edges.join(state.select(F.col("node").alias("earlier"), "accepted"), "earlier").groupBy("later").agg(
            F.bool_or(F.coalesce("accepted", F.lit(False))).alias("_hit"), F.bool_or(F.col("accepted").isNull()).alias("_wait")
        )
        verdict = F.when(F.col("_hit"), F.lit(False)).when(F.coalesce("_wait", F.lit(False)), F.lit(None).cast("boolean")).otherwise(F.lit(True))
        state = state.join(seen, state.node == seen.later, "left").select("node", F.coalesce("accepted", verdict).alias("accepted")).checkpoint()
    return state.where("accepted").select("node")
