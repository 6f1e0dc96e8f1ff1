"""Interval joins as equi-joins on aligned bins of growing width.

Time is cut into bins, and bins are nodes of a binary tree: a node of level ``k`` covers ``2**k`` neighbouring
bins. A span is cut into the few largest nodes that make it up, at most two a level, so a span of a year costs
some dozens of rows however short the bins are; a moment belongs to one node of every level. Two spans share
a bin exactly if one starts in the other, so each pair is met once: the start of one side at a node of the
other. How many levels a moment is placed on follows from the longest span of its key on the other side. The
join key is ``(keys, level, node)``; adaptive execution splits a node that is too large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN_SECONDS = 60.0
CELL = "struct<side: int, level: int, node: long>"


def _bin(col: Column, width: float) -> Column:
    return F.floor(col / F.lit(float(width))).cast("long")


def top_level(count: Column) -> Column:
    """The highest level a span of so many bins can have a node on."""
    return F.floor(F.log2(F.greatest(count, F.lit(1)).cast("double"))).cast("int")


def _cell(side: int, level: Column, node: Column) -> Column:
    return F.struct(F.lit(side).alias("side"), level.cast("int").alias("level"), node.cast("long").alias("node"))


def cover(low: Column, high: Column, side: int = 0) -> Column:
    """The nodes that make up the bins from ``low`` to ``high``, none where they are reversed."""

    def at_level(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k)
        first, end = F.ceil(low / size), F.floor((high + 1) / size)
        inside = first < end
        left = F.when(inside & (F.pmod(first, F.lit(2)) == 1), _cell(side, k, first))
        right = F.when(inside & (F.pmod(end, F.lit(2)) == 1), _cell(side, k, end - 1))
        return F.array(left, right)

    nodes = F.flatten(F.transform(F.sequence(F.lit(0), top_level(high - low + 1)), at_level))
    return F.when(low <= high, F.filter(nodes, lambda x: x.isNotNull())).otherwise(F.array().cast(f"array<{CELL}>"))


def ancestors(at: Column, top: Column, side: int = 0) -> Column:
    """The nodes of levels 0 to ``top`` that a bin belongs to; none for a null level."""
    nodes = F.transform(F.sequence(F.lit(0), top), lambda k: _cell(side, k, F.floor(at / F.pow(F.lit(2.0), k))))
    return F.coalesce(nodes, F.array().cast(f"array<{CELL}>"))


def binned_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    condition: Column,
    *,
    width: float = BIN_SECONDS,
) -> DataFrame:
    """Inner join of rows whose closed spans share a bin and satisfy ``condition``.

    Column names of the two sides must differ apart from ``keys``, of which there is at least one. A span
    whose end lies before its start shares no bin with anything and is left out.
    """
    keys = list(keys)

    def binned(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        spans = df.where(F.col(span[0]) <= F.col(span[1]))
        return spans.withColumns({f"{name}0": _bin(F.col(span[0]), width), f"{name}1": _bin(F.col(span[1]), width)})

    a, b = binned(left, left_span, "_a"), binned(right, right_span, "_b")
    # A pair in which b does not start later than a, or in which it does: each pair is one of them.
    a_top = a.groupBy(*keys).agg(top_level(F.max(F.col("_a1") - F.col("_a0")) + 1).alias("_top_a"))
    b_top = b.groupBy(*keys).agg(top_level(F.max(F.col("_b1") - F.col("_b0"))).alias("_top_b"), F.max(F.col("_b1") - F.col("_b0")).alias("_long_b"))
    b_top = b_top.select(*keys, F.when(F.col("_long_b") > 0, F.col("_top_b")).alias("_top_b"))
    own, other = F.col("_a0"), F.col("_b0")
    placed_a = a.join(b_top, keys).withColumn("_at", F.explode(F.concat(cover(own, F.col("_a1"), 0), ancestors(own, F.col("_top_b"), 1)))).drop("_top_b")
    placed_b = b.join(a_top, keys).withColumn("_at", F.explode(F.concat(ancestors(other, F.col("_top_a"), 0), cover(other + 1, F.col("_b1"), 1)))).drop("_top_a")
    spread = {"_side": F.col("_at.side"), "_level": F.col("_at.level"), "_node": F.col("_at.node")}
    placed_a, placed_b = placed_a.withColumns(spread).drop("_at"), placed_b.withColumns(spread).drop("_at")
    return placed_a.join(placed_b, [*keys, "_side", "_level", "_node"]).where(condition).drop("_a0", "_a1", "_b0", "_b1", "_side", "_level", "_node")
