"""Connected components by large-star and small-star rounds (Kiveris et al. 2014) on joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausedelta.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (bigint). Gives node, comp: the smallest node reachable, for every node of an edge.

    Each round is written to the shared folder; a hub's neighbours are rows of a join, never a list.
    Self-links give components of one node; nulls are left out.
    """
    now = written(edges.where("a is not null and b is not null").select("a", "b").distinct(), "cc")
    before = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = written(
            both.join(least, "u").where("v >= u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc"
        )
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lower, "u")
        old, now = now, written(
            joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .distinct(),
            "cc",
        )
        discard(old, large)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 31))).first()
        if state == before:
            return now.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "node")
        before = state


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels: node, comp; links: a, b among its nodes. The labels once the links hold too."""
    left = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    right = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    joined = links.join(left, "a").join(right, "b").where("ca <> cb")
    found = components(joined.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    moved = found.select(F.col("node").alias("comp"), F.col("comp").alias("to_comp"))
    rows = labels.join(moved, "comp", "left").select("node", F.coalesce("to_comp", "comp").alias("comp"))
    return written(rows, "labels")
