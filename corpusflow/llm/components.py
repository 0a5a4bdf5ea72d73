"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.staging import staged


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(lowest.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    found = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return int(found[0]), int(found[1])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (u, v: bigint); component is its smallest node.

    Each step is a written table, so nothing is recomputed and lost executors cost one step;
    only two numbers per step come to the driver. A node with very many neighbours is a
    skewed join that adaptive execution splits; minima are combined before they are shuffled.
    """
    current = staged(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges",
    )
    before = _state(current)
    while before[0]:
        current = staged(_stars(current), "stars")
        after = _state(current)
        if after == before:
            break
        before = after
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
