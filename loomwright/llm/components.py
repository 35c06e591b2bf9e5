"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import attach_min, cut, discard


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Edges (a, b) of any orderable type -> rows (node, component), component being the
    smallest node reachable. Only nodes of at least one edge between two different
    nodes appear. Null ends are ignored; repeated and reversed edges count once; no edges
    give no rows. Rounds grow with the logarithm of the longest path; if max_rounds of them
    don't finish, which no table should reach, RuntimeError is raised.

    Each round is O(edges); a hub's edges are spread by salted minima, and each
    round's edges are written to the shared folder, so lineage stays short.
    """
    now = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc"
    )
    before = _signature(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = attach_min(both, "u", "v", "m").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        small = attach_min(large.distinct(), "u", "v", "m")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = cut(small.select("e.u", "e.v").where("u <> v").distinct(), "cc")
        after = _signature(new)
        discard(now)
        now = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not final after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
