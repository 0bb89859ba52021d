"""Connected components of an edge list by alternating large-star and small-star steps.

Every step joins a node with the smallest node of its neighbourhood, so the number of rounds is logarithmic and the edge
list never grows. Minima are taken with a map-side partial aggregate; a node with very many neighbours is a skewed key on
one side of an inner join only, which adaptive execution splits. Each round is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v): long ids. Returns (id, component): every id of an edge with u ≠ v and the smallest id reachable.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows.
    """
    shared_dir(edges.sparkSession)
    e = (edges.where(F.col("u") != F.col("v"))
         .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint())
    before = _state(e)
    while True:
        # large star: the larger neighbours of a node are tied to the smallest of its neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: the smaller neighbours of a node, and itself, are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = small.checkpoint()
        after = _state(e)
        if after == before:
            break
        before = after
    ids = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
