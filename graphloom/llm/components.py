"""Connected components of an edge table by alternating star contraction.

Every round replaces edges by edges to smaller neighbours (first each node's
larger neighbours, then its smaller ones) until nothing changes; what is left is
a star around each component's smallest node.  Rounds are written to the shared
folder, so lineage stays short and a lost executor costs one stage.  Nothing is
collected but three numbers a round; nodes with a large share of all edges meet
them by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialise, share_join


def _large(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    up = F.count_if(F.col("v") > F.col("u")).alias("n")
    least = both.groupBy("u").agg(F.min("v").alias("m"), up).select("u", F.least("u", "m").alias("m"), "n")
    return share_join(both.where("v > u"), least, ["u"], n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = share_join(down, least, ["u"], n).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of any order -> (node, root): every node that has an edge, with its component's least node."""
    now = materialise(edges.select("u", "v").where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        mid = materialise(_large(now, state[0]), "edges")
        after = materialise(_small(mid, mid.count()), "edges")
        new = _state(after)
        discard(now, mid)
        now, old, state = after, state, new
        if new == old:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
