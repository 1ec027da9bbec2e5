"""Neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.kb import KnowledgeBase
from graphloom.store import cut


def neighbourhood(kb: KnowledgeBase, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """(seed, atom_id, hops): atoms within some hops of each seed (atom_id), the seed left out.

    A hop goes from an atom to a link that holds it, or from a link to a child.
    """
    inc = kb.incidence().select("link_id", "target_id")
    hop = inc.select(F.col("link_id").alias("at"), F.col("target_id").alias("to")).union(inc.select(F.col("target_id").alias("at"), F.col("link_id").alias("to")))
    # The hops are cut once; every step joins the same table.
    hop = cut(hop)
    front = seeds.select(F.col("atom_id").alias("seed"), F.col("atom_id").alias("at"))
    seen = front.withColumn("hops", F.lit(0))
    for k in range(1, depth + 1):
        step = front.join(hop, "at").select("seed", F.col("to").alias("at")).distinct().join(seen, ["seed", "at"], "left_anti")
        front = cut(step)
        if front.isEmpty():
            break
        seen = seen.unionByName(front.withColumn("hops", F.lit(k)))
    return seen.where("hops > 0").select("seed", F.col("at").alias("atom_id"), "hops")
