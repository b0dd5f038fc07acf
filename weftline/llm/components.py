"""Connected components by hash-to-min, over links held as rows.

Each node keeps a cluster of known members of its component, one row for each member. A round sends a node's whole
cluster to its least member, and the least member to everyone in the cluster; what arrives is the new cluster. When a
round changes nothing, the least node of a component holds all of it and every other node holds the least node only.
The clusters are rows, so a component with a third of all nodes is never gathered into one task: minima are
pre-aggregated before the shuffle, and adaptive execution splits a hot key of the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release

MAX_ROUNDS = 64


def hash_to_min(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Rows (node, component) for every node in ``links``; component is the least node connected with it.

    Nodes are of any one orderable type. Links without either end are ignored, a link from a node to itself makes it
    a component of its own, repeated links count once, and no links give no rows. Other columns are ignored.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    clusters = pairs.union(pairs.select("v", "u")).union(pairs.select("u", "u")).union(pairs.select("v", "v")).toDF("node", "member").distinct()
    clusters = materialize(clusters, "clusters")
    for _ in range(max_rounds):
        least = clusters.groupBy("node").agg(F.min("member").alias("least"))
        sent = clusters.join(least, "node").select("node", "member", "least")
        # what a node sends: its cluster to the least member, the least member to all
        arrived = sent.select(
            F.explode(
                F.array(
                    F.struct(F.col("least").alias("node"), F.col("member").alias("member")),
                    F.struct(F.col("member").alias("node"), F.col("least").alias("member")),
                )
            ).alias("x")
        ).select("x.*").distinct()
        before, clusters = clusters, materialize(arrived, "clusters")
        release(before)
        if _stable(clusters):
            break
    else:
        raise RuntimeError(f"components aren't stable after {max_rounds} rounds")
    return clusters.groupBy("node").agg(F.min("member").alias("component"))


def _stable(clusters: DataFrame) -> bool:
    """Whether every node but the least of its component holds exactly the least one, and that one holds it."""
    per = clusters.groupBy("node").agg(F.min("member").alias("least"), F.max("member").alias("most"), F.count("*").alias("n"))
    # a node is done if it is its own minimum, or if it knows one member only; else its cluster must still move on
    odd = per.where("least < node and (n > 1)")
    if odd.limit(1).count():
        return False
    # each node's minimum must itself be a minimum of its own cluster
    heads = per.where("least = node").select(F.col("node").alias("least"))
    return per.where("least < node").join(heads, "least", "left_anti").limit(1).count() == 0
