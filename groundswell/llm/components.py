"""Connected components of a link table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundswell.llm.common import checkpointed

ROUNDS = 60  # halving distances each round, this covers any graph; reached only on a fault


def _fingerprint(edges: DataFrame) -> tuple:
    """Changes when the set of (distinct) edges does."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to one row (node, component) per linked node.

    ``component`` is the smallest node reachable. Alternates two star operations
    (Kiveris et al., "Connected Components in MapReduce and Beyond"): each node hands
    its larger, then its smaller neighbours to the smallest one it knows, until every
    edge points at its component. All steps are aggregates with map-side combine and
    inner joins that adaptive execution can split; a node with a third of all edges
    needs no single task. Each round is cut with a reliable checkpoint.
    Nulls and self-links are dropped; an empty table gives an empty result.
    """
    ordered = links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges = checkpointed(ordered.distinct())
    before = _fingerprint(edges)
    for _ in range(ROUNDS):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(parent, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(moved.union(parent.select("u", F.col("m").alias("v"))).distinct())
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
