"""Connected components as DataFrame rounds (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut

MAX_ROUNDS = 64
#: Edges whose nodes a join may broadcast (16 bytes each); beyond, it shuffles.
BROADCAST_EDGES = 1_000_000


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that some edge joins to another one; root is the least node it reaches.

    Each round replaces a node's edges by edges to its least neighbour and is cut from its lineage in the
    shared checkpoint folder; rounds end when the edges, then stars around the roots, stay as they are.
    Loops and repeated edges are allowed; an empty table has no nodes."""
    now = (
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    now = cut(now)
    before = _state(now)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        # Up to a checked number of edges what joins them travels, and no node's edges meet in one task.
        light = F.broadcast if before[0] <= BROADCAST_EDGES else lambda df: df
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(light(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(light(parent), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        now = cut(small.union(parent.select("u", F.col("m").alias("v"))).distinct())
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
