"""Connected components over an edge table (AGG-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import discard, written


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool, name: str) -> DataFrame:
    """Each node's larger (or smaller) neighbours move to the least node around it.

    The least neighbour comes from an aggregate with map-side combine. It is written before it goes
    back to the edges, so that this join stands on two plain exchanges: AQE splits it at a hub, or
    broadcasts the least nodes where they are few.
    """
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = written(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
    moved = around.where(F.col("v") > F.col("u")) if large else around
    out = moved.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    out = written(out.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    discard(least)
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable.

    Alternates large-star and small-star rounds; each is a written table, and the tables of earlier
    rounds are deleted. Null ends and self-loops are no edges, repeated edges count once, and no
    edges give no rows.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    edges = written(edges, name)
    before = _digest(edges)
    while before[0]:
        large = _star(edges, True, name)
        small = _star(large, False, name)
        discard(edges, large)
        edges, now = small, _digest(small)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
