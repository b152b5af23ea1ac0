"""Distributed connected components by alternating stars.

Every round rewires each node's larger neighbours to its smallest known
neighbour (large star), then its smaller ones (small star).  Both are one
``min`` aggregate and one equi join on the edge list, so nothing is gathered
in one place: the aggregate combines map-side and the join may be split by
adaptive execution when one node holds many edges.  The number of rounds is
logarithmic in the graph's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerline.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over directed edges (u, v)."""
    if large:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(low, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """``(id, component)`` for every node of an undirected edge list.

    ``component`` is the smallest id reachable.  Self loops and repeated edges
    are fine; edges with a null end are ignored; a node that has only a self
    loop or no edge is not in the result.  An empty edge list gives no rows.
    """
    now = cut(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    mark = None
    for _ in range(max_rounds):
        stats = now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if stats[0] == 0 or tuple(stats) == mark:
            break
        mark = tuple(stats)
        now = cut(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Settled: every edge points from a node to its component's smallest id.
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
