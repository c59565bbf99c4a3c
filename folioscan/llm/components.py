"""Connected components by alternating star contractions over a written edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import Scratch, join_by_degree

def _star(edges: DataFrame, large: bool, n_edges: int, scratch: Scratch) -> DataFrame:
    """One star step over edges (u, v), u > v: each vertex ties its larger (or smaller) neighbours to its least one.

    The least neighbour is a map-side combined aggregate.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.sum((F.col("v") > F.col("u")).cast("long")).alias("n")).where("n > 0")
        out = join_by_degree(both.where("v > u"), low, ["u"], "n", n_edges, scratch).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        out = join_by_degree(edges, low, ["u"], "n", n_edges, scratch).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component_id) for every vertex of edges (u long, v long); component_id is the least id that links reach.

    Vertices without edges are not listed: they are their own component. Self links and nulls are ignored. Alternates
    large-star and small-star steps until nothing changes; each step is a written table, so that lost executors
    cost one step at most. Nothing is collected but counts.
    """
    now = scratch.table(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    n, mark = now.count(), None
    while n:
        # A large step never adds edges, a small one at most a vertex's own.
        now = scratch.table(_star(now, True, n, scratch), "large", n)
        now = scratch.table(_star(now, False, n, scratch), "small", 2 * n)
        n, sum_ = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if mark == (n, sum_):
            break
        mark = (n, sum_)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
