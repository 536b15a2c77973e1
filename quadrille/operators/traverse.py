"""Components, breadth-first search and shortest connections. [G-13, G-31, M-10]"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b): each edge in both directions, once."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).where("a <> b").distinct()


def bfs(edges: DataFrame, start: DataFrame, most: int = 1_000_000, until: DataFrame | None = None) -> DataFrame:
    """(iri, distance) of all that is reached from start, undirected.  One join a level; the frontier alone is joined.
    until: stop once one of these is reached."""
    links = cut(both_ways(edges))
    seen = cut(start.select("iri").distinct().withColumn("distance", F.lit(0)))
    for d in range(1, most + 1):
        front = seen.where(F.col("distance") == d - 1).select(F.col("iri").alias("a"))
        new = links.join(front, "a").select(F.col("b").alias("iri")).distinct().join(seen, "iri", "left_anti").withColumn("distance", F.lit(d))
        new = cut(new)
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new))
        if until is not None and not seen.join(until, "iri", "left_semi").isEmpty():
            break
    return seen


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(iri, component): the least node that is reached.  Labels spread with pointer jumping, so rounds grow with the
    logarithm of the diameter. [G-31]"""
    links = cut(both_ways(edges))
    state = cut(nodes.select("iri", F.col("iri").alias("component")))
    while True:
        near = links.join(state.withColumnRenamed("iri", "b"), "b").groupBy(F.col("a").alias("iri")).agg(F.min("component").alias("near"))
        hooked = state.join(near, "iri", "left").select("iri", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        # jump: take on the component of one's component
        jump = hooked.select(F.col("iri").alias("component"), F.col("component").alias("far"))
        new = cut(hooked.join(jump, "component", "left").select("iri", "old", F.least("component", "far").alias("component")))
        if new.where("old <> component").isEmpty():
            return new.select("iri", "component")
        state = new.select("iri", "component")


def shortest_connection(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Nodes on any shortest undirected path between two nodes, none if there is none. [M-10, U-05]"""
    spark = edges.sparkSession
    one, other = (spark.createDataFrame([(x,)], "iri string") for x in (a, b))
    da = bfs(edges, one, until=other)
    length = da.join(other, "iri").agg(F.max("distance").alias("l"))
    db = bfs(edges, other, until=one)
    both = da.withColumnRenamed("distance", "x").join(db.withColumnRenamed("distance", "y"), "iri").crossJoin(F.broadcast(length))
    return both.where("x + y = l").select("iri", F.col("x").alias("step"))
