"""Connected components of links in a DataFrame, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v), u > v.  large: each vertex ties its larger neighbours to the smallest vertex that
    it knows; else itself and its smaller neighbours."""
    near = links if not large else links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    told = near.join(low, "u")
    if large:
        return told.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return told.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links: columns a, b (long), either order, repeats allowed.  Returns (node, component_id): every
    vertex that has a link to another, and the smallest vertex that can be reached from it.

    Each round is two aggregations and two equi-joins; the links of a round are a staged table, so
    only two sums reach the driver.  The rounds grow with the logarithm of the longest path."""
    spark = links.sparkSession
    now, path = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _state(now)
    while state[0]:
        then, then_path = stage(_star(_star(now, True), False), "links")
        discard(spark, path)
        now, path, before, state = then, then_path, state, _state(then)
        if state == before:
            break
    tied = now.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
    return tied.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())
