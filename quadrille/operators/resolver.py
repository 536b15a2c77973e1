"""Reference resolver: keys found in values, and links made from them. [J-08, J-09, U-04]"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import SHORT_STRING, Graph
from .profile import property_profile


def resolve_references(graph: Graph, from_type: str, from_pred: str, to_type: str, to_pred: str, link: str) -> DataFrame:
    """New edges (src, pred, dst, seq) where a short string of from_pred equals the first one of to_pred.  Of
    targets with one value the last counts, here by IRI. [J-08]"""
    def short(type_: str, pred: str) -> DataFrame:
        return graph.properties.where((F.col("pred") == pred) & (F.col("value_type") == SHORT_STRING)).join(graph.types.where(F.col("type") == type_), "iri", "left_semi")

    first = short(to_type, to_pred).groupBy("iri").agg(F.min_by("value", "seq").alias("value"))
    keys = first.groupBy("value").agg(F.max("iri").alias("dst"))
    return short(from_type, from_pred).join(keys, "value").select(F.col("iri").alias("src"), F.lit(link).alias("pred"), "dst", "seq")


def discover_references(graph: Graph) -> DataFrame:
    """(from_type, from_pred, to_type, to_pred): foreign keys that the values suggest. [J-09]

    Only properties that hold short strings alone take part.  A key has one value for each instance, all different;
    a reference is another property all of whose values are among the key's.  Of several keys
    the one with fewest further values is taken.  Distinct values are joined once; the rest is counting."""
    usable = property_profile(graph).where(F.col("value_types") == SHORT_STRING)
    values = (
        graph.properties.join(graph.types.select("iri", "type"), "iri")
        .join(usable.select("type", "pred", "count", "min_cardinality", "max_cardinality"), ["type", "pred"])
        .select("type", "pred", "value", "count", "min_cardinality", "max_cardinality")
    )
    distinct = values.groupBy("type", "pred", "value").agg(F.first("count").alias("count"), F.first("min_cardinality").alias("lo"), F.first("max_cardinality").alias("hi"))
    size = distinct.groupBy("type", "pred").agg(F.count("*").alias("n"), F.first("count").alias("count"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    size = size.withColumn("is_key", (F.col("lo") == 1) & (F.col("hi") == 1) & (F.col("n") == F.col("count")))
    keys, others = size.where("is_key"), size.where(~F.col("is_key"))
    key_values = distinct.join(keys.select("type", "pred"), ["type", "pred"]).select(F.col("type").alias("to_type"), F.col("pred").alias("to_pred"), "value")
    met = (
        distinct.join(others.select("type", "pred"), ["type", "pred"])
        .join(key_values, "value")
        .groupBy("type", "pred", "to_type", "to_pred")
        .agg(F.count("*").alias("met"))
    )
    whole = met.join(others.select("type", "pred", F.col("n").alias("fk_n")), ["type", "pred"]).where("met = fk_n")
    whole = whole.join(keys.select(F.col("type").alias("to_type"), F.col("pred").alias("to_pred"), F.col("n").alias("pk_n")), ["to_type", "to_pred"])
    best = F.row_number().over(Window.partitionBy("type", "pred").orderBy(F.col("pk_n") - F.col("fk_n"), "to_type", "to_pred"))
    return whole.withColumn("_b", best).where("_b = 1").select(F.col("type").alias("from_type"), F.col("pred").alias("from_pred"), "to_type", "to_pred")


def add_missing_types(graph: Graph, pred: str, type_: str) -> DataFrame:
    """types, with type_ for objects of pred that lack it. [J-13]"""
    objects = graph.edges.where(F.col("pred") == pred).select(F.col("dst").alias("iri")).distinct()
    lack = objects.join(graph.types.where(F.col("type") == type_), "iri", "left_anti")
    after = graph.types.groupBy("iri").agg((F.max("type_seq") + 1).alias("type_seq"))
    more = lack.join(after, "iri", "left").select("iri", F.lit(type_).alias("type"), F.coalesce("type_seq", F.lit(0).cast("long")).alias("type_seq"))
    return graph.types.unionByName(more)
