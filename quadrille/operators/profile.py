"""What the data says of its own schema. [A-01..A-20]"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NUMERIC, SHORT_STRING, Graph


def totals(graph: Graph) -> DataFrame:
    """One row of counts over the whole data set. [A-01..A-07]"""
    nodes = graph.nodes.agg(
        F.count_if("has_subject").alias("nodes"), F.count_if(~F.col("has_subject")).alias("unresolved"), F.count_if("is_blank").alias("blank_nodes")
    )
    props = graph.properties.agg(F.count("*").alias("properties"), F.countDistinct("lang").alias("languages"), F.countDistinct("datatype").alias("datatypes"))
    refs = graph.edges.agg(F.count("*").alias("references"))
    preds = predicates(graph).agg(F.count("*").alias("unique_predicates"))
    types = instances_per_type(graph).agg(F.count("*").alias("unique_types"), F.min("instances").alias("min_instances"), F.max("instances").alias("max_instances"))
    out = nodes
    for one in (props, refs, preds, types):  # each is one row
        out = out.crossJoin(one)
    return out


def predicates(graph: Graph) -> DataFrame:
    """All predicates that occur. [A-05]"""
    return graph.properties.select("pred").distinct().unionByName(graph.edges.select("pred").distinct()).distinct()


def instances_per_type(graph: Graph) -> DataFrame:
    """[A-06]"""
    return graph.types.groupBy("type").agg(F.count("*").alias("instances"))


def _by_type(per: DataFrame, graph: Graph, merge: list) -> DataFrame:
    """per: (type, pred, n), a row for each instance that has values.  The least and most values that one instance has, zeros included."""
    seen = per.groupBy("type", "pred").agg(F.sum("n").alias("count"), F.min("n").alias("_least"), F.max("n").alias("max_cardinality"), F.count("*").alias("_carriers"), *merge)
    return seen.join(instances_per_type(graph), "type").withColumn("min_cardinality", F.when(F.col("_carriers") < F.col("instances"), F.lit(0)).otherwise(F.col("_least"))).drop("_least", "_carriers", "instances")


def property_profile(graph: Graph) -> DataFrame:
    """(type, pred, count, max_cardinality, value_types, max_len, min_cardinality). [A-08..A-12]"""
    per = graph.properties.groupBy("iri", "pred").agg(F.count("*").alias("n"), F.bit_or("value_type").alias("value_type"), F.max(F.octet_length("value")).alias("max_len"))
    return _by_type(per.join(graph.types.select("iri", "type"), "iri"), graph, [F.bit_or("value_type").alias("value_types"), F.max("max_len").alias("max_len")])


def reference_profile(graph: Graph, incoming: bool = False) -> DataFrame:
    """(type, pred, count, max_cardinality, min_cardinality, target_types), of outgoing or incoming references. [A-13..A-16]

    Edges are dealt once, by the near end: the counts go on from there, and both uses read the same columns, so they share
    the shuffle.  What is joined to the types of the far ends is one row for each (type, pred, far end)."""
    near, far = ("dst", "src") if incoming else ("src", "dst")
    typed = graph.edges.select("src", "pred", "dst").join(graph.types.select(F.col("iri").alias(near), "type"), near)
    counts = _by_type(typed.groupBy(near, "type", "pred").agg(F.count(far).alias("n")), graph, [])
    other = graph.types.select(F.col("iri").alias(far), F.col("type").alias("target"))
    # distinct (type, pred, target) first: few rows reach the lists
    targets = typed.select("type", "pred", far).distinct().join(other, far).select("type", "pred", "target").distinct().groupBy("type", "pred").agg(F.sort_array(F.collect_set("target")).alias("target_types"))
    return counts.join(targets, ["type", "pred"], "left")


def data_properties_per_type(graph: Graph) -> DataFrame:
    """[A-12]"""
    return graph.properties.select("iri", "pred").distinct().join(graph.types, "iri").groupBy("type").agg(F.countDistinct("pred").alias("data_properties"))


def meta_graph(graph: Graph) -> DataFrame:
    """(type, pred, target, n): the class diagram of the data. [A-20]"""
    own, other = graph.types.select(F.col("iri").alias("src"), "type"), graph.types.select(F.col("iri").alias("dst"), F.col("type").alias("target"))
    return graph.edges.join(own, "src").join(other, "dst").groupBy("type", "pred", "target").agg(F.count("*").alias("n"))


def meta_hide_rare(graph: Graph, meta: DataFrame, than: str) -> DataFrame:
    """Meta edges between types with strictly more instances than `than`. [G-34]"""
    counts = instances_per_type(graph)
    bar = counts.where(F.col("type") == than).select(F.col("instances").alias("bar"))
    keep = counts.crossJoin(F.broadcast(bar)).where("instances > bar").select("type")
    return meta.join(keep, "type", "left_semi").join(keep.withColumnRenamed("type", "target"), "target", "left_semi").select(meta.columns)


def meta_hide(meta: DataFrame, types: list[str], others: bool = False) -> DataFrame:
    """Meta edges without some types, or only among these. [G-33]"""
    inside = F.col("type").isin(types) & F.col("target").isin(types)
    touches = F.col("type").isin(types) | F.col("target").isin(types)
    return meta.where(inside if others else ~touches)


def meta_expand(meta: DataFrame, type_: str) -> DataFrame:
    """Types that a type refers to, or that refer to it. [G-35]"""
    return meta.where(F.col("type") == type_).select(F.col("target").alias("type")).unionByName(meta.where(F.col("target") == type_).select("type")).distinct()


def type_grid(graph: Graph, type_: str) -> DataFrame:
    """The detail grid of one type: properties, then references out and in. [P-18]"""
    empty = F.lit(None)
    cols = ["part", "pred", "count", "max_len", "min_cardinality", "max_cardinality", "targets"]
    props = property_profile(graph).where(F.col("type") == type_).select(F.lit("property").alias("part"), "pred", "count", "max_len", "min_cardinality", "max_cardinality", empty.cast("string").alias("targets"))
    first = F.concat(F.col("target_types")[0], F.when(F.size("target_types") > 1, F.concat(F.lit(" +"), (F.size("target_types") - 1).cast("string"))).otherwise(""))
    refs = [
        reference_profile(graph, incoming).where(F.col("type") == type_).select(F.lit(part).alias("part"), "pred", "count", empty.cast("int").alias("max_len"), "min_cardinality", "max_cardinality", first.alias("targets"))
        for part, incoming in (("out", False), ("in", True))
    ]
    return props.unionByName(refs[0]).unionByName(refs[1]).select(cols)


def value_statistics(graph: Graph, instances: DataFrame, pred: str, top: int = 10) -> DataFrame:
    """One row: count, missing, the most frequent short strings, and numbers of numeric columns. [A-17..A-19]

    instances: (iri) of a type table or a query column, repeats counted each.  A numeric literal that is no number counts as 0."""
    values = instances.select("iri").join(graph.properties.where(F.col("pred") == pred).select("iri", "value", "value_type"), "iri", "left")
    number = F.when(F.col("value_type").bitwiseAND(NUMERIC) != 0, F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)))
    base = values.agg(
        F.count("value").alias("count"), F.count_if(F.col("value").isNull()).alias("missing"),
        F.min(number).alias("min"), F.max(number).alias("max"), F.count(number).alias("numbers"), F.avg(number).alias("avg"), F.sum(number).alias("sum"),
    )
    return base.crossJoin(top_values(values, top).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "value", "n"))).alias("top")))


def top_values(values: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent short strings. [A-18, O-11]"""
    return values.where(F.col("value_type") == SHORT_STRING).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)
