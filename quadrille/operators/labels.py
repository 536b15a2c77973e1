"""Values by language, labels, and what is shown of a node. [P-01..P-20]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefixes import Prefixes
from ..functions.scalars import short_iri
from ..model import DEFAULT_LANG, LABEL, Graph


def _rank(lang: str) -> Column:
    return F.when(F.col("lang") == lang, 0).when(F.col("lang") == DEFAULT_LANG, 1).when(F.col("lang").isNull(), 2)


def get_property(properties: DataFrame, lang: str = DEFAULT_LANG) -> DataFrame:
    """(iri, pred, value): the first value in lang, else the last English one, else the last without a
    language; other languages are not seen. [P-01, W-04]"""
    rank = _rank(lang)
    value, seq = F.col("value"), F.col("seq")
    first = F.min_by(F.when(rank == 0, value), F.when(rank == 0, seq))
    english = F.max_by(F.when(rank == 1, value), F.when(rank == 1, seq))
    plain = F.max_by(F.when(rank == 2, value), F.when(rank == 2, seq))
    return properties.where(rank.isNotNull()).groupBy("iri", "pred").agg(F.coalesce(first, english, plain).alias("value"))


def get_property_count(properties: DataFrame, lang: str = DEFAULT_LANG) -> DataFrame:
    """(iri, pred, value, n): the first value of the best of these ranks, and how many values of any language. [P-02]"""
    rank = _rank(lang)
    return properties.groupBy("iri", "pred").agg(
        F.min_by(F.when(rank.isNotNull(), F.col("value")), F.when(rank.isNotNull(), F.struct(rank, "seq"))).alias("value"), F.count("*").alias("n")
    )


def cell_values(properties: DataFrame, iri: str, pred: str) -> DataFrame:
    """All values of one cell. [P-12]"""
    return properties.where((F.col("iri") == iri) & (F.col("pred") == pred)).select("value", "lang", "datatype", "seq")


def suppress_languages(properties: DataFrame, lang: str) -> DataFrame:
    """Values of other languages go; English ones stay only where lang has none; untagged ones stay. [P-15]"""
    has = F.max((F.col("lang") == lang).cast("int")).over(Window.partitionBy("iri", "pred"))
    return properties.withColumn("_has", F.coalesce(has, F.lit(0))).where(F.col("lang").isNull() | (F.col("lang") == lang) | ((F.col("lang") == DEFAULT_LANG) & (F.col("_has") == 0))).drop("_has")


def type_priority(graph: Graph) -> DataFrame:
    """(type, priority): the place in the order of instances, most first, so rare types win. [P-05, W-05]"""
    counts = graph.types.groupBy("type").count()
    # one row a type: a window without a partition is one of few rows
    return counts.select("type", (F.row_number().over(Window.orderBy(F.desc("count"), "type")) - 1).alias("priority"))


def label_predicates(graph: Graph) -> DataFrame:
    """(type, label_predicate): rdfs:label if the type has it, else a property that every instance has
    and whose name holds label, name or Name, the first by name; else rdfs:label. [P-04]"""
    from .profile import property_profile

    named = F.col("pred").rlike("label|name|Name") & (F.col("min_cardinality") >= 1)
    has = property_profile(graph).groupBy("type").agg(F.max((F.col("pred") == LABEL).cast("int")).alias("own"), F.min(F.when(named, F.col("pred"))).alias("other"))
    types = graph.types.select("type").distinct()
    return types.join(has, "type", "left").select("type", F.when(F.col("own") == 1, LABEL).otherwise(F.coalesce("other", F.lit(LABEL))).alias("label_predicate"))


def type_styles(graph: Graph) -> DataFrame:
    """(type, priority, label_predicate). [D16]"""
    return type_priority(graph).join(label_predicates(graph), "type")


def set_label_predicate(styles: DataFrame, types: list[str], pred: str) -> DataFrame:
    """Another label predicate for some types. [P-16]"""
    return styles.withColumn("label_predicate", F.when(F.col("type").isin(types), pred).otherwise(F.col("label_predicate")))


def highest_priority_types(graph: Graph, styles: DataFrame | None = None) -> DataFrame:
    """(iri, type): of each node the types of the highest priority; ties stay. [P-06]"""
    ranked = graph.types.join(styles if styles is not None else type_priority(graph).select("type", "priority"), "type")
    top = F.rank().over(Window.partitionBy("iri").orderBy(F.desc("priority")))
    return ranked.withColumn("_r", top).where("_r = 1").select("iri", "type")


def node_labels(graph: Graph, styles: DataFrame | None = None, lang: str = DEFAULT_LANG, shorten: bool = True) -> DataFrame:
    """(iri, label): by the label predicate of the first of the node's types that has a value, else the IRI,
    shortened or whole. [P-03]"""
    styles = styles if styles is not None else type_styles(graph)
    values = get_property(graph.properties, lang)
    found = (
        graph.types.join(styles.select("type", F.col("label_predicate").alias("pred")), "type")
        .join(values, ["iri", "pred"])
        .groupBy("iri")
        .agg(F.min_by("value", F.struct("type_seq", "type")).alias("value"))
    )
    fallback = short_iri(F.col("iri")) if shorten else F.col("iri")
    return graph.nodes.select("iri").join(found, "iri", "left").select("iri", F.coalesce("value", fallback).alias("label"))


def declared_labels(graph: Graph, lang: str = DEFAULT_LANG) -> DataFrame:
    """(iri, label): rdfs:label of nodes that are types or predicates. [P-07, J-10]"""
    return get_property(graph.properties.where(F.col("pred") == LABEL), lang).select("iri", F.col("value").alias("label"))


def display(names: DataFrame, column: str, mode: str, labels: DataFrame | None = None, prefixes: Prefixes | None = None) -> DataFrame:
    """names with a column display.  mode: full, prefixed, label, label_or_shorten or shorten. [P-08]"""
    name = F.col(column)
    prefixes = prefixes or Prefixes()
    if mode in ("label", "label_or_shorten") and labels is not None:
        names = names.join(labels.select(F.col("iri").alias(column), F.col("label").alias("_label")), column, "left")
    else:
        names = names.withColumn("_label", F.lit(None).cast("string"))
    shown = {
        "full": F.coalesce(prefixes.expand(name), name),
        "prefixed": name,
        "label": F.coalesce("_label", name),
        "label_or_shorten": F.coalesce(F.col("_label"), short_iri(name)),
        "shorten": short_iri(name),
    }[mode]
    return names.withColumn("display", F.coalesce(shown, F.lit("!Unknown"))).drop("_label")


def languages(graph: Graph) -> DataFrame:
    """The languages of all literals, in order. [N-14, P-17]"""
    return graph.properties.where("lang is not null").select("lang").distinct().orderBy("lang")


def node_sheet(graph: Graph, iri: str) -> DataFrame:
    """(part, pred, value, other_types): types, properties, references and back references of one node. [P-13, P-20]"""
    names = graph.types.groupBy("iri").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type_seq", "type"))), lambda t: t["type"]), ", ").alias("other_types"))
    own = graph.types.where(F.col("iri") == iri).select(F.lit("type").alias("part"), F.lit(None).cast("string").alias("pred"), F.col("type").alias("value"))
    values = graph.properties.where(F.col("iri") == iri).select(F.lit("property").alias("part"), "pred", "value")
    out = graph.edges.where(F.col("src") == iri).select(F.lit("reference").alias("part"), "pred", F.col("dst").alias("value"))
    back = graph.edges.where(F.col("dst") == iri).select(F.lit("referenced by").alias("part"), "pred", F.col("src").alias("value"))
    links = out.unionByName(back).join(names.withColumnRenamed("iri", "value"), "value", "left").select("part", "pred", "value", "other_types")
    return own.unionByName(values).withColumn("other_types", F.lit(None).cast("string")).unionByName(links)


def type_labels_of(graph: Graph, display_names: DataFrame) -> DataFrame:
    """(iri, labels): the labels of a node's types, joined. [P-20]"""
    shown = graph.types.join(display_names, "type")
    return shown.groupBy("iri").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type_seq", "display"))), lambda t: t["display"]), ", ").alias("labels"))
