"""Predicates on nodes and their values. [F-01..F-21]"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ascii_lower
from ..model import NUMERIC, Graph


class FilterKind(Enum):
    """[F-10]"""

    EQUALS = "="
    EQUALS_NO_CASE = "= no case"
    CONTAINS = "contains"
    STARTS_WITH = "starts with"
    ENDS_WITH = "ends with"
    GREATER = ">"
    LESS = "<"
    EXISTS = "exists"
    NOT_EXISTS = "not exists"


@dataclass(frozen=True)
class PredicateFilter:
    pred: str
    kind: FilterKind = FilterKind.EQUALS
    value: str = ""


def _passes(f: PredicateFilter) -> Column:
    value, lit = F.col("value"), F.lit(f.value)
    number, bound = value.try_cast("double"), lit.try_cast("double")
    numeric = F.col("value_type").bitwiseAND(NUMERIC) != 0
    return {
        FilterKind.EQUALS: lambda: value == lit,
        FilterKind.EQUALS_NO_CASE: lambda: ascii_lower(value) == ascii_lower(lit),
        FilterKind.CONTAINS: lambda: F.contains(value, lit),
        FilterKind.STARTS_WITH: lambda: F.startswith(value, lit),
        FilterKind.ENDS_WITH: lambda: F.endswith(value, lit),
        # numbers strictly, other literals by bytes and with equality
        FilterKind.GREATER: lambda: F.when(numeric, F.coalesce(number > bound, F.lit(False))).otherwise(value >= lit),
        FilterKind.LESS: lambda: F.when(numeric, F.coalesce(number < bound, F.lit(False))).otherwise(value <= lit),
        FilterKind.EXISTS: lambda: F.lit(True),
        FilterKind.NOT_EXISTS: lambda: F.lit(True),
    }[f.kind]()


def apply_filters(instances: DataFrame, properties: DataFrame, filters: list[PredicateFilter], column: str = "iri") -> DataFrame:
    """instances that pass all filters: each needs a value of its predicate, and all of them must pass; NOT_EXISTS
    needs that there is none. [F-01..F-09, F-21]

    All positive filters share one scan and one aggregation of the properties that they name."""
    keep = [f for f in filters if f.kind is not FilterKind.NOT_EXISTS]
    if keep:
        named = properties.where(F.col("pred").isin(sorted({f.pred for f in keep})))
        tests = [F.coalesce(F.bool_and(F.when(F.col("pred") == f.pred, F.coalesce(_passes(f), F.lit(False)))), F.lit(False)).alias(f"_f{i}") for i, f in enumerate(keep)]
        good = named.groupBy("iri").agg(*tests)
        for i in range(len(keep)):
            good = good.where(f"_f{i}")
        instances = instances.join(good.select(F.col("iri").alias(column)), column, "left_semi")
    for f in filters:
        if f.kind is FilterKind.NOT_EXISTS:
            instances = instances.join(properties.where(F.col("pred") == f.pred).select(F.col("iri").alias(column)), column, "left_anti")
    return instances


def text_filter(instances: DataFrame, properties: DataFrame, needle: str) -> DataFrame:
    """Nodes whose IRI or any literal holds the needle. [F-11]"""
    hit = properties.where(F.contains("value", F.lit(needle))).select("iri").distinct().withColumn("_hit", F.lit(True))
    return instances.join(hit, "iri", "left").where(F.contains("iri", F.lit(needle)) | F.col("_hit")).drop("_hit")


def types_filter(shown: DataFrame, needle: str) -> DataFrame:
    """Types whose display holds the needle, in any case. [F-12]"""
    return shown.where(F.contains(F.lower("display"), F.lower(F.lit(needle))))


def value_exists(instances: DataFrame, properties: DataFrame, pred: str) -> DataFrame:
    return instances.join(properties.where(F.col("pred") == pred), "iri", "left_semi")  # [F-13]


def value_missing(instances: DataFrame, properties: DataFrame, pred: str) -> DataFrame:
    return instances.join(properties.where(F.col("pred") == pred), "iri", "left_anti")  # [F-14]


def multi_value(instances: DataFrame, properties: DataFrame, pred: str) -> DataFrame:
    """Nodes with two values of pred or more. [F-15]"""
    many = properties.where(F.col("pred") == pred).groupBy("iri").count().where("count > 1")
    return instances.join(many, "iri", "left_semi")


def reference_filter(graph: Graph, iri: str, pred: str, type_: str) -> DataFrame:
    """What a node refers to by pred, repeats kept, of one type. [F-16]"""
    out = graph.edges.where((F.col("src") == iri) & (F.col("pred") == pred)).select(F.col("dst").alias("iri"), "seq")
    return out.join(graph.types.where(F.col("type") == type_), "iri", "left_semi")


def of_types(instances: DataFrame, types: DataFrame, names: list[str]) -> DataFrame:
    return instances.join(types.where(F.col("type").isin(names)), "iri", "left_semi")  # [F-17]


def shown_edges(edges: DataFrame, hidden: list[str]) -> DataFrame:
    """Edges of predicates that are not hidden. [F-18]"""
    return edges.where(~F.col("pred").isin(hidden)) if hidden else edges


def zoom_visible(layer: Column, low: int, high: int) -> Column:
    """Whether a layer lies in an interval, of which 0 is an open end; layer 0 is always seen. [F-19, D15]"""
    return (layer == 0) | (((F.lit(low) == 0) | (layer >= low)) & ((F.lit(high) == 0) | (layer <= high)))


def in_rectangle(positions: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return positions.where(F.col("x").between(min(x0, x1), max(x0, x1)) & F.col("y").between(min(y0, y1), max(y0, y1)))  # [F-20]
