"""Triples to the four tables. [N-01..N-16]"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import value_type
from ..model import RDF_FIRST, RDF_NIL, RDF_REST, RDF_TYPE, Graph
from ..plans.staging import cut

_TYPES = [RDF_TYPE, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"]


def build_graph(triples: DataFrame, languages: list[str] | None = None) -> Graph:
    """triples (TRIPLES) routed by predicate and kind of object. [N-01..N-05, N-10, N-11]

    Types must be IRIs and are a set; references and literals are bags.  With languages, literals tagged with
    another one are dropped; untagged ones stay."""
    is_type = F.col("pred").isin(_TYPES)
    typed = triples.where(is_type & (F.col("obj_kind") == "iri"))
    links = triples.where(~is_type & F.col("obj_kind").isin("iri", "blank"))
    literals = triples.where(~is_type & (F.col("obj_kind") == "literal"))
    if languages:
        literals = literals.where(F.col("lang").isNull() | F.col("lang").isin(languages))
    types = typed.groupBy(F.col("subj").alias("iri"), F.col("obj").alias("type")).agg(F.min("seq").alias("type_seq"))
    edges = links.select(F.col("subj").alias("src"), "pred", F.col("obj").alias("dst"), "seq")
    kind = F.when(F.col("lang").isNotNull(), "lang").when(F.col("datatype").isNotNull(), "typed").otherwise("plain")
    properties = literals.select(
        F.col("subj").alias("iri"), "pred", F.col("obj").alias("value"), kind.alias("kind"), "lang", "datatype", value_type(F.col("obj"), F.col("lang"), F.col("datatype")).alias("value_type"), "seq"
    )
    accepted = typed.select("subj", "subj_is_blank", "seq").unionByName(links.select("subj", "subj_is_blank", "seq")).unionByName(literals.select("subj", "subj_is_blank", "seq"))
    subjects = accepted.select(F.col("subj").alias("iri"), F.col("subj_is_blank").alias("is_blank"), F.lit(True).alias("has_subject"), "seq")
    objects = links.select(F.col("obj").alias("iri"), (F.col("obj_kind") == "blank").alias("is_blank"), F.lit(False).alias("has_subject"), "seq")
    nodes = subjects.unionByName(objects).groupBy("iri").agg(F.max("is_blank").alias("is_blank"), F.max("has_subject").alias("has_subject"), F.min("seq").alias("node_seq"))
    return Graph(nodes, types, properties, edges)


def triple_count(triples: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """(triples): those that are taken, before types are made a set. [N-06]"""
    bad = F.col("pred").isin(_TYPES) & (F.col("obj_kind") != "iri")
    wrong = (F.col("obj_kind") == "literal") & F.col("lang").isNotNull() & (~F.col("lang").isin(languages) if languages else F.lit(False))
    return triples.where(~bad & ~wrong).agg(F.count("*").alias("triples"))


def language_filter(properties: DataFrame, languages: list[str]) -> DataFrame:
    return properties.where(F.col("lang").isNull() | F.col("lang").isin(languages))  # [N-05]


def resolve_lists(graph: Graph) -> Graph:
    """Elements of RDF lists become values and references of whatever holds the list, in list order; the link to the
    list's head goes, the list's nodes stay. [N-12]

    Positions come by doubling along rdf:rest, so rounds grow with the logarithm of the longest list."""
    rest = graph.edges.where(F.col("pred") == RDF_REST)
    cells = graph.edges.where(F.col("pred").isin(RDF_FIRST, RDF_REST)).select(F.col("src").alias("cell")).unionByName(graph.properties.where(F.col("pred") == RDF_FIRST).select(F.col("iri").alias("cell"))).distinct()
    heads = graph.edges.where(~F.col("pred").isin(RDF_FIRST, RDF_REST)).join(cells.withColumnRenamed("cell", "dst"), "dst", "left_semi")
    # (a, b, n): b lies n steps after a
    jump = cut(rest.where(F.col("dst") != RDF_NIL).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).cast("long").alias("n")).distinct())
    place = cut(heads.select(F.col("dst").alias("head")).distinct().select("head", F.col("head").alias("cell"), F.lit(0).cast("long").alias("pos")))
    while not jump.isEmpty():
        more = place.join(jump, F.col("cell") == F.col("a")).select("head", F.col("b").alias("cell"), (F.col("pos") + F.col("n")).alias("pos"))
        place = cut(place.unionByName(more).groupBy("head", "cell").agg(F.min("pos").alias("pos")))
        far = jump.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("m"))
        jump = cut(jump.join(far, "b").where("a <> c").select("a", F.col("c").alias("b"), (F.col("n") + F.col("m")).alias("n")))
    holders = heads.select("src", F.col("pred").alias("p"), F.col("dst").alias("head"), F.col("seq").alias("base"))
    at = holders.join(place, "head")
    first_e = graph.edges.where(F.col("pred") == RDF_FIRST).select(F.col("src").alias("cell"), F.col("dst").alias("value"))
    first_p = graph.properties.where(F.col("pred") == RDF_FIRST).select(F.col("iri").alias("cell"), "value", "kind", "lang", "datatype", "value_type")
    edges = at.join(first_e, "cell").select("src", F.col("p").alias("pred"), F.col("value").alias("dst"), (F.col("base") + F.col("pos")).alias("seq"))
    props = at.join(first_p, "cell").select(F.col("src").alias("iri"), F.col("p").alias("pred"), "value", "kind", "lang", "datatype", "value_type", (F.col("base") + F.col("pos")).alias("seq"))
    kept = graph.edges.join(heads.select("src", "pred", "dst").distinct(), ["src", "pred", "dst"], "left_anti").select("src", "pred", "dst", "seq")
    return graph.with_(edges=kept.unionByName(edges), properties=graph.properties.unionByName(props))


def ordered_references(graph: Graph) -> DataFrame:
    """Edges with their place at the source, by predicate and then as read. [N-13]"""
    return graph.edges.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("pred", "seq", "dst")))
