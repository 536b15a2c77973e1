"""The data model: nodes, their types, literal properties, and edges, as four DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

#: The bits of a column's value types.
STRING, SHORT_STRING, LANG_STRING, INTEGER, DOUBLE, XML, JSON, DATE_TIME, DATE, TIME, DURATION, BOOLEAN, UNKNOWN = (1 << i for i in range(13))
NUMERIC = INTEGER | DOUBLE
DEFAULT_LANG = "en"
LABEL = "rdfs:label"
RDF_TYPE, RDF_FIRST, RDF_REST, RDF_NIL = "rdf:type", "rdf:first", "rdf:rest", "rdf:nil"
#: Plain literals of fewer bytes are short strings: only these can be keys, or frequent values.
SHORT_BYTES = 32
#: Most nodes of a drawing.  Views hold any number.
MAX_VISIBLE = 40_000

TRIPLES = "subj string, subj_is_blank boolean, pred string, obj string, obj_kind string, datatype string, lang string, seq long"
NODES = "iri string, is_blank boolean, has_subject boolean, node_seq long"
NODE_TYPES = "iri string, type string, type_seq long"
PROPERTIES = "iri string, pred string, value string, kind string, lang string, datatype string, value_type int, seq long"
EDGES = "src string, pred string, dst string, seq long"


@dataclass(frozen=True)
class Graph:
    """An immutable data set.  types is a set; properties and edges are bags, whose seq keeps source order."""

    nodes: DataFrame
    types: DataFrame
    properties: DataFrame
    edges: DataFrame

    def union(self, other: Graph) -> Graph:
        """Load more data into the same store: bags add up, nodes and types stay sets. [U-06, U-07, T-03]"""
        from pyspark.sql import functions as F

        nodes = self.nodes.unionByName(other.nodes).groupBy("iri").agg(F.max("is_blank").alias("is_blank"), F.max("has_subject").alias("has_subject"), F.min("node_seq").alias("node_seq"))
        types = self.types.unionByName(other.types).groupBy("iri", "type").agg(F.min("type_seq").alias("type_seq"))
        return Graph(nodes, types, self.properties.unionByName(other.properties), self.edges.unionByName(other.edges))

    def with_(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)

    def cache(self) -> Graph:
        return Graph(*(t.cache() for t in (self.nodes, self.types, self.properties, self.edges)))

    def clear(self) -> None:
        """Let go of what is cached. [N-16]"""
        for t in (self.nodes, self.types, self.properties, self.edges):
            t.unpersist()


def empty_graph(spark: SparkSession) -> Graph:
    return Graph(*(spark.createDataFrame([], s) for s in (NODES, NODE_TYPES, PROPERTIES, EDGES)))
