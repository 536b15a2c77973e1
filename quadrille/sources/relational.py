"""Relational tables as linked data: a row is a node, a foreign key an edge, any other column a literal. [S-16]"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import value_type
from ..model import PROPERTIES, Graph


@dataclass(frozen=True)
class TableMap:
    """How one table is lifted.  references: column -> (predicate, table whose key it holds)."""

    table: str
    type: str
    key: tuple[str, ...]
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    properties: tuple[str, ...] = ()
    lang: dict[str, str] = field(default_factory=dict)  # property -> column with its language
    prefix: str = "tpch"

    def iri(self, *columns: str) -> Column:
        parts = [F.date_format(c, "yyyyMMdd") if c.endswith("date") else F.col(c).cast("string") for c in columns or self.key]
        return F.concat(F.lit(f"{self.prefix}:{self.table}/"), F.concat_ws("-", *parts) if len(parts) > 1 else parts[0])


#: The tables of the test data.
TABLES = {
    m.table: m
    for m in (
        TableMap("region", "tpch:Region", ("r_regionkey",), {}, ("r_name",)),
        TableMap("nation", "tpch:Nation", ("n_nationkey",), {"n_regionkey": ("tpch:region", "region")}, ("n_name",)),
        TableMap("customer", "tpch:Customer", ("c_custkey",), {"c_nationkey": ("tpch:nation", "nation")}, ("c_name", "c_acctbal", "c_mktsegment")),
        TableMap("supplier", "tpch:Supplier", ("s_suppkey",), {"s_nationkey": ("tpch:nation", "nation")}, ("s_name", "s_acctbal")),
        TableMap("part", "tpch:Part", ("p_partkey",), {}, ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
        TableMap("orders", "tpch:Order", ("o_orderkey",), {"o_custkey": ("tpch:customer", "customer")}, ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
        TableMap(
            "lineitem", "tpch:Lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"),
            {"l_orderkey": ("tpch:order", "orders"), "l_partkey": ("tpch:part", "part"), "l_suppkey": ("tpch:supplier", "supplier")},
            ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
        ),
        TableMap("documents", "tpch:Document", ("doc_id",), {}, ("text", "source", "n_chars"), {"text": "lang"}),
        TableMap("labels", "tpch:Label", ("doc_id",), {"doc_id": ("tpch:document", "documents")}, ("quality", "toxic")),
        TableMap("events", "tpch:Event", ("event_id",), {"user_id": ("tpch:user", "user")}, ("event_type", "value", "ts", "props")),
    )
}


def lexical(column: str, kind: T.DataType) -> tuple[Column, Column]:
    """(text, datatype) of a typed column.  Numbers with a fraction have two digits of it, or all if they need
    more; a time of midnight is a day."""
    c, datatype = F.col(column), F.lit(None).cast("string")
    text = c.cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        cents = (F.round(c, 2) == c) & (F.abs(c) < 1e15)
        return F.when(cents, c.try_cast("decimal(18,2)").cast("string")).otherwise(text), F.when(cents, "xsd:decimal").otherwise("xsd:double")
    if isinstance(kind, T.DecimalType):
        datatype = F.lit("xsd:decimal")
    elif isinstance(kind, T.IntegralType):
        datatype = F.lit("xsd:integer")
    elif isinstance(kind, T.BooleanType):
        datatype = F.lit("xsd:boolean")
    elif isinstance(kind, T.DateType):
        text, datatype = F.date_format(c, "yyyy-MM-dd"), F.lit("xsd:date")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        day = c == F.date_trunc("day", c).cast(kind)
        whole = F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", "")
        whole = F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(whole)
        text, datatype = F.when(day, F.date_format(c, "yyyy-MM-dd")).otherwise(whole), F.when(day, "xsd:date").otherwise("xsd:dateTime")
    return text, datatype


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lift_table(df: DataFrame, how: TableMap, with_nodes: bool = True) -> Graph:
    """A scan for each property and each reference, with its column and the key alone.

    The predicate of a scan is a literal, so a query for some predicates keeps their scans and no other, and a
    filter goes down to the column."""
    kinds = {f.name: f.dataType for f in df.schema}
    iri = how.iri()
    nodes = df.select(iri.alias("iri"), F.lit(False).alias("is_blank"), F.lit(True).alias("has_subject"), F.lit(0).cast("long").alias("node_seq"))
    types = df.select(iri.alias("iri"), F.lit(how.type).alias("type"), F.lit(0).cast("long").alias("type_seq"))
    cells, links = [], []
    for i, name in enumerate(how.properties):
        text, typed = lexical(name, kinds[name])
        lang = F.col(how.lang[name]) if name in how.lang else F.lit(None).cast("string")
        cells.append(
            df.where(F.col(name).isNotNull()).select(
                iri.alias("iri"), F.lit(f"{how.prefix}:{name}").alias("pred"), text.alias("value"), F.when(lang.isNotNull(), "lang").when(typed.isNotNull(), "typed").otherwise("plain").alias("kind"),
                lang.alias("lang"), typed.alias("datatype"), value_type(text, lang, typed).alias("value_type"), F.lit(i).cast("long").alias("seq"),
            )
        )
    for i, (c, (pred, target)) in enumerate(how.references.items()):
        links.append(df.where(F.col(c).isNotNull()).select(iri.alias("src"), F.lit(pred).alias("pred"), F.concat(F.lit(f"{how.prefix}:{target}/"), F.col(c).cast("string")).alias("dst"), F.lit(i).cast("long").alias("seq")))
    spark = df.sparkSession
    return Graph(nodes, types, _union(cells, spark, PROPERTIES), _union(links, spark, "src string, pred string, dst string, seq long"))


def lift(spark: SparkSession, sf_dir: str, *tables: str, maps: dict[str, TableMap] = TABLES) -> Graph:
    """Several Parquet tables as one graph.  Keys of different tables differ, so plain unions suffice."""
    graphs = [lift_table(spark.read.parquet(f"{sf_dir}/{t}.parquet"), maps[t]) for t in tables]
    out = graphs[0]
    for g in graphs[1:]:
        out = Graph(*(getattr(out, n).unionByName(getattr(g, n)) for n in ("nodes", "types", "properties", "edges")))
    return out
