"""More queries over the test tables: files of every format written and read again, sheets, selections, layouts, scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import _ENDS, C, D2, N, R, _by_source, _query, _view, _V
from .functions import scalars
from .functions.prefixes import DEFAULTS, Prefixes
from .model import LABEL, RDF_TYPE, Graph
from .operators import filters, ingest, labels, layout, profile, resolver, scores, table, traverse, view
from .operators.table import TypeTable
from .plans import visual_query as vq
from .plans.staging import shared_path
from .plans.visual_query import TableQuery
from .sources import loader, sinks
from .sources.parsers import XSD
from .sources.relational import lift
from .streaming.ingest import follow_ntriples

# --- files -----------------------------------------------------------------------------------------

#: Rows of a file of those formats that have one element around all.
_ROWS_A_FILE = 1000
_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"

#: What every format says of the customers: a type, a name in a language, a number, a reference.
_FACTS = (
    "SELECT 'http://x.org/c/' || c_custkey AS s, 'a' AS p, 'http://x.org/C' AS o, CAST(NULL AS VARCHAR) AS lang, CAST(NULL AS VARCHAR) AS datatype FROM customer UNION ALL "
    "SELECT 'http://x.org/c/' || c_custkey, 'http://x.org/name', c_name, 'en', NULL FROM customer UNION ALL "
    f"SELECT 'http://x.org/c/' || c_custkey, 'http://x.org/bal', {D2('c_acctbal')}, NULL, 'xsd:decimal' FROM customer UNION ALL "
    "SELECT 'http://x.org/c/' || c_custkey, 'http://x.org/nation', 'http://x.org/n/' || c_nationkey, NULL, NULL FROM customer"
)


def _customers(spark, sf) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select("c_custkey", F.col("c_custkey").cast("string").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("bal"), F.col("c_nationkey").cast("string").alias("n"), "c_mktsegment")


def _text(pattern: str) -> Column:
    """A line in which {k}, {name}, {bal} and {n} stand for columns."""
    import re

    parts = [F.col(x[1:-1]) if x[:1] == "{" and x[1:-1] in ("k", "name", "bal", "n", "c_mktsegment") else F.lit(x) for x in re.split(r"(\{\w+\})", pattern) if x]
    return F.concat(*parts)


def _lines(spark, df: DataFrame, pattern: str) -> str:
    """Lines of the rows, in a folder of files."""
    path = shared_path(spark, "lines")
    df.select(_text(pattern)).write.text(path)
    return path


def _wrapped(spark, df: DataFrame, head: str, pattern: str, between: str, foot: str) -> str:
    """Files of _ROWS_A_FILE rows each, with one element around them."""
    path = shared_path(spark, "files")
    part = F.floor(F.col("c_custkey") / _ROWS_A_FILE)
    files = df.withColumn("part", part).groupBy("part").agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", _text(pattern).alias("t")))), lambda x: x["t"]), between), F.lit(foot)).alias("t"))
    files.write.partitionBy("part").text(path)
    return path + "/*/*.txt"


def _facts(g: Graph) -> DataFrame:
    null = F.lit(None).cast("string")
    types = g.types.select(F.col("iri").alias("s"), F.lit("a").alias("p"), F.col("type").alias("o"), null.alias("lang"), null.alias("datatype"))
    values = g.properties.select(F.col("iri").alias("s"), F.col("pred").alias("p"), F.col("value").alias("o"), "lang", "datatype")
    edges = g.edges.select(F.col("src").alias("s"), F.col("pred").alias("p"), F.col("dst").alias("o"), null.alias("lang"), null.alias("datatype"))
    return types.unionByName(values).unionByName(edges)


def _read(spark, path: str, kind: str) -> DataFrame:
    return _facts(ingest.build_graph(loader.read_triples(spark, path, kind)))


_STATEMENT = '<http://x.org/c/{k}> a <http://x.org/C> ; <http://x.org/name> "{name}"@en ; <http://x.org/bal> {bal} ; <http://x.org/nation> <http://x.org/n/{n}> .'
_TRIPLES = (
    f"<http://x.org/c/{{k}}> <{_TYPE}> <http://x.org/C> GRAPH.\n"
    '<http://x.org/c/{k}> <http://x.org/name> "{name}"@en GRAPH.\n'
    f'<http://x.org/c/{{k}}> <http://x.org/bal> "{{bal}}"^^<{XSD}decimal> GRAPH.\n'
    "<http://x.org/c/{k}> <http://x.org/nation> <http://x.org/n/{n}> GRAPH."
)


@_query(_FACTS)
def load_turtle(spark, sf):
    """Every statement is followed by one with a mistake, which alone is left out. [S-01, S-17]"""
    return _read(spark, _lines(spark, _customers(spark, sf), _STATEMENT + "\n<http://x.org/c/{k}> no:prefix 1 ."), "ttl")


@_query(_FACTS)
def load_rdf_xml(spark, sf):
    """[S-02]"""
    head = f'<rdf:RDF xmlns:rdf="{_TYPE[:-4]}" xmlns:x="http://x.org/">'
    row = f'<x:C rdf:about="http://x.org/c/{{k}}"><x:name xml:lang="en">{{name}}</x:name><x:bal rdf:datatype="{XSD}decimal">{{bal}}</x:bal><x:nation rdf:resource="http://x.org/n/{{n}}"/></x:C>'
    return _read(spark, _wrapped(spark, _customers(spark, sf), head, row, "", "</rdf:RDF>"), "rdf")


@_query(_FACTS)
def load_ntriples(spark, sf):
    """[S-03]"""
    return _read(spark, _lines(spark, _customers(spark, sf), _TRIPLES.replace("GRAPH", "")), "nt")


@_query(_FACTS)
def load_trig(spark, sf):
    """[S-04]"""
    return _read(spark, _lines(spark, _customers(spark, sf), "<http://x.org/g{n}> { " + _STATEMENT + " }"), "trig")


@_query(_FACTS)
def load_nquads(spark, sf):
    """[S-05]"""
    return _read(spark, _lines(spark, _customers(spark, sf), _TRIPLES.replace("GRAPH", "<http://x.org/g> ")), "nq")


@_query(_FACTS)
def load_json_ld(spark, sf):
    """[S-06]"""
    row = f'{{"@id": "http://x.org/c/{{k}}", "@type": ["http://x.org/C"], "http://x.org/name": [{{"@value": "{{name}}", "@language": "en"}}], "http://x.org/bal": [{{"@value": "{{bal}}", "@type": "{XSD}decimal"}}], "http://x.org/nation": [{{"@id": "http://x.org/n/{{n}}"}}]}}'
    return _read(spark, _wrapped(spark, _customers(spark, sf), "[", row, ",\n", "]"), "jsonld")


@_query("SELECT c_name || chr(10) || c_mktsegment AS text, CAST(c_custkey AS VARCHAR) AS key, count(*) OVER () AS rows FROM customer")
def load_csv(spark, sf):
    """Cells with line breaks. [S-07, W-01]"""
    path = shared_path(spark, "csv")
    c = spark.read.parquet(f"{sf}/customer.parquet")
    c.select(F.concat("c_name", F.lit("\n"), "c_mktsegment").alias("a text"), F.col("c_custkey").alias("key")).write.csv(path, header=True)
    p = ingest.build_graph(loader.csv_triples(spark, path)).properties
    text, key = (p.where(F.col("pred") == f"urn:col:{x}").select("iri", F.col("value").alias(y)) for x, y in (("a%20text", "text"), ("key", "key")))
    # rows are numbered from 1 on over all files
    count = p.agg(F.max(F.substring_index("iri", ":", -1).cast("long")).alias("rows"))
    return text.join(key, "iri").crossJoin(F.broadcast(count)).select("text", "key", "rows")


_JSON = "SELECT c_name AS name, {} AS bal, CAST(c_nationkey AS VARCHAR) AS n FROM customer".format(D2("c_acctbal"))


def _nested(g: Graph) -> DataFrame:
    """Names of the outer objects beside the values of the object in each: a child refers to what is around it."""
    part = lambda c: F.regexp_extract(c, "#([^#]*)$", 1)
    p = g.properties.select("iri", part("pred").alias("p"), "value")
    named = lambda x: p.where(F.col("p") == x).select("iri", F.col("value").alias(x))
    inner = named("bal").join(named("n"), "iri").withColumnRenamed("iri", "src")
    return g.edges.select("src", F.col("dst").alias("iri")).join(inner, "src").join(named("name"), "iri").select("name", "bal", "n")


_OBJECT = '{"name": "{name}", "none": null, "in side": {"bal": "{bal}", "n": {n}}}'


@_query(_JSON)
def load_json(spark, sf):
    """[S-08]"""
    return _nested(ingest.build_graph(loader.read_triples(spark, _wrapped(spark, _customers(spark, sf), "[", _OBJECT, ",", "]"), "json")))


@_query(_JSON)
def load_ndjson(spark, sf):
    """[S-09, W-01]"""
    return _nested(ingest.build_graph(loader.read_triples(spark, _lines(spark, _customers(spark, sf), _OBJECT), "ndjson")))


@_query(_JSON)
def load_xml(spark, sf):
    """[S-10]"""
    row = "<c><name>{name}</name><in><bal>{bal}</bal><n>{n}</n></in></c>"
    return _nested(ingest.build_graph(loader.read_triples(spark, _wrapped(spark, _customers(spark, sf), "<data>", row, "", "</data>"), "xml")))


@_query("SELECT s, p, o, lang, datatype FROM (" + _FACTS + ") UNION ALL SELECT 'http://x.org/n/' || n_nationkey, 'http://x.org/name', n_name, NULL, NULL FROM nation")
def load_folder(spark, sf):
    """Two formats in folders of one folder; what is neither is left out. [S-11, U-06]"""
    path = shared_path(spark, "folder")
    files = {"one": ("nt", _customers(spark, sf).select(_text(_TRIPLES.replace("GRAPH", "")).alias("value")))}
    nations = spark.read.parquet(f"{sf}/nation.parquet")
    files["two"] = "ttl", nations.select(F.concat(F.lit("<http://x.org/n/"), F.col("n_nationkey").cast("string"), F.lit('> <http://x.org/name> "'), "n_name", F.lit('" .')).alias("value"))
    files["three"] = "csv", nations.select(F.col("n_name").alias("value"))
    for name, (kind, df) in files.items():
        loader.write_lines(df, f"{path}/{name}", kind)
    return _facts(loader.load_folder(spark, path))


@_query("SELECT 'tpch:nation/' || n_nationkey AS iri, n_name AS name, 'http://q.example/' AS base FROM nation")
def load_project(spark, sf):
    """A graph stored, with its prefixes, and restored. [S-14, K-08]"""
    path = shared_path(spark, "saved") + ".project"
    g = lift(spark, sf, "nation", "region")
    sinks.store(g, path, Prefixes({"q": "http://q.example/"}), g.nodes)
    return loader.load(spark, path).properties.where("pred = 'tpch:n_name'").select("iri", F.col("value").alias("name"), F.lit(sinks.restore_prefixes(spark, path).bases["q"]).alias("base"))


@_query(f"SELECT {C} AS iri, c_acctbal AS x, CAST(c_custkey AS DOUBLE) AS y, false AS locked FROM customer")
def load_project_view(spark, sf):
    """The positions of a stored view. [S-14, K-08]"""
    path = shared_path(spark, "saved") + ".project"
    g = lift(spark, sf, "customer")
    sinks.store(g, path, view=_positions(spark, sf))
    return sinks.restore_view(spark, path)


@_query("SELECT count(*) AS blanks, count(DISTINCT c_nationkey) AS named FROM customer")
def load_blank_nodes(spark, sf):
    """Blank nodes of different files stay apart, whatever their names. [N-11]"""
    c = _customers(spark, sf).repartition(3)
    nodes = ingest.build_graph(loader.read_triples(spark, _lines(spark, c, "_:b{k} <http://x.org/nation> <http://x.org/n/{n}> ."), "nt")).nodes
    return nodes.agg(F.count(F.when(F.col("is_blank"), 1)).alias("blanks"), F.count(F.when(~F.col("is_blank"), 1)).alias("named"))


@_query("SELECT 'http://x.org/c/' || c_custkey AS src, 'http://x.org/n/' || c_nationkey AS dst FROM customer")
def stream_files(spark, sf):
    """Files that arrive in a folder, in two runs of a stream. [T-03]"""
    folder, target, state = (shared_path(spark, x) for x in ("arriving", "followed", "state"))
    for rest in (0, 1):
        rows = _customers(spark, sf).where(F.col("c_custkey") % 2 == rest).select(_text("<http://x.org/c/{k}> <http://x.org/nation> <http://x.org/n/{n}> ."))
        loader.write_file(spark, f"{folder}/{rest}.nt", "\n".join(r[0] for r in rows.toLocalIterator()).encode())
        follow_ntriples(spark, folder, target, state).awaitTermination()
    return sinks.restore(spark, target).edges.select("src", "dst")


@_query("SELECT event_id, CASE WHEN value = round(value, 2) THEN CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS value, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts FROM events")
def lift_events(spark, sf):
    """Times keep their microseconds. [S-16]"""
    p = lift(spark, sf, "events").properties
    named = lambda x: p.where(F.col("pred") == f"tpch:{x}").select("iri", F.col("value").alias(x))
    ts = F.to_timestamp("ts")
    return named("value").join(named("ts"), "iri").select(F.substring_index("iri", "/", -1).cast("long").alias("event_id"), "value", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"))


@_query(f"SELECT {N} AS n, n_name AS n_n_name, {R} AS n_2, r_name AS n_2_r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def export_query(spark, sf):
    """A visual query's rows as CSV with a number after equal names. [K-02]"""
    q = TableQuery("tpch:Nation", ("tpch:n_name",)).link("tpch:region", TableQuery("tpch:Region", ("tpch:r_name",)))
    path = shared_path(spark, "export")
    rows = vq.run(lift(spark, sf, "nation", "region"), q)
    sinks.write_csv(rows.toDF("n", "n_n_name", "n", "n_2_r_name"), path)
    return spark.read.csv(path, header=True)


# --- names and sheets ------------------------------------------------------------------------------


def _declared(spark, sf) -> Graph:
    """Nations and regions, whose types and predicates have names in two languages."""
    g = lift(spark, sf, "nation", "region")
    names = [("tpch:Nation", "Nation", "en"), ("tpch:Nation", "Land", "de"), ("tpch:Region", "Region", "en"), ("tpch:region", "lies in", "en")]
    rows = [(i, LABEL, v, "lang", lang, None, 4, k) for k, (i, v, lang) in enumerate(names)]
    return g.with_(properties=g.properties.unionByName(spark.createDataFrame(rows, g.properties.schema)))


@_query("SELECT * FROM (VALUES ('tpch:Nation', 'Land'), ('tpch:Region', 'Region'), ('tpch:region', 'lies in')) AS t(iri, label)")
def names_declared(spark, sf):
    """[P-07, P-17, J-10]"""
    return labels.declared_labels(_declared(spark, sf), "de")


@_query(f"SELECT {N} AS iri, 'Land' AS labels FROM nation UNION ALL SELECT {R}, 'Region' FROM region")
def names_of_types(spark, sf):
    """[P-20]"""
    g = _declared(spark, sf)
    shown = labels.display(g.types.select("type").distinct(), "type", "label_or_shorten", labels.declared_labels(g, "de"))
    return labels.type_labels_of(g, shown)


@_query("SELECT * FROM (VALUES (0, 'tpch:label'), (1, 'tpch:c_acctbal'), (2, 'tpch:c_mktsegment'), (3, 'tpch:c_name')) AS t(place, name)")
def tab_columns(spark, sf):
    """[P-09]"""
    g = lift(spark, sf, "customer")
    more = g.properties.where("pred = 'tpch:c_name'").withColumn("pred", F.lit("tpch:label"))
    found = TypeTable(g.with_(properties=g.properties.unionByName(more)), "tpch:Customer").default_columns()
    return spark.createDataFrame(list(enumerate(found)), "place int, name string")


@_query(f"SELECT {C} AS iri, {D2('c_acctbal')} AS \"tpch:c_acctbal\", c_mktsegment AS \"tpch:c_mktsegment\" FROM customer")
def tab_hide_column(spark, sf):
    """[P-10]"""
    return TypeTable(lift(spark, sf, "customer"), "tpch:Customer").hide("tpch:c_name").rows().drop("n_in", "n_out")


@_query("SELECT l_returnflag AS value, CAST(l_linenumber AS BIGINT) AS seq FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem)")
def tab_cell(spark, sf):
    """All values of one cell. [P-12]"""
    from .catalog import _multi

    first = spark.read.parquet(f"{sf}/lineitem.parquet").agg(F.min("l_orderkey")).first()[0]
    return labels.cell_values(_multi(spark, sf).properties, f"tpch:orders/{first}", "tpch:flag").select("value", "seq")


@_query(
    "SELECT 'type' AS part, NULL AS pred, 'tpch:Nation' AS value, NULL AS other_types UNION ALL SELECT 'property', 'tpch:n_name', n_name, NULL FROM nation WHERE n_nationkey = 3 "
    "UNION ALL SELECT 'reference', 'tpch:region', 'tpch:region/' || n_regionkey, 'tpch:Region' FROM nation WHERE n_nationkey = 3 "
    f"UNION ALL SELECT 'referenced by', 'tpch:nation', {C}, 'tpch:Customer' FROM customer WHERE c_nationkey = 3"
)
def node_sheet(spark, sf):
    """[P-13]"""
    return labels.node_sheet(lift(spark, sf, "nation", "region", "customer"), "tpch:nation/3")


@_query(f"SELECT {C} AS iri, c_mktsegment AS label FROM customer")
def node_labels_set(spark, sf):
    """[P-16]"""
    g = lift(spark, sf, "customer")
    styles = labels.set_label_predicate(labels.type_styles(g), ["tpch:Customer"], "tpch:c_mktsegment")
    return labels.node_labels(g, styles).join(g.types.select("iri"), "iri", "left_semi")


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{b}')" for p, b in {**DEFAULTS, "atk": "http://atk.example/"}.items()) + ") AS t(prefix, base)")
def prefix_table(spark, sf):
    """A name that is taken keeps its base. [N-09, P-19]"""
    p = Prefixes({"atk": "http://atk.example/", "dc": "http://other.example/"})
    return p.table(spark)


@_query("SELECT 'src/' || source AS iri, md5(text) AS value, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents")
def ordered_references(spark, sf):
    """[N-13]"""
    e = _by_source(spark, sf).select(F.col("iri").alias("src"), "pred", F.col("value").alias("dst"), "seq")
    return ingest.ordered_references(lift(spark, sf, "region").with_(edges=e)).select(F.col("src").alias("iri"), F.col("dst").alias("value"), F.col("place").cast("long").alias("place"))


@_query("SELECT type, instances FROM (SELECT 'tpch:Customer' AS type, count(*) AS instances FROM customer UNION ALL SELECT 'tpch:Order', count(*) FROM orders UNION ALL SELECT 'tpch:Nation', count(*) FROM nation) ORDER BY instances DESC, type LIMIT 2")
def types_sorted(spark, sf):
    """[O-08]"""
    return table.sort_types(profile.instances_per_type(lift(spark, sf, "customer", "orders", "nation")), "instances").limit(2)


@_query(f"SELECT {N} AS iri FROM nation UNION ALL SELECT {R} FROM region")
def nodes_of_types(spark, sf):
    """[F-17]"""
    g = lift(spark, sf, "nation", "region", "customer")
    return filters.of_types(g.nodes.select("iri"), g.types, ["tpch:Nation", "tpch:Region"])


@_query(f"SELECT {N} AS iri, 'tpch:Nation' AS type FROM nation UNION ALL SELECT DISTINCT 'tpch:region/' || n_regionkey, 'tpch:Place' FROM nation")
def types_added(spark, sf):
    """[J-13]"""
    g = lift(spark, sf, "nation")
    return resolver.add_missing_types(g, "tpch:region", "tpch:Place").select("iri", "type")


@_query(f"SELECT {N} AS iri, 2 AS n FROM nation")
def graph_union(spark, sf):
    """The same data twice: literals and references add up, nodes and types do not. [U-06]"""
    g = lift(spark, sf, "nation")
    both = g.union(g)
    return both.types.select("iri").join(both.properties.where("pred = 'tpch:n_name'").groupBy("iri").agg(F.count("*").cast("int").alias("n")), "iri")


# --- views -----------------------------------------------------------------------------------------

_LAYER = "CASE WHEN iri LIKE 'tpch:region/%' THEN 10 WHEN iri LIKE 'tpch:nation/%' THEN 5 ELSE 1 END"


def _layers(v) -> DataFrame:
    return v.nodes.select("iri", F.expr(_LAYER).alias("layer"))


@_query(_V + f"SELECT iri FROM v WHERE {_LAYER} >= 5")
def view_hide_layers(spark, sf):
    """[G-16, F-19]"""
    v = _view(spark, sf)
    return v.hide_layers(_layers(v), 5, 0).nodes


@_query("SELECT iri FROM (SELECT 'x' AS iri) WHERE false")
def view_clear(spark, sf):
    """[G-18]"""
    return _view(spark, sf).clear().nodes


@_query(f"SELECT {C} AS iri, c_name AS \"tpch:c_name\" FROM customer WHERE c_acctbal < 0")
def tab_of_view(spark, sf):
    """A view's nodes of one type as a table. [G-19]"""
    v = _view(spark, sf)
    return TypeTable(v.graph, "tpch:Customer").only(v.nodes).show("tpch:c_name").rows().drop("n_in", "n_out")


@_query(_V + f", w AS (SELECT iri FROM v UNION SELECT {C} FROM customer WHERE c_mktsegment = 'BUILDING') SELECT src, pred, dst FROM e WHERE src IN (SELECT iri FROM w) AND dst IN (SELECT iri FROM w)")
def view_add_table(spark, sf):
    """A table's nodes are added to a view, with the edges among all. [G-20]"""
    v = _view(spark, sf)
    rows = spark.read.parquet(f"{sf}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("tpch:customer/"), F.col("c_custkey").cast("string")).alias("iri"))
    return v.add(rows).edges().select("src", "pred", "dst")


@_query(f"SELECT {N} AS iri FROM nation WHERE n_nationkey < 12 UNION ALL SELECT {R} FROM region UNION ALL SELECT {C} FROM customer WHERE c_acctbal < 0 UNION ALL (SELECT {C} AS iri FROM customer WHERE c_acctbal >= 0 ORDER BY iri LIMIT 7)")
def view_add_limit(spark, sf):
    """A view that is full takes the first of what is added, in the order of nodes. [O-14]"""
    v = _view(spark, sf)
    rows = spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal >= 0").select(F.concat(F.lit("tpch:customer/"), F.col("c_custkey").cast("string")).alias("iri"))
    return v.add(rows, v.nodes.count() + 7).nodes


@_query(_V + "SELECT iri FROM v")
def sel_all(spark, sf):
    """Nothing selected, inverted. [G-21]"""
    v = _view(spark, sf)
    return v.invert(v.nodes.limit(0))


def _positions(spark, sf) -> DataFrame:
    """Customers at (balance, key), none of them locked."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select(F.concat(F.lit("tpch:customer/"), F.col("c_custkey").cast("string")).alias("iri"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"), F.lit(False).alias("locked"))


@_query(f"SELECT {C} AS iri, c_acctbal < 0 AS locked FROM customer")
def positions_lock(spark, sf):
    """[G-25]"""
    v = _view(spark, sf)
    return v.lock(_positions(spark, sf), v.nodes).select("iri", "locked")


@_query(f"SELECT {C} AS iri, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 4) AS x, round(c_custkey - (SELECT avg(c_custkey) FROM customer), 4) AS y FROM customer")
def positions_center(spark, sf):
    """[G-28]"""
    return view.center(_positions(spark, sf)).select("iri", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@_query(f"SELECT {N} AS iri, round(10 + 50 * cos(a), 6) AS x, round(20 + 50 * sin(a), 6) AS y FROM (SELECT n_nationkey, 0.5 + 2 * pi() * (row_number() OVER (ORDER BY {N}) - 1) / count(*) OVER () AS a FROM nation)")
def positions_around(spark, sf):
    """[G-29]"""
    nodes = lift(spark, sf, "nation").nodes.select("iri")
    return view.around((10.0, 20.0), nodes, 50.0, 0.5).select("iri", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@_query(f"SELECT {C} AS iri FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_custkey BETWEEN 10 AND 90")
def positions_rectangle(spark, sf):
    """[F-20]"""
    return filters.in_rectangle(_positions(spark, sf), 5000.0, 10.0, 0.0, 90.0).select("iri")


@_query(f"WITH h AS (SELECT c_acctbal AS hx, c_custkey AS hy FROM customer WHERE c_custkey = 7) SELECT {C} AS iri FROM customer, h WHERE c_custkey <> 7 AND c_acctbal > hx AND abs(c_custkey - hy) <= c_acctbal - hx ORDER BY c_acctbal - hx, abs(c_custkey - hy), iri LIMIT 1")
def positions_next(spark, sf):
    """[G-36]"""
    return view.next_in_direction(_positions(spark, sf), "tpch:customer/7", 1, 0)


# --- analytics over whole graphs -------------------------------------------------------------------


def _whole(spark, sf) -> Graph:
    """Every order, customer, supplier, nation and region."""
    return lift(spark, sf, "orders", "customer", "supplier", "nation", "region")


@_query(
    "WITH m AS (SELECT 'tpch:orders/' || o_orderkey AS iri, c_nationkey AS k FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'tpch:customer/' || c_custkey, c_nationkey FROM customer "
    "UNION ALL SELECT 'tpch:supplier/' || s_suppkey, s_nationkey FROM supplier UNION ALL SELECT 'tpch:nation/' || n_nationkey, n_nationkey FROM nation), "
    "r AS (SELECT iri, n_regionkey AS r FROM m JOIN nation ON n_nationkey = k UNION ALL SELECT 'tpch:region/' || r_regionkey, r_regionkey FROM region) "
    "SELECT iri, min(iri) OVER (PARTITION BY r) AS component FROM r"
)
def graph_components(spark, sf):
    """Components of the whole graph: one for each region. [G-31]"""
    g = _whole(spark, sf)
    return traverse.connected_components(g.nodes.select("iri"), g.edges)


@_query()
def graph_page_rank(spark, sf):
    """Until the ranks stand still; a test compares a small graph with a plain power iteration. [M-06]"""
    g = _whole(spark, sf)
    return scores.page_rank(g.nodes.select("iri"), g.edges)


@_query()
def graph_eigenvector(spark, sf):
    """Until the scores stand still, as above. [M-05]"""
    g = _whole(spark, sf)
    return scores.eigenvector(g.nodes.select("iri"), g.edges)


@_query(
    _V + f", {_ENDS}, d AS (SELECT iri, count(b) AS n FROM v LEFT JOIN x ON a = iri GROUP BY iri), k AS (SELECT iri, n, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END AS c FROM d) SELECT iri, "
    "round((n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ())::DOUBLE, 9) AS degree, round(CASE WHEN max(c) OVER () = min(c) OVER () THEN 0.0 ELSE (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) END::DOUBLE, 9) AS core FROM k ORDER BY degree DESC, iri LIMIT 20"
)
def g_statistics(spark, sf):
    """Scores that are kept, as one table by one of them; a forest has no core but the first. [M-13, M-15, O-10]"""
    v = _view(spark, sf)
    s = scores.Statistics(v.nodes, v.edges())
    s.get(scores.Algorithm.DEGREE)
    s.get(scores.Algorithm.K_CORE)
    t = s.table(scores.Algorithm.DEGREE).limit(20)
    return t.select("iri", F.round("degree", 9).alias("degree"), F.round("k-core", 9).alias("core"))


_RING = "e AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, (7 * n_nationkey + 3) % 25 FROM nation UNION ALL SELECT 0, 1), u AS (SELECT a, b, count(*) AS w FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) WHERE a <> b GROUP BY a, b)"


@_query(
    f"WITH RECURSIVE {_RING}, walk AS (SELECT n_nationkey AS s, n_nationkey AS t, 0 AS d, CAST(1 AS BIGINT) AS paths FROM nation UNION ALL SELECT s, b, d + 1, sum(paths * w)::BIGINT FROM walk JOIN u ON a = t WHERE d < 6 GROUP BY s, b, d), "
    "m AS (SELECT s, t, min(d) AS d, arg_min(paths, d)::DOUBLE AS paths FROM (SELECT s, t, d, sum(paths) AS paths FROM walk GROUP BY ALL) GROUP BY s, t) "
    "SELECT 'n/' || v.n_nationkey AS iri, round(coalesce(sum(x.paths * y.paths / z.paths), 0), 6) AS value FROM nation v LEFT JOIN (m x JOIN m y ON x.t = y.s JOIN m z ON z.s = x.s AND z.t = y.t AND z.d = x.d + y.d) ON x.t = v.n_nationkey AND x.s <> x.t AND y.t <> y.s GROUP BY v.n_nationkey"
)
def graph_betweenness(spark, sf):
    """A ring with chords and a double edge, where many shortest paths run side by side; by joins. [M-02]"""
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("a"))
    both = n.select("a", ((F.col("a") + 1) % 25).alias("b")).unionByName(n.select("a", ((7 * F.col("a") + 3) % 25).alias("b"))).unionByName(n.where("a = 0").select("a", F.lit(1).alias("b")))
    name = lambda c: F.concat(F.lit("n/"), F.col(c).cast("string"))
    found = scores.betweenness_by_joins(n.select(name("a").alias("iri")), both.select(name("a").alias("src"), name("b").alias("dst")))
    return found.select("iri", F.round("value", 6).alias("value"))


@_query(_V + ", x AS (SELECT c.iri AS src, r.dst AS dst FROM (SELECT src AS iri, dst FROM ve WHERE src LIKE 'tpch:customer/%') c JOIN ve r ON r.src = c.dst), p AS (SELECT a.src AS a, b.src AS b FROM x a JOIN x b ON a.dst = b.dst WHERE a.src < b.src) SELECT a, b FROM p")
def view_contract_chain(spark, sf):
    """Nations and regions go: customers of a region are tied to each other through both. [G-17]"""
    v = _view(spark, sf)
    e = v.contract(v.nodes.where("iri like 'tpch:nation/%' or iri like 'tpch:region/%'")).edges()
    return e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))


# --- layouts: the edges of _view tie every node to its region, by name the least of a component ------

_PART = (
    _V.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", u AS (SELECT src AS a, dst AS b FROM ve UNION SELECT dst, src FROM ve), reach AS (SELECT iri AS s, iri AS t FROM v UNION SELECT s, b FROM reach JOIN u ON a = t), part AS (SELECT s AS iri, min(t) AS component FROM reach GROUP BY s) "
)


@_query(_PART + "SELECT iri, round(r * cos(a), 6) AS x, round(r * sin(a), 6) AS y FROM (SELECT iri, 2 * pi() * (row_number() OVER (ORDER BY component, iri) - 1) / count(*) OVER () AS a, count(*) OVER () * 50 / (2 * pi()) AS r FROM part)")
def layout_circle(spark, sf):
    """[L-03, L-11]"""
    v = _view(spark, sf)
    return layout.arrange(layout.Layout.CIRCULAR, v.nodes, v.edges()).select("iri", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@_query(_PART + "SELECT iri, 0.0::DOUBLE AS x, 50.0 * row_number() OVER (ORDER BY component, iri) AS y FROM part")
def layout_line(spark, sf):
    """[L-05, L-11]"""
    v = _view(spark, sf)
    return layout.arrange(layout.Layout.VERTICAL, v.nodes, v.edges())


@_query(_V + "SELECT iri, (dense_rank() OVER (ORDER BY type) - 1) * 300.0::DOUBLE AS x, 50.0::DOUBLE * (row_number() OVER (PARTITION BY type ORDER BY iri) - (count(*) OVER (PARTITION BY type) + 1) / 2.0) AS y FROM v JOIN n USING (iri)")
def layout_columns(spark, sf):
    """[L-06, L-11]"""
    v = _view(spark, sf)
    return layout.arrange(layout.Layout.MULTIPARTITE, v.nodes, v.edges(), v.graph.types)


@_query(
    _V + ", l AS (SELECT iri, CASE WHEN iri LIKE 'tpch:region/%' THEN CASE WHEN EXISTS (SELECT 1 FROM ve a JOIN ve b ON a.dst = b.src WHERE b.dst = v.iri) THEN 2 WHEN EXISTS (SELECT 1 FROM ve WHERE dst = v.iri) THEN 1 ELSE 0 END "
    "WHEN EXISTS (SELECT 1 FROM ve WHERE dst = v.iri) THEN 1 ELSE 0 END AS layer FROM v) SELECT iri, 50.0::DOUBLE * (row_number() OVER (PARTITION BY layer ORDER BY iri) - (count(*) OVER (PARTITION BY layer) + 1) / 2.0) AS x, layer * 150.0::DOUBLE AS y FROM l"
)
def layout_layers(spark, sf):
    """[L-04, L-11]"""
    v = _view(spark, sf)
    return layout.arrange(layout.Layout.HIERARCHICAL, v.nodes, v.edges())


# --- scalars ---------------------------------------------------------------------------------------


@_query("SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug, replace(replace(replace(replace(url_encode(url), '-', '%2D'), '_', '%5F'), '.', '%2E'), '~', '%7E') AS encoded FROM pages")
def scalar_names(spark, sf):
    """[X-07, X-08]"""
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", scalars.slug(F.col("url")).alias("slug"), scalars.percent_encoded(F.col("url")).alias("encoded"))


@_query(
    "WITH t AS (SELECT p_partkey, p_size, (p_size - (SELECT min(p_size) FROM part)) / ((SELECT max(p_size) FROM part) - (SELECT min(p_size) FROM part))::DOUBLE AS s FROM part) SELECT p_partkey, round(10 + s * 30, 6) AS size, CAST(round(s * 9 + 1) AS INTEGER) AS level, "
    "round(sqrt(4 + s * 96), 6) AS radius, round(1 - s * s * s * (s * (s * 6 - 15) + 10), 6) AS inverted, printf('%.3f', p_size::DOUBLE) AS shown FROM t"
)
def scalar_scales(spark, sf):
    """[X-11..X-14, X-16, M-07, M-12]"""
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_size").alias("n"), F.col("p_size").cast("double").alias("s"))
    bounds = p.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    p, s = scalars.min_max(p, "s").crossJoin(F.broadcast(bounds)), F.col("s")
    return p.select(
        "p_partkey", F.round(scalars.lerp(s, 10, 40), 6).alias("size"), scalars.level(s).alias("level"), F.round(scalars.area_radius(F.col("n"), F.col("lo"), F.col("hi"), 2.0, 10.0), 6).alias("radius"),
        F.round(scalars.smooth_invert(s), 6).alias("inverted"), scalars.fixed(F.col("n"), 3).alias("shown"),
    )
