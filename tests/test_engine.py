"""Exact values on small graphs and texts."""

import pytest
from pyspark.sql import functions as F

from quadrille.functions import scalars
from quadrille.functions.prefixes import Prefixes
from quadrille.model import EDGES, MAX_VISIBLE, NODE_TYPES, NODES, PROPERTIES, RDF_FIRST, RDF_NIL, RDF_REST, Graph, empty_graph
from quadrille.operators import community, ingest, labels, layout, scores, traverse
from quadrille.operators import view as views
from quadrille.operators.view import History, View
from quadrille.plans import staging
from quadrille.plans.visual_query import TableQuery
from quadrille.sources import loader, parsers, sinks
from quadrille.streaming.ingest import follow_ntriples

RDF = parsers.RDF


def graph(spark, n, pairs):
    nodes = spark.createDataFrame([(str(i),) for i in range(n)], "iri string")
    return nodes, spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")


def values(df):
    return [round(r["value"], 6) for r in df.orderBy(F.col("iri").cast("int")).collect()]


def test_betweenness(spark):
    assert values(scores.betweenness(*graph(spark, 5, [(0, 1), (1, 3), (0, 2), (3, 4), (2, 3)]))) == [1, 2, 2, 7, 0]


def test_k_core(spark):
    assert values(scores.k_core(*graph(spark, 5, [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4)]))) == [2, 2, 2, 1, 1]


def test_closeness_both_ways(spark):
    g = graph(spark, 6, [(0, 1), (1, 2), (1, 2), (3, 4), (3, 3)])
    assert values(scores.closeness(*g)) == values(scores.closeness_by_joins(*g)) == [round(2 / 3, 6), 1, round(2 / 3, 6), 1, 1, 0]


def test_large_views_go_by_joins(spark, monkeypatch):
    pairs = [(0, 1), (1, 3), (0, 2), (3, 4), (2, 3), (3, 4), (4, 4), (5, 6)]
    small = [values(f(*graph(spark, 8, pairs))) for f in (scores.betweenness, scores.closeness)]
    monkeypatch.setattr(scores, "MOST_SENT", 3)
    assert [values(f(*graph(spark, 8, pairs))) for f in (scores.betweenness, scores.closeness)] == small


def test_page_rank_and_eigenvector_of_a_graph_with_cycles(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 3), (4, 0), (4, 0), (1, 5)]
    n, rank, score = 6, [1 / 6] * 6, [1.0] * 6
    for _ in range(300):
        out = [sum(a == i for a, _ in pairs) for i in range(n)]
        lost = sum(r for r, o in zip(rank, out) if not o)
        rank = [0.15 / n + 0.85 * (sum(rank[a] / out[a] for a, b in pairs if b == i) + lost / n) for i in range(n)]
        score = [sum(score[b] for a, b in pairs if a == i) + sum(score[a] for a, b in pairs if b == i) for i in range(n)]
        norm = sum(x * x for x in score) ** 0.5
        score = [x / norm for x in score]
    for found, want in ((scores.page_rank(*graph(spark, n, pairs)), rank), (scores.eigenvector(*graph(spark, n, pairs)), score)):
        assert max(abs(a - b) for a, b in zip(values(found), want)) < 1e-4


def test_eigenvector_counts_leaves_once_and_takes_few_plans(spark, monkeypatch):
    import numpy as np

    # two hubs with leaves, some by double edges, a loop, a pair apart, and a node alone
    pairs = [(0, 1)] + [(0, i) for i in range(2, 8)] + [(i, 1) for i in range(8, 12)] + [(0, 12), (0, 12), (1, 13), (13, 1), (1, 1), (14, 15)]
    m = np.zeros((17, 17))
    for a, b in pairs:
        m[a, b] += 1
        m[b, a] += 1
    want = np.ones(17)
    for _ in range(100):
        want = m @ want
        want /= np.sqrt(want @ want)
    cuts, cut = [], scores.cut
    monkeypatch.setattr(scores, "cut", lambda df: cuts.append(1) or cut(df))
    assert values(scores.eigenvector(*graph(spark, 17, pairs), tolerance=0.0)) == pytest.approx(want.round(6).tolist(), abs=2e-6)
    assert len(cuts) < 10
    monkeypatch.setattr(scores, "MOST_SENT", 0)
    assert values(scores.eigenvector(*graph(spark, 17, pairs), rounds=12, tolerance=0.0))[16] == 0
    assert values(scores.eigenvector(*graph(spark, 17, pairs))) == pytest.approx(want.round(6).tolist(), abs=2e-6)
    assert values(scores.eigenvector(*graph(spark, 3, []))) == [0, 0, 0]


def test_least_vectors_without_a_dense_matrix(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    pairs = [(i, i + 1) for i in range(0, 299) if i != 149] + [tuple(x) for x in rng.integers(0, 150, (80, 2)).tolist()] + [(149, 150)]
    values_, vectors = community.least_vectors(300, pairs, 3)
    monkeypatch.setattr(community, "DENSE", 100)
    more, found = community.least_vectors(300, pairs, 3)
    assert np.allclose(values_, more, atol=1e-5) and abs(vectors[:, 1] @ found[:, 1]) > 0.999


def test_long_chains_and_cycles_have_layers(spark):
    nodes, edges = graph(spark, 1500, [(i, i + 1) for i in range(1499)])
    assert layout.hierarchical(nodes, edges).agg(F.max("y")).first()[0] == 1499 * 150.0
    nodes, edges = graph(spark, 4, [(0, 1), (1, 2), (2, 0), (2, 3)])
    assert [r["y"] for r in layout.hierarchical(nodes, edges).orderBy("iri").collect()] == [0.0, 150.0, 300.0, 450.0]


def test_modularity_and_gain(spark):
    nodes, edges = graph(spark, 6, [(0, 2), (0, 1), (2, 3), (3, 4), (3, 5), (4, 5)])
    apart = nodes.select("iri", F.when(F.col("iri") == "1", "0").otherwise(F.col("iri")).alias("cluster"))
    assert round(community.modularity(edges, apart).first()[0], 7) == -0.0416667
    # community {0, 1} has three ends, node 2 has two, one edge between them, six edges
    assert round(community.gain(1, 3, 2, 6), 7) == 0.0833333


#: A graph with three communities.
SIXTEEN = [
    (0, 2), (0, 3), (0, 5), (1, 2), (1, 4), (1, 7), (2, 4), (2, 5), (2, 6), (3, 7), (4, 10), (5, 7), (5, 11), (6, 7),
    (6, 11), (8, 9), (8, 10), (8, 11), (8, 14), (8, 15), (9, 12), (9, 14), (10, 11), (10, 12), (10, 13), (10, 14), (11, 13),
]


def test_louvain(spark):
    assert len(set(community.louvain_local(16, SIXTEEN))) == 3
    # names sort as texts there, so nodes are visited in another order
    found = community.louvain(*graph(spark, 16, SIXTEEN))
    assert found.count() == 16 and found.select("cluster").distinct().count() == 3


def test_spectral(spark):
    found = {r["iri"]: r["cluster"] for r in community.spectral(*graph(spark, 6, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)])).collect()}
    assert len({found[x] for x in "012"}) == 1 and len({found[x] for x in "345"}) == 1 and found["0"] != found["3"]


@pytest.mark.parametrize("data, expected", [([5.0] * 5, {10: 5}), ([1.0] + [0.0] * 5, {10: 1, 9: 5}), ([1.0] * 5 + [0.5], {10: 5, 9: 1})])
def test_zoom_layers_keep_ties_together(spark, data, expected):
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(data)], "iri string, value double")
    assert {r["layer"]: r["count"] for r in scores.zoom_layers(df).groupBy("layer").count().collect()} == expected


def test_zoom_layers_of_many_values(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("iri"), F.col("id").cast("double").alias("value"))
    got = {r["layer"]: r["count"] for r in scores.zoom_layers(df).groupBy("layer").count().collect()}
    assert sorted(got) == list(range(1, 11)) and got[10] == 4


def test_components_and_paths(spark):
    nodes, edges = graph(spark, 7, [(0, 1), (1, 2), (3, 4), (0, 5), (5, 2)])
    assert {r["iri"]: r["component"] for r in traverse.connected_components(nodes, edges).collect()} == {"0": "0", "1": "0", "2": "0", "3": "3", "4": "3", "5": "0", "6": "6"}
    assert {r["iri"] for r in traverse.shortest_connection(edges, "0", "2").collect()} == {"0", "1", "2", "5"}
    assert traverse.shortest_connection(edges, "0", "3").count() == 0


def test_prefixes(spark):
    p = Prefixes()
    p.add("atk", "http://atk.example/")
    p.add("rdf", "http://other/")
    rows = [("http://www.w3.org/2000/01/rdf-schema#Class", "rdfs:Class"), ("http://none/Class", "http://none/Class"), ("http://atk.example/a", "atk:a"), ("http://dbpedia.org/resource/ANSI/C", "dbr:ANSI/C")]
    df = spark.createDataFrame(rows, "full string, short string").select("full", "short", p.compact(F.col("full")).alias("c"), p.expand(F.col("short")).alias("e"))
    for r in df.collect():
        assert r["c"] == r["short"] == p.compact_text(r["full"])
        assert r["e"] == (r["full"] if r["short"] != r["full"] else None)


def test_query_order_is_depth_first():
    q = TableQuery("1").link("p", TableQuery("3").link("q", TableQuery("6"))).link("r", TableQuery("5"), True)
    assert [t.type for t in q.walk()] == ["1", "3", "6", "5"]


def test_view_algebra(spark):
    e = empty_graph(spark)
    edges = spark.createDataFrame([(a, "p", b, 0) for a, b in (("0", "5"), ("0", "5"), ("5", "2"), ("5", "12"), ("10", "2"), ("0", "3"), ("0", "10"))], EDGES)
    g = e.with_(edges=edges)
    some = lambda *x: spark.createDataFrame([(i,) for i in x], "iri string")
    v = View(g, some("0", "10", "5"))
    grown = v.expand_all()
    assert {r[0] for r in grown.nodes.collect()} == {"0", "10", "5", "2", "3", "12"}
    assert {r[0] for r in grown.remove(some("2", "5", "12")).nodes.collect()} == {"0", "3", "10"}
    assert v.clear().nodes.count() == 0 and v.nodes.count() == 3
    gone = View(g, some("0", "5", "2", "12")).contract(some("5"))
    assert {(r["src"], r["dst"]) for r in gone.edges().collect()} == {("0", "2"), ("0", "12")}


def _star(spark) -> tuple[Graph, int]:
    """A hub that refers to every other node, more than a drawing holds; half of them are of a type."""
    n = MAX_VISIBLE + 1000
    edges = spark.range(n).select(F.lit("hub").alias("src"), F.lit("p").alias("pred"), F.concat(F.lit("n"), "id").alias("dst"), F.col("id").alias("seq"))
    types = edges.where("seq % 2 = 0").select(F.col("dst").alias("iri"), F.lit("T").alias("type"), F.col("seq").alias("type_seq"))
    return empty_graph(spark).with_(edges=edges, types=types), n


def test_all_neighbours_of_a_view_are_added(spark):
    g, n = _star(spark)
    assert View(g, spark.createDataFrame([("hub",)], "iri string")).expand_all().nodes.count() == n + 1


def test_all_neighbours_of_a_type_are_added(spark):
    g, n = _star(spark)
    some = spark.range(MAX_VISIBLE - 10).select(F.concat(F.lit("x"), "id").alias("iri"))
    view = View(g, some.unionByName(spark.createDataFrame([("hub",)], "iri string")))
    assert view.expand_all(types=["T"]).nodes.count() == view.nodes.count() + n // 2


def test_all_that_a_node_refers_to_is_added(spark):
    g, n = _star(spark)
    view = View(g, spark.createDataFrame([("hub",)], "iri string"))
    assert view.expand(view.nodes, "out").nodes.count() == n + 1
    assert view.expand(view.nodes, "out", most=7).nodes.count() == 7


def test_all_that_refers_to_a_node_is_added(spark):
    g, n = _star(spark)
    g = g.with_(edges=g.edges.select(F.col("dst").alias("src"), "pred", F.col("src").alias("dst"), "seq"))
    view = View(g, spark.createDataFrame([("hub",)], "iri string"))
    assert view.expand(view.nodes, "in", "p").nodes.count() == n + 1


def test_all_rows_of_a_table_are_added(spark):
    g, n = _star(spark)
    view = View(g, spark.createDataFrame([("hub",)], "iri string"))
    rows = g.edges.select(F.col("dst").alias("iri"))
    assert view.add(rows).nodes.count() == n + 1 and view.add(rows, MAX_VISIBLE).nodes.count() == MAX_VISIBLE


def _repeated(spark) -> View:
    """A view that names its nodes twice, as a table of repeated keys does."""
    edges = spark.createDataFrame([("a", "p", "hub", 0), ("a", "p", "hub", 0), ("b", "p", "hub", 0)], EDGES)
    types = spark.createDataFrame([("b", "T", 0), ("b", "T", 0)], "iri string, type string, type_seq long")
    return View(empty_graph(spark).with_(edges=edges, types=types), spark.createDataFrame([("hub",), ("hub",), ("x",), ("x",)], "iri string"))


def test_what_refers_to_a_node_is_added_once_to_repeated_nodes(spark):
    v = _repeated(spark)
    assert sorted(r["iri"] for r in v.expand(v.nodes, "in", "p").nodes.collect()) == ["a", "b", "hub", "x"]


def test_neighbours_of_a_type_are_added_once_to_repeated_nodes(spark):
    assert sorted(r["iri"] for r in _repeated(spark).expand_all(types=["T"]).nodes.collect()) == ["b", "hub", "x"]


def test_contraction_of_neighbours_and_history(spark):
    edges = spark.createDataFrame([(a, p, b, 0) for a, p, b in (("a", "p", "v"), ("v", "q", "w"), ("w", "r", "b"), ("c", "s", "w"))], EDGES)
    some = lambda *x: spark.createDataFrame([(i,) for i in x], "iri string")
    v = View(empty_graph(spark).with_(edges=edges), some("a", "b", "c", "v", "w"))
    past = History(v)
    now = past.do(v.contract(some("v", "w")))
    assert {(r["src"], r["pred"], r["dst"]) for r in now.edges().collect()} == {("a", "p", "b"), ("c", "s", "b")}
    assert past.undo() is v and past.undo() is v and past.redo() is now and past.redo() is now
    past.undo()
    assert past.do(v.clear()) is past.now and len(past.views) == 2


def _pairs(e):
    return sorted((min(r["src"], r["dst"]), max(r["src"], r["dst"])) for r in e.collect())


def test_contraction_ties_each_pair_once(spark):
    # b and c meet through v, through w and both ways; d hangs on v alone; x has a loop; y is only a source
    edges = [("b", "p", "v"), ("c", "p", "v"), ("b", "o", "v"), ("d", "p", "v"), ("w", "q", "b"), ("c", "p", "w"), ("b", "p", "u"), ("u", "p", "c"), ("c", "p", "u"), ("u", "p", "b"), ("x", "p", "x"), ("d", "p", "x"), ("y", "p", "d"), ("y", "p", "b"), ("y", "p", "e")]
    some = lambda *x: spark.createDataFrame([(i,) for i in x], "iri string")
    v = View(empty_graph(spark).with_(edges=spark.createDataFrame([(*e, 0) for e in edges], EDGES)), some(*"bcdeuvwxy"))
    found = v.contract(some(*"uvwxy"))
    assert _pairs(found.edges()) == [("b", "c"), ("b", "d"), ("b", "e"), ("c", "d"), ("d", "e")]
    assert {r["pred"] for r in found.edges().where("src = 'b' and dst = 'd'").collect()} == {"o"}
    # nodes that come back see no edge more, those that go take theirs along
    assert _pairs(found.remove(some("c")).edges()) == [("b", "d"), ("b", "e"), ("d", "e")]


def test_contraction_of_neighbours_leaves_pairs_to_the_end(spark, monkeypatch):
    # many nodes under four hidden ones under a fifth: no round but the last makes pairs of the many
    edges = spark.createDataFrame([(f"a{i:03}", "p", f"v{i % 4}", 0) for i in range(60)] + [(f"v{i}", "p", "w", 0) for i in range(4)], EDGES)
    nodes = edges.select(F.col("src").alias("iri")).unionByName(spark.createDataFrame([("w",)], "iri string"))
    sizes, cut = [], staging.cut
    monkeypatch.setattr(staging, "cut", lambda df: sizes.append(df.count()) or cut(df))
    monkeypatch.setattr(views, "_DEAL", 7)
    found = View(empty_graph(spark).with_(edges=edges), nodes).contract(nodes.where("iri like 'v%' or iri = 'w'")).edges()
    assert _pairs(found) == [(f"a{i:03}", f"a{j:03}") for i in range(60) for j in range(i + 1, 60)]
    assert max(sizes) < 200


def test_describe_and_fetch_over_http(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.headers["Accept"], self.rfile.read(int(self.headers["Content-Length"])).decode()))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'<http://e/a> <http://e/p> "x" ; <http://e/r> <http://e/b> .')

        def log_message(self, *_):
            pass

        def do_GET(self):
            asked.append((self.headers["Accept"], ""))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"<http://e/a> <http://e/p> <http://e/b> .\n")

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    g = loader.DescribeAdapter(loader.endpoint(f"http://127.0.0.1:{server.server_port}/sparql")).load(spark, "http://e/a")
    there = loader.fetch(spark, f"http://127.0.0.1:{server.server_port}/x", "nt", f"file://{tmp_path}/got/x.nt")
    server.shutdown()
    assert loader.load(spark, there).edges.count() == 1 and asked.pop()[0] == "application/n-triples"
    assert (g.properties.count(), g.edges.count()) == (1, 1)
    assert asked[0][0] == "text/turtle" and asked[0][1].startswith("query=CONSTRUCT") and "http%3A%2F%2Fe%2Fa" in asked[0][1]


TURTLE = """@prefix ex: <http://ex.org/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
# a comment
ex:a a ex:T ; rdfs:label "A"@en, 'Ä'@de ; ex:n 5, 1.5, 2e3 ; ex:ok true ; ex:l ( ex:b "x" ) ; ex:c\\(d\\) [ ex:p \"\"\"long "text"\nhere\"\"\" ] .
_:z ex:d "2020-01-01"^^xsd:date .
"""


def test_turtle():
    got = list(parsers.turtle(TURTLE))
    a = ("iri", "http://ex.org/a")
    assert (a, RDF + "type", ("iri", "http://ex.org/T")) in got
    assert (a, "http://www.w3.org/2000/01/rdf-schema#label", ("literal", "Ä", "de", None)) in got
    assert [t[2][1:] for t in got if t[1] == "http://ex.org/n"] == [("5", None, parsers.XSD + "integer"), ("1.5", None, parsers.XSD + "decimal"), ("2e3", None, parsers.XSD + "double")]
    assert any(t[1] == "http://ex.org/c(d)" for t in got) and any(t[2][1] == 'long "text"\nhere' for t in got)
    assert sum(t[1] == RDF + "first" for t in got) == 2 and (("blank", "z"), "http://ex.org/d", ("literal", "2020-01-01", None, parsers.XSD + "date")) in got


def test_trig_drops_graphs():
    text = "@prefix e: <http://e/> . e:g { e:a e:p e:b . e:b e:p e:c } GRAPH e:h { e:x e:p 1 . } { e:y e:p e:z . }"
    assert len(list(parsers.turtle(text))) == 4


def test_rdf_xml_and_json_ld_agree():
    xml = f"""<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="http://e/"><e:T rdf:about="http://e/a" e:q="v"><e:p rdf:resource="http://e/b"/><e:n rdf:datatype="{parsers.XSD}integer">5</e:n><e:l xml:lang="en">x</e:l></e:T></rdf:RDF>"""
    ld = '{"@context": {"e": "http://e/"}, "@id": "e:a", "@type": "e:T", "e:q": "v", "e:p": {"@id": "e:b"}, "e:n": 5, "e:l": {"@value": "x", "@language": "en"}}'
    assert sorted(map(repr, parsers.rdf_xml(xml))) == sorted(map(repr, parsers.json_ld(ld)))


def test_files(spark, tmp_path):
    nt = '<http://e/a> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://e/T> .\n<http://e/a> <http://e/p> "q\\"\\u00e9"@en .\n_:b <http://e/p> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .\nbroken\n'
    (tmp_path / "a.nt").write_text(nt)
    (tmp_path / "b.nq").write_text("<http://e/a> <http://e/r> <http://e/b> <http://e/g> .\n")
    (tmp_path / "c.ttl").write_text(TURTLE)
    (tmp_path / "d.csv").write_text("x,y z\n1,\n2,b\n")
    g = loader.load(spark, str(tmp_path / "a.nt"))
    assert (g.nodes.count(), g.types.count(), g.properties.count()) == (2, 1, 2)
    assert {r["value"] for r in g.properties.collect()} == {'q"é', "1"}
    assert loader.load(spark, str(tmp_path / "b.nq")).edges.count() == 1
    c = loader.load(spark, str(tmp_path / "d.csv"))
    assert sorted((r["iri"][-1], r["pred"], r["value"]) for r in c.properties.collect()) == [("1", "urn:col:x", "1"), ("2", "urn:col:x", "2"), ("2", "urn:col:y%20z", "b")]
    whole = loader.load_folder(spark, str(tmp_path))
    assert whole.types.count() == 2
    english = loader.load(spark, str(tmp_path / "c.ttl"), ["en"])
    assert "Ä" not in {r["value"] for r in english.properties.collect()}


def test_lines_of_a_folder_are_split(spark, tmp_path):
    lines = spark.range(30_000).select(F.format_string('<http://e/%d> <http://e/p> "%d" .', "id", "id").alias("value"))
    loader.write_lines(lines.coalesce(1), str(tmp_path / "one"), "nt")
    loader.write_lines(lines.limit(2), str(tmp_path / "two"), "csv")
    assert [p.name[:5] for p in (tmp_path / "one").glob("*.nt")] == ["part-"] and not list(tmp_path.glob("*/*.txt"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        found = loader.load_folder(spark, str(tmp_path)).properties
        assert found.rdd.getNumPartitions() > 1 and found.select("value").distinct().count() == found.count() == 30_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_and_xml_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"Id": 1, "tags": ["a", "b"], "in side": {"ok": true, "x": null, "f": 1.5}}, {"Id": 2}]')
    g = loader.load(spark, str(tmp_path / "a.json"))
    assert g.nodes.count() == 3 and g.edges.count() == 1 and g.properties.count() == 6
    (tmp_path / "b.ndjson").write_text('{"id": 1, "o": {"x": 1}}\n\n{"id": 2}\nnot json\n{"id": 3}\n')
    assert {r["iri"].rsplit("#")[-1] for r in loader.load(spark, str(tmp_path / "b.ndjson")).nodes.collect()} == {"0", "1", "2", "3"}
    (tmp_path / "c.xml").write_text('<data><person id="0"><name>M&amp;B&#128522;C</name></person><person id="1"><name>Bob</name></person></data>')
    x = loader.load(spark, str(tmp_path / "c.xml"))
    assert x.nodes.count() == 3 and x.types.select("type").distinct().count() == 2 and "M&B😊C" in {r["value"] for r in x.properties.collect()}
    with pytest.raises(ValueError):
        loader.read_triples(spark, "x.unknown")


def test_a_mistake_leaves_out_one_statement(spark, tmp_path):
    good = "<http://e/{0}> <http://e/p> \"{0}\" .\n"
    (tmp_path / "a.ttl").write_text(good.format("a") + "<http://e/x> <http://e/p> unknown:name, 1 .\n" + good.format("b") + "<http://e/y> § <http://e/p> .\n" + good.format("c") + "<http://e/z> <http://e/p>")
    (tmp_path / "b.trig").write_text("<http://e/g> { " + good.format("a") + " <http://e/x> no:such 1 . " + good.format("b") + " }\n" + good.format("c"))
    for name in ("a.ttl", "b.trig"):
        assert sorted(r["value"] for r in loader.load(spark, str(tmp_path / name)).properties.collect()) == ["a", "b", "c"], name


def test_csv_cells_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,t\n1,"two\nlines, ""quoted"""\n2,"a, b"\n3,\n')
    got = sorted((r["iri"][-1], r["pred"][-1], r["value"]) for r in loader.load(spark, str(tmp_path / "a.csv")).properties.collect())
    assert got == [("1", "n", "1"), ("1", "t", 'two\nlines, "quoted"'), ("2", "n", "2"), ("2", "t", "a, b"), ("3", "n", "3")]


def test_deep_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a":' * 400 + "1" + "}" * 400)
    assert loader.load(spark, str(tmp_path / "a.json")).nodes.count() == 400
    (tmp_path / "b.json").write_text("[" * 200_000 + "]" * 200_000)  # beyond the reader: nothing, and no failure
    assert loader.load(spark, str(tmp_path / "b.json")).nodes.count() == 0
    (tmp_path / "c.xml").write_text("<a>" * 3000 + "<b x='1'/>" + "</a>" * 3000)
    assert loader.load(spark, str(tmp_path / "c.xml")).nodes.count() == 3001


def test_xml_is_rdf_by_its_first_element(spark, tmp_path):
    head = "<?xml version='1.0'?><!--" + "x" * 5000 + "-->"
    (tmp_path / "a.xml").write_text(f'{head}<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="http://e/"><e:T rdf:about="http://e/a"/></rdf:RDF>')
    (tmp_path / "b.xml").write_text(f'<data><p about="{RDF}"/></data>')
    assert {r["type"] for r in loader.load(spark, str(tmp_path / "a.xml")).types.collect()} == {"http://e/T"}
    assert loader.load(spark, str(tmp_path / "b.xml")).types.count() == 2


def test_several_files_keep_their_order(spark, tmp_path):
    for i in (2, 1, 3):
        (tmp_path / f"{i}.ttl").write_text(f'<http://e/a> <http://e/p> "v{i}" .')
    t = loader.read_triples(spark, str(tmp_path / "*.ttl"), "ttl")
    assert [r["obj"] for r in t.orderBy("seq").collect()] == ["v1", "v2", "v3"] and t.select("seq").distinct().count() == 3


def test_lists(spark):
    edges = [("h", "p", "c1", 7), ("c1", RDF_REST, "c2", 0), ("c2", RDF_REST, "c3", 0), ("c3", RDF_REST, RDF_NIL, 0), ("c1", RDF_FIRST, "x", 0), ("c3", RDF_FIRST, "y", 0)]
    props = [("c2", RDF_FIRST, "lit", "plain", None, None, 2, 0)]
    g = ingest.resolve_lists(empty_graph(spark).with_(edges=spark.createDataFrame(edges, EDGES), properties=spark.createDataFrame(props, PROPERTIES)))
    assert [(r["dst"], r["seq"]) for r in g.edges.where("src = 'h'").orderBy("seq").collect()] == [("x", 7), ("y", 9)]
    assert [(r["value"], r["seq"]) for r in g.properties.where("iri = 'h'").collect()] == [("lit", 8)]


def test_project_round_trip_and_csv(spark, tmp_path):
    g = Graph(
        spark.createDataFrame([("a", False, True, 0), ("b", False, False, 1)], NODES), spark.createDataFrame([("a", "T", 0)], NODE_TYPES),
        spark.createDataFrame([("a", "name", "x", "plain", None, None, 2, 0)], PROPERTIES), spark.createDataFrame([("a", "p", "b", 0)], EDGES),
    )
    sinks.store(g, str(tmp_path / "x.project"), Prefixes({"q": "http://q/"}), g.nodes)
    back = loader.load(spark, str(tmp_path / "x.project"))
    for n in ("nodes", "types", "properties", "edges"):
        assert getattr(back, n).exceptAll(getattr(g, n)).count() == 0 == getattr(g, n).exceptAll(getattr(back, n)).count()
    assert sinks.restore_prefixes(spark, str(tmp_path / "x.project")).bases["q"] == "http://q/"
    sinks.write_csv(g.properties.select("iri", "value", F.col("value").alias("value")), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["iri", "value", "value_2"]
    v = View(g, g.nodes.select("iri"))
    drawing = sinks.svg(v, layout.circular(v.nodes, v.edges()))
    assert drawing.count("<circle") == 2 and drawing.count("marker-end") == 1
    assert sinks.Settings.loads(sinks.Settings(last_files=["f"]).dumps()).last_files == ["f"]
    assert g.union(g).edges.count() == 2 and g.union(g).nodes.count() == 2


def test_display_modes(spark):
    names = spark.createDataFrame([("http://ex.org/x#ClassFoo",), ("ex:pred",)], "type string")
    known = spark.createDataFrame([("ex:pred", "mypred")], "iri string, label string")
    show = lambda mode: [r["display"] for r in labels.display(names, "type", mode, known).orderBy("type").collect()]
    assert show("label") == ["mypred", "http://ex.org/x#ClassFoo"] and show("shorten") == ["pred", "ClassFoo"] and show("label_or_shorten") == ["mypred", "ClassFoo"]


def test_scalars(spark):
    assert scalars.slugify("Größe & Name.csv") == "grosse-name-csv"
    assert scalars.percent_encode("a b/é") == "a%20b%2F%C3%A9" and scalars.base62(61) == "z" and scalars.form_encode({"a": "b c"}) == "a=b+c"
    assert len({scalars.distinct_colour(i) for i in range(20)}) == 20
    row = spark.range(1).select(scalars.smooth_invert(F.lit(0.5)).alias("s"), scalars.lerp(F.lit(0.5), 10, 20).alias("l"), scalars.level(F.lit(1.0)).alias("v"), scalars.fixed(F.lit(1.23456)).alias("f")).first()
    assert tuple(row) == (0.5, 15.0, 10, "1.2346")


def test_force_keeps_locked_nodes(spark):
    nodes, edges = graph(spark, 4, [(0, 1), (1, 2)])
    start = nodes.select("iri", F.col("iri").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), (F.col("iri") == "0").alias("locked"))
    end = {r["iri"]: r for r in layout.force_step(start, edges, 50.0).collect()}
    assert (end["0"]["x"], end["0"]["y"]) == (0.0, 0.0) and end["3"]["x"] > 3.0
    for kind in (layout.Layout.HORIZONTAL, layout.Layout.HIERARCHICAL, layout.Layout.SPECTRAL):
        assert layout.arrange(kind, nodes, edges).count() == 4


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text("<http://e/a> <http://e/p> <http://e/b> .\n")
    follow_ntriples(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in" / "b.nt").write_text("<http://e/c> <http://e/p> <http://e/b> .\n")
    follow_ntriples(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sinks.restore(spark, str(tmp_path / "out")).edges.count() == 2
