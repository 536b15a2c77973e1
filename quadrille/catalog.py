"""The queries that show each operator over the test tables, each beside the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.prefixes import Prefixes
from .functions.scalars import min_max, short_iri, to_double, to_long, value_type
from .model import DOUBLE, RDF_FIRST, RDF_NIL, RDF_REST, RDF_TYPE, Graph
from .operators import community, filters, ingest, labels, profile, resolver, scores, traverse
from .operators.filters import FilterKind, PredicateFilter
from .operators.table import TypeTable, degree_counts
from .operators.view import View, auto_start, describe
from .plans import visual_query as vq
from .plans.visual_query import TableQuery, VisualQuery
from .sources import sinks
from .sources.relational import lift
from .streaming.ingest import event_counts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- pieces of SQL ---------------------------------------------------------------------------

D2 = "CAST(CAST({} AS DECIMAL(18,2)) AS VARCHAR)".format
C, O, N, R, S = ("'tpch:{}/' || {}".format(t, k) for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("nation", "n_nationkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey")))
LI = "'tpch:lineitem/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d')"


def customers(where: str, select: str = f"{C} AS iri") -> str:
    return f"SELECT {select} FROM customer WHERE {where}"


# --- visual queries ----------------------------------------------------------------------------


@_query(
    f"SELECT {O} AS t0, {D2('o_totalprice')} AS t0_o_totalprice, {C} AS t1, c_name AS t1_c_name, {N} AS t2, n_name AS t2_n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
    f"WHERE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) > 100000 AND c_mktsegment = 'BUILDING'"
)
def vq_chain(spark, sf):
    """Orders of some customers with their nations: three tables, two filters. [J-01, J-07, F-02, F-06]"""
    nation = TableQuery("tpch:Nation", ("tpch:n_name",))
    customer = TableQuery("tpch:Customer", ("tpch:c_name",), (PredicateFilter("tpch:c_mktsegment", FilterKind.EQUALS, "BUILDING"),)).link("tpch:nation", nation)
    order = TableQuery("tpch:Order", ("tpch:o_totalprice",), (PredicateFilter("tpch:o_totalprice", FilterKind.GREATER, "100000"),)).link("tpch:customer", customer)
    return vq.run(lift(spark, sf, "orders", "customer", "nation"), order)


@_query(f"SELECT {N} AS t0, n_name AS t0_n_name, {C} AS t1, {D2('c_acctbal')} AS t1_c_acctbal FROM nation JOIN customer ON c_nationkey = n_nationkey")
def vq_reverse(spark, sf):
    """A link against its direction. [J-02]"""
    q = TableQuery("tpch:Nation", ("tpch:n_name",)).link("tpch:nation", TableQuery("tpch:Customer", ("tpch:c_acctbal",)), incoming=True)
    return vq.run(lift(spark, sf, "customer", "nation"), q)


@_query(f"SELECT {O} AS t0, {C} AS t1, {LI} AS t2, {D2('l_quantity')} AS t2_l_quantity FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def vq_branch(spark, sf):
    """Two links of one table. [J-03, J-04]"""
    items = TableQuery("tpch:Lineitem", ("tpch:l_quantity",), (PredicateFilter("tpch:l_returnflag", FilterKind.EQUALS, "R"),))
    q = TableQuery("tpch:Order").link("tpch:customer", TableQuery("tpch:Customer")).link("tpch:order", items, incoming=True)
    return vq.run(lift(spark, sf, "orders", "customer", "lineitem"), q)


@_query(f"SELECT {N} AS t0, {C} AS t1, {S} AS t2 FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_acctbal < -900")
def vq_enforced(spark, sf):
    """Children held to their types, where two kinds of node use one predicate. [J-03, Q5]"""
    poor = TableQuery("tpch:Customer", (), (PredicateFilter("tpch:c_acctbal", FilterKind.LESS, "-900"),))
    q = TableQuery("tpch:Nation").link("tpch:nation", poor, True).link("tpch:nation", TableQuery("tpch:Supplier"), True)
    return vq.run(lift(spark, sf, "nation", "customer", "supplier"), q, enforce_types=True)


def _filter(name: str, sql: str, *tests: PredicateFilter) -> None:
    def run(spark, sf):
        return vq.run(lift(spark, sf, "customer"), TableQuery("tpch:Customer", ("tpch:c_name",), tests))

    run.__name__ = f"vq_filter_{name}"
    _query(customers(sql, f"{C} AS t0, c_name AS t0_c_name"))(run)


_filter("contains", "contains(c_name, '1')", PredicateFilter("tpch:c_name", FilterKind.CONTAINS, "1"))
_filter("equals", "c_mktsegment = 'MACHINERY'", PredicateFilter("tpch:c_mktsegment", FilterKind.EQUALS, "MACHINERY"))
_filter("equals_no_case", "lower(c_mktsegment) = 'machinery'", PredicateFilter("tpch:c_mktsegment", FilterKind.EQUALS_NO_CASE, "mAchinery"))
_filter("starts_with", "starts_with(c_mktsegment, 'BUI')", PredicateFilter("tpch:c_mktsegment", FilterKind.STARTS_WITH, "BUI"))
_filter("ends_with", "ends_with(c_name, '7')", PredicateFilter("tpch:c_name", FilterKind.ENDS_WITH, "7"))
_filter("greater", "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) > 5000.5", PredicateFilter("tpch:c_acctbal", FilterKind.GREATER, "5000.5"))
_filter("less", "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) < 0 AND c_mktsegment <= 'FURNITURE'", PredicateFilter("tpch:c_acctbal", FilterKind.LESS, "0"), PredicateFilter("tpch:c_mktsegment", FilterKind.LESS, "FURNITURE"))
_filter("exists", "TRUE", PredicateFilter("tpch:c_acctbal", FilterKind.EXISTS))


def _labelled(spark, sf) -> Graph:
    """Documents with their labels' values as properties of the document: most have none."""
    g = lift(spark, sf, "documents")
    marks = spark.read.parquet(f"{sf}/labels.parquet").select(
        F.concat(F.lit("tpch:documents/"), F.col("doc_id").cast("string")).alias("iri"), F.lit("tpch:quality").alias("pred"), F.col("quality").cast("string").alias("value"),
        F.lit("typed").alias("kind"), F.lit(None).cast("string").alias("lang"), F.lit("xsd:integer").alias("datatype"), F.lit(8).alias("value_type"), F.lit(0).cast("long").alias("seq"),
    )
    return g.with_(properties=g.properties.unionByName(marks))


@_query("SELECT 'tpch:documents/' || doc_id AS t0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def vq_filter_not_exists(spark, sf):
    """[F-09]"""
    return vq.run(_labelled(spark, sf), TableQuery("tpch:Document", (), (PredicateFilter("tpch:quality", FilterKind.NOT_EXISTS),)))


def _multi(spark, sf) -> Graph:
    """Orders with the return flags of all their items as values of one property."""
    g = lift(spark, sf, "orders")
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.concat(F.lit("tpch:orders/"), F.col("l_orderkey").cast("string")).alias("iri"), F.lit("tpch:flag").alias("pred"), F.col("l_returnflag").alias("value"),
        F.lit("plain").alias("kind"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("datatype"), F.lit(2).alias("value_type"), F.col("l_linenumber").cast("long").alias("seq"),
    )
    return g.with_(properties=g.properties.unionByName(items))


@_query("SELECT 'tpch:orders/' || l_orderkey AS t0 FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_returnflag = 'N')")
def vq_multivalue_all(spark, sf):
    """All values must pass. [Q4]"""
    return vq.run(_multi(spark, sf), TableQuery("tpch:Order", (), (PredicateFilter("tpch:flag", FilterKind.EQUALS, "N"),)))


@_query(f"SELECT {C} AS t0, {D2('c_acctbal')} AS t0_c_acctbal, {N} AS t1 FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY CAST(c_acctbal AS DECIMAL(18,2)) DESC, t0, t1 LIMIT 25")
def vq_sort_top(spark, sf):
    """[O-04, O-16]"""
    q = TableQuery("tpch:Customer", ("tpch:c_acctbal",)).link("tpch:nation", TableQuery("tpch:Nation"))
    return vq.run(lift(spark, sf, "customer", "nation"), VisualQuery(q).sort(0, "tpch:c_acctbal", False, DOUBLE)).limit(25)


@_query(
    "SELECT count(*) AS count, CAST(0 AS BIGINT) AS missing, min(v) AS min, max(v) AS max, count(v) AS numbers, round(avg(v), 4) AS avg, round(sum(v), 2) AS sum "
    "FROM (SELECT CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS v FROM orders JOIN customer ON o_custkey = c_custkey)"
)
def vq_stats(spark, sf):
    """Numbers of a query's column, once for each row. [A-17, A-19]"""
    q = TableQuery("tpch:Order").link("tpch:customer", TableQuery("tpch:Customer"))
    s = vq.column_statistics(lift(spark, sf, "orders", "customer"), q, 1, "tpch:c_acctbal")
    return s.select("count", "missing", "min", "max", "numbers", F.round("avg", 4).alias("avg"), F.round("sum", 2).alias("sum"))


@_query("SELECT * FROM (VALUES ('tpch:nation', false, 'tpch:Nation'), ('tpch:customer', true, 'tpch:Order')) AS t(pred, incoming, target)")
def vq_candidates(spark, sf):
    """[J-06]"""
    return vq.candidates(lift(spark, sf, "orders", "customer", "nation"), "tpch:Customer")


# --- profile -------------------------------------------------------------------------------------


@_query(
    "SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS nodes, CAST(0 AS BIGINT) AS unresolved, CAST(0 AS BIGINT) AS blank_nodes, "
    "4 * (SELECT count(*) FROM orders) + 3 * (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS properties, CAST(0 AS BIGINT) AS languages, CAST(2 AS BIGINT) AS datatypes, "
    "(SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS \"references\", CAST(11 AS BIGINT) AS unique_predicates, CAST(3 AS BIGINT) AS unique_types, "
    "(SELECT count(*) FROM nation) AS min_instances, (SELECT count(*) FROM orders) AS max_instances"
)
def prof_totals(spark, sf):
    """[A-01..A-07]"""
    return profile.totals(lift(spark, sf, "orders", "customer", "nation"))


@_query("SELECT 'tpch:Customer' AS type, count(*) AS instances FROM customer UNION ALL SELECT 'tpch:Order', count(*) FROM orders UNION ALL SELECT 'tpch:Document', count(*) FROM documents")
def prof_types(spark, sf):
    """[A-06, O-09]"""
    return profile.instances_per_type(lift(spark, sf, "customer", "orders", "documents"))


@_query(
    "SELECT 'tpch:Document' AS type, p AS pred, count(v) AS count, CASE WHEN count(v) < count(*) THEN 0 ELSE 1 END AS min_cardinality, CAST(1 AS BIGINT) AS max_cardinality, max(strlen(v)) AS max_len, bit_or(t) AS value_types FROM ("
    "SELECT 'tpch:text' AS p, text AS v, 4 AS t FROM documents UNION ALL SELECT 'tpch:source', source, CASE WHEN strlen(source) < 32 THEN 2 ELSE 1 END FROM documents "
    "UNION ALL SELECT 'tpch:n_chars', CAST(n_chars AS VARCHAR), 8 FROM documents UNION ALL SELECT 'tpch:quality', CAST(quality AS VARCHAR), CASE WHEN quality IS NULL THEN 0 ELSE 8 END FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY p"
)
def prof_properties(spark, sf):
    """[A-08..A-11, N-10, Q6, Q7]"""
    p = profile.property_profile(_labelled(spark, sf))
    return p.select("type", "pred", "count", F.col("min_cardinality").cast("int").alias("min_cardinality"), "max_cardinality", F.col("max_len").cast("long").alias("max_len"), "value_types")


@_query(
    "SELECT 'tpch:Nation' AS type, 'tpch:nation' AS pred, sum(n) AS count, max(n) AS max_cardinality, CAST(min(n) AS BIGINT) AS min_cardinality, 'tpch:Customer,tpch:Supplier' AS targets FROM "
    "(SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation)"
)
def prof_references_in(spark, sf):
    """[A-14..A-16]"""
    p = profile.reference_profile(lift(spark, sf, "nation", "customer", "supplier"), incoming=True).where("type = 'tpch:Nation'")
    return p.select("type", "pred", "count", "max_cardinality", F.col("min_cardinality").cast("long").alias("min_cardinality"), F.array_join("target_types", ",").alias("targets"))


@_query(
    "SELECT 'tpch:Lineitem' AS type, p AS pred, count(*) AS count, CAST(1 AS BIGINT) AS max_cardinality, CAST(1 AS BIGINT) AS min_cardinality, t AS targets FROM lineitem, (VALUES ('tpch:order', 'tpch:Order'), ('tpch:part', 'tpch:Part'), ('tpch:supplier', 'tpch:Supplier')) AS x(p, t) GROUP BY p, t"
)
def prof_references_out(spark, sf):
    """[A-13, A-15, A-16]"""
    p = profile.reference_profile(lift(spark, sf, "lineitem", "orders", "part", "supplier")).where("type = 'tpch:Lineitem'")
    return p.select("type", "pred", "count", "max_cardinality", F.col("min_cardinality").cast("long").alias("min_cardinality"), F.array_join("target_types", ",").alias("targets"))


_META = (
    "SELECT 'tpch:Customer' AS type, 'tpch:nation' AS pred, 'tpch:Nation' AS target, count(*) AS n FROM customer UNION ALL SELECT 'tpch:Supplier', 'tpch:nation', 'tpch:Nation', count(*) FROM supplier "
    "UNION ALL SELECT 'tpch:Nation', 'tpch:region', 'tpch:Region', count(*) FROM nation UNION ALL SELECT 'tpch:Order', 'tpch:customer', 'tpch:Customer', count(*) FROM orders"
)


def _five(spark, sf) -> Graph:
    return lift(spark, sf, "orders", "customer", "supplier", "nation", "region")


@_query(_META)
def meta_graph(spark, sf):
    """[A-20]"""
    return profile.meta_graph(_five(spark, sf))


@_query(
    f"WITH k AS (SELECT 'tpch:Customer' AS t, count(*) AS c FROM customer UNION ALL SELECT 'tpch:Order', count(*) FROM orders UNION ALL SELECT 'tpch:Nation', count(*) FROM nation UNION ALL SELECT 'tpch:Region', count(*) FROM region), "
    f"b AS (SELECT t FROM k WHERE c > (SELECT count(*) FROM supplier)) SELECT * FROM ({_META}) WHERE type IN (SELECT t FROM b) AND target IN (SELECT t FROM b)"
)
def meta_hide_rare(spark, sf):
    """[G-34]"""
    g = _five(spark, sf)
    return profile.meta_hide_rare(g, profile.meta_graph(g), "tpch:Supplier").select("type", "pred", "target", "n")


@_query("SELECT * FROM (VALUES ('tpch:Customer'), ('tpch:Supplier'), ('tpch:Region')) AS t(type)")
def meta_expand(spark, sf):
    """[G-35]"""
    return profile.meta_expand(profile.meta_graph(_five(spark, sf)), "tpch:Nation")


@_query(f"SELECT * FROM ({_META}) WHERE type NOT IN ('tpch:Order') AND target NOT IN ('tpch:Order')")
def meta_hide(spark, sf):
    """[G-33]"""
    return profile.meta_hide(profile.meta_graph(_five(spark, sf)), ["tpch:Order"])


@_query("SELECT 'tpch:Customer' AS type, CAST(3 AS BIGINT) AS data_properties UNION ALL SELECT 'tpch:Nation', 1")
def prof_data_properties(spark, sf):
    """[A-12]"""
    return profile.data_properties_per_type(lift(spark, sf, "customer", "nation"))


@_query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def prof_top_values(spark, sf):
    """[A-18, O-11]"""
    g = lift(spark, sf, "customer")
    return profile.top_values(g.properties.where("pred = 'tpch:c_mktsegment'"))


@_query(
    "SELECT 'property' AS part, p AS pred, count(*) AS count, max(strlen(v)) AS max_len, '' AS targets FROM (SELECT 'tpch:c_name' AS p, c_name AS v FROM customer UNION ALL SELECT 'tpch:c_mktsegment', c_mktsegment FROM customer "
    f"UNION ALL SELECT 'tpch:c_acctbal', {D2('c_acctbal')} FROM customer) GROUP BY p UNION ALL SELECT 'out', 'tpch:nation', count(*), NULL, 'tpch:Nation' FROM customer UNION ALL SELECT 'in', 'tpch:customer', count(*), NULL, 'tpch:Order' FROM orders"
)
def prof_type_grid(spark, sf):
    """[P-18]"""
    g = profile.type_grid(lift(spark, sf, "customer", "nation", "orders"), "tpch:Customer")
    return g.select("part", "pred", "count", F.col("max_len").cast("long").alias("max_len"), F.coalesce("targets", F.lit("")).alias("targets"))


# --- type tables -----------------------------------------------------------------------------------


@_query(customers(f"contains(c_name, '77') OR contains({D2('c_acctbal')}, '77') OR contains(c_mktsegment, '77') OR contains({C}, '77')"))
def tab_text_filter(spark, sf):
    """[F-11]"""
    return TypeTable(lift(spark, sf, "customer"), "tpch:Customer").contains("77").rows().select("iri")


@_query("SELECT 'tpch:documents/' || doc_id AS iri FROM documents JOIN labels USING (doc_id)")
def tab_exists(spark, sf):
    """[F-13]"""
    return TypeTable(_labelled(spark, sf), "tpch:Document").having("tpch:quality")._all()


@_query("SELECT 'tpch:documents/' || doc_id AS iri FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def tab_not_exists(spark, sf):
    """[F-14]"""
    return TypeTable(_labelled(spark, sf), "tpch:Document").lacking("tpch:quality")._all()


@_query("SELECT 'tpch:orders/' || l_orderkey AS iri FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def tab_multi_value(spark, sf):
    """[F-15]"""
    return TypeTable(_multi(spark, sf), "tpch:Order").multiple("tpch:flag")._all()


@_query(f"SELECT {C} AS iri, CAST(n AS BIGINT) AS n_in, CAST(1 AS BIGINT) AS n_out, c_name AS \"tpch:c_name\", {D2('c_acctbal')} AS \"tpch:c_acctbal\" FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def tab_pivot(spark, sf):
    """[P-11, K-01]"""
    t = TypeTable(lift(spark, sf, "customer", "orders"), "tpch:Customer").show("tpch:c_name", "tpch:c_acctbal")
    return t.rows().where("n_in > 0")


@_query(f"SELECT {C} AS iri FROM customer ORDER BY c_mktsegment DESC, CAST(c_acctbal AS DECIMAL(18,2)), iri LIMIT 40 OFFSET 10")
def tab_sort_page(spark, sf):
    """Two stable sorts, then a page. [O-01, O-03, O-16]"""
    t = TypeTable(lift(spark, sf, "customer"), "tpch:Customer").show("tpch:c_name").sort("tpch:c_acctbal", True, DOUBLE).sort("tpch:c_mktsegment", False)
    return t.page(10, 40).select("iri")


@_query("SELECT 'tpch:documents/' || doc_id AS iri, CAST(quality AS VARCHAR) AS \"tpch:quality\" FROM documents LEFT JOIN labels USING (doc_id) ORDER BY coalesce(quality, 0) DESC, iri LIMIT 30")
def tab_sort_integer(spark, sf):
    """Missing numbers sort as 0. [O-02]"""
    t = TypeTable(_labelled(spark, sf), "tpch:Document").show("tpch:quality").sort("tpch:quality", False)
    return t.rows().select("iri", F.col("`tpch:quality`")).limit(30)


@_query(f"SELECT {N} AS iri, count(*) + 1 AS refs FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey ORDER BY refs DESC, iri LIMIT 7")
def tab_sort_references(spark, sf):
    """[O-06, Q14]"""
    t = TypeTable(lift(spark, sf, "nation", "customer"), "tpch:Nation").show("tpch:n_name").sort("references", False)
    return t.rows().select("iri", (F.col("n_out") + F.col("n_in")).alias("refs")).limit(7)


@_query("SELECT 'tpch:Customer' AS type, 'Customer' AS display")
def types_filter(spark, sf):
    """[F-12, P-08, P-14]"""
    g = lift(spark, sf, "customer", "nation", "region")
    return filters.types_filter(labels.display(g.types.select("type").distinct(), "type", "shorten"), "CUST")


# --- languages and names -------------------------------------------------------------------------


@_query("SELECT 'tpch:documents/' || doc_id AS iri FROM documents WHERE lang IN ('en', 'de')")
def lang_filter(spark, sf):
    """[N-05]"""
    g = lift(spark, sf, "documents")
    return ingest.language_filter(g.properties.where("pred = 'tpch:text'"), ["en", "de"]).select("iri")


@_query("SELECT 'tpch:documents/' || doc_id AS iri, md5(text) AS m FROM documents WHERE lang IN ('de', 'en')")
def lang_fallback(spark, sf):
    """The wanted language, else English. [P-01]"""
    return labels.get_property(lift(spark, sf, "documents").properties.where("pred = 'tpch:text'"), "de").where("value is not null").select("iri", F.md5("value").alias("m"))




def _by_source(spark, sf) -> DataFrame:
    """A node for each source, with the texts of its documents in several languages."""
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        F.concat(F.lit("src/"), "source").alias("iri"), F.lit("p").alias("pred"), F.md5("text").alias("value"), F.lit("lang").alias("kind"),
        F.when(F.col("lang") != "es", F.col("lang")).alias("lang"), F.lit(None).cast("string").alias("datatype"), F.lit(4).alias("value_type"), F.col("doc_id").alias("seq"),
    )


@_query("SELECT 'src/' || source AS iri, coalesce(arg_min(md5(text), doc_id) FILTER (lang = 'de'), arg_max(md5(text), doc_id) FILTER (lang = 'en'), arg_max(md5(text), doc_id) FILTER (lang = 'es')) AS value FROM documents GROUP BY source")
def lang_first_last(spark, sf):
    """First of the wanted language, last English, last untagged. [P-01, W-04]"""
    return labels.get_property(_by_source(spark, sf), "de").select("iri", "value")


@_query("SELECT 'src/' || source AS iri, coalesce(arg_min(md5(text), doc_id) FILTER (lang = 'fr'), arg_min(md5(text), doc_id) FILTER (lang = 'en'), arg_min(md5(text), doc_id) FILTER (lang = 'es')) AS value, count(*) AS n FROM documents GROUP BY source")
def lang_count(spark, sf):
    """[P-02]"""
    return labels.get_property_count(_by_source(spark, sf), "fr").select("iri", "value", "n")


@_query("SELECT 'src/' || source AS iri, doc_id AS seq FROM documents d WHERE lang IN ('de', 'es') OR (lang = 'en' AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.source = d.source AND o.lang = 'de'))")
def lang_suppress(spark, sf):
    """[P-15]"""
    return labels.suppress_languages(_by_source(spark, sf), "de").select("iri", "seq")


@_query("SELECT DISTINCT lang FROM documents")
def lang_list(spark, sf):
    """[N-14]"""
    return labels.languages(lift(spark, sf, "documents"))


@_query(
    "SELECT page_id, url, CASE WHEN contains(url, '#') THEN regexp_extract(url, '#([^#]*)$', 1) WHEN contains(url, '/') THEN regexp_extract(url, '/([^/]*)$', 1) ELSE url END AS short FROM pages"
)
def iri_short(spark, sf):
    """[P-14]"""
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", short_iri(F.col("url")).alias("short"))


@_query("SELECT page_id, 'dbr:' || page_id || '/x' AS two, 'foaf:p' || page_id AS one, 'http://unknown.example/' || page_id AS none, CAST(NULL AS VARCHAR) AS opt, 'http://xmlns.com/foaf/0.1/p' || page_id AS whole FROM pages")
def iri_prefixed(spark, sf):
    """[N-07, N-08]"""
    p, i = Prefixes(), F.col("page_id").cast("string")
    two, one, none = F.concat(F.lit("http://dbpedia.org/resource/"), i, F.lit("/x")), F.concat(F.lit("http://xmlns.com/foaf/0.1/p"), i), F.concat(F.lit("http://unknown.example/"), i)
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", p.compact(two).alias("two"), p.compact(one).alias("one"), p.compact(none).alias("none"), p.compact_or_null(two).alias("opt"), p.expand(p.compact(one)).alias("whole"))


@_query(f"SELECT {N} AS iri, n_name AS label FROM nation UNION ALL SELECT {R}, r_name FROM region")
def node_labels(spark, sf):
    """Nothing is called rdfs:label here, so a property with name in it serves. [P-03, P-04]"""
    return labels.node_labels(lift(spark, sf, "nation", "region"))


@_query(
    "SELECT type, CAST(row_number() OVER (ORDER BY n DESC, type) - 1 AS INTEGER) AS priority FROM (SELECT 'tpch:Region' AS type, count(*) AS n FROM region UNION ALL SELECT 'tpch:Nation', count(*) FROM nation "
    "UNION ALL SELECT 'tpch:Customer', count(*) FROM customer UNION ALL SELECT 'tpch:Order', count(*) FROM orders)"
)
def type_priority(spark, sf):
    """[P-05, W-05]"""
    return labels.type_priority(lift(spark, sf, "orders", "customer", "nation", "region"))


@_query(
    "SELECT event_id, CAST(CASE WHEN regexp_matches(t, '^[+-]?[0-9]+$') THEN TRY_CAST(t AS BIGINT) ELSE 0 END AS BIGINT) AS whole, coalesce(TRY_CAST(t AS DOUBLE), 0.0) AS number, strlen(t) AS bytes FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN CAST(event_id AS VARCHAR) ELSE CAST(event_id AS VARCHAR) || '.25' END AS t FROM events)"
)
def scalar_parse(spark, sf):
    """[X-04, X-05]"""
    i = F.col("event_id")
    t = F.when(i % 3 == 0, F.col("event_type")).when(i % 3 == 1, i.cast("string")).otherwise(F.concat(i.cast("string"), F.lit(".25")))
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("t", t).select("event_id", to_long(F.col("t")).alias("whole"), to_double(F.col("t")).alias("number"), F.octet_length("t").cast("long").alias("bytes"))


# --- resolver --------------------------------------------------------------------------------------


def _keys(spark, sf) -> Graph:
    """Customers and orders whose keys are plain strings."""
    def plain(df, iri, type_, **cols):
        cells = F.inline(F.array(*[F.struct(F.lit(p).alias("pred"), F.col(c).cast("string").alias("value"), F.lit(i).cast("long").alias("seq")) for i, (p, c) in enumerate(cols.items())]))
        null = F.lit(None).cast("string")
        props = df.select(iri.alias("iri"), cells).select("iri", "pred", "value", F.lit("plain").alias("kind"), null.alias("lang"), null.alias("datatype"), value_type(F.col("value"), null, null).alias("value_type"), "seq")
        return props, df.select(iri.alias("iri"), F.lit(type_).alias("type"), F.lit(0).cast("long").alias("type_seq"))

    c, o = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "orders"))
    cp, ct = plain(c, F.concat(F.lit("c/"), F.col("c_custkey").cast("string")), "C", custkey="c_custkey", nation="c_nationkey")
    op, ot = plain(o, F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")), "O", orderkey="o_orderkey", custkey="o_custkey")
    base = lift(spark, sf, "region")
    return base.with_(properties=cp.unionByName(op), types=ct.unionByName(ot), edges=base.edges)


@_query(
    "WITH v AS (SELECT 'C' AS t, 'custkey' AS p, CAST(c_custkey AS VARCHAR) AS x FROM customer UNION ALL SELECT 'C', 'nation', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT 'O', 'orderkey', CAST(o_orderkey AS VARCHAR) FROM orders UNION ALL SELECT 'O', 'custkey', CAST(o_custkey AS VARCHAR) FROM orders), "
    "s AS (SELECT t, p, count(*) AS n, count(DISTINCT x) AS d FROM v GROUP BY t, p), "
    "m AS (SELECT f.t AS from_type, f.p AS from_pred, k.t AS to_type, k.p AS to_pred, k.d - f.d AS gap FROM s f, s k WHERE f.n <> f.d AND k.n = k.d AND NOT EXISTS (SELECT 1 FROM v a WHERE a.t = f.t AND a.p = f.p AND a.x NOT IN (SELECT x FROM v b WHERE b.t = k.t AND b.p = k.p))) "
    "SELECT from_type, from_pred, to_type, to_pred FROM m QUALIFY row_number() OVER (PARTITION BY from_type, from_pred ORDER BY gap, to_type, to_pred) = 1"
)
def resolver_discover(spark, sf):
    """[J-09, U-04]"""
    return resolver.discover_references(_keys(spark, sf))


@_query("SELECT 'o/' || o_orderkey AS src, 'placed_by' AS pred, 'c/' || c_custkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey")
def resolver_link(spark, sf):
    """[J-08]"""
    return resolver.resolve_references(_keys(spark, sf), "O", "custkey", "C", "custkey", "placed_by").select("src", "pred", "dst")


# --- views -----------------------------------------------------------------------------------------

_E = (
    f"e AS (SELECT {N} AS src, 'tpch:region' AS pred, 'tpch:region/' || n_regionkey AS dst FROM nation UNION ALL SELECT {C}, 'tpch:nation', 'tpch:nation/' || c_nationkey FROM customer "
    f"UNION ALL SELECT {S}, 'tpch:nation', 'tpch:nation/' || s_nationkey FROM supplier), "
    f"n AS (SELECT {N} AS iri, 'tpch:Nation' AS type FROM nation UNION ALL SELECT {R}, 'tpch:Region' FROM region UNION ALL SELECT {C}, 'tpch:Customer' FROM customer UNION ALL SELECT {S}, 'tpch:Supplier' FROM supplier)"
)
_V = f"WITH {_E}, v AS (SELECT {N} AS iri FROM nation WHERE n_nationkey < 12 UNION ALL SELECT {R} FROM region UNION ALL SELECT {C} FROM customer WHERE c_acctbal < 0), ve AS (SELECT * FROM e WHERE src IN (SELECT iri FROM v) AND dst IN (SELECT iri FROM v)) "


def _view(spark, sf, hidden: tuple[str, ...] = ()) -> View:
    """Some nations, all regions, and customers in debt; edges to other nations are not seen."""
    g = lift(spark, sf, "nation", "region", "customer", "supplier")
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    iri = lambda t, c: F.concat(F.lit(f"tpch:{t}/"), F.col(c).cast("string")).alias("iri")
    nodes = read("nation").where("n_nationkey < 12").select(iri("nation", "n_nationkey")).unionByName(read("region").select(iri("region", "r_regionkey")))
    return View(g, nodes.unionByName(read("customer").where("c_acctbal < 0").select(iri("customer", "c_custkey"))), hidden)


def _some(spark, *iris: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in iris], "iri string")


@_query(_V + "SELECT src, pred, dst FROM ve")
def view_edges(spark, sf):
    """[J-11]"""
    return _view(spark, sf).edges().select("src", "pred", "dst")


@_query(_V + "SELECT iri FROM v UNION SELECT dst FROM e WHERE src IN (SELECT iri FROM v)")
def view_expand_out(spark, sf):
    """[G-03]"""
    v = _view(spark, sf)
    return v.expand(v.nodes, "out").nodes


@_query(_V + "SELECT iri FROM v UNION SELECT src FROM e WHERE dst = 'tpch:nation/3'")
def view_expand_in(spark, sf):
    """[G-03, G-06]"""
    return _view(spark, sf).expand(_some(spark, "tpch:nation/3"), "in", "tpch:nation").nodes


@_query(_V + "SELECT iri FROM v UNION SELECT dst FROM e WHERE src IN (SELECT iri FROM v) UNION SELECT src FROM e WHERE dst IN (SELECT iri FROM v)")
def view_expand_all(spark, sf):
    """[G-04]"""
    return _view(spark, sf).expand_all().nodes


@_query(_V + "SELECT iri FROM v UNION SELECT src FROM e JOIN n ON n.iri = src WHERE dst IN (SELECT iri FROM v) AND type = 'tpch:Supplier'")
def view_expand_types(spark, sf):
    """[G-05]"""
    return _view(spark, sf).expand_all(types=["tpch:Supplier"]).nodes


@_query(_V + "SELECT DISTINCT src AS iri FROM ve")
def view_remove_leaves(spark, sf):
    """[G-08]"""
    return _view(spark, sf).remove_leaves().nodes


@_query(_V + "SELECT iri FROM v JOIN n USING (iri) WHERE type <> 'tpch:Region'")
def view_hide_type(spark, sf):
    """[G-10, P-06]"""
    return _view(spark, sf).hide_types(["tpch:Region"]).nodes


@_query(_V + "SELECT iri FROM v WHERE iri = 'tpch:nation/2' OR iri IN (SELECT src FROM e WHERE dst = 'tpch:nation/2') OR iri IN (SELECT dst FROM e WHERE src = 'tpch:nation/2')")
def view_keep_related(spark, sf):
    """[G-12]"""
    return _view(spark, sf).keep_related(_some(spark, "tpch:nation/2")).nodes


@_query(
    _V.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", u AS (SELECT src AS a, dst AS b FROM ve UNION SELECT dst, src FROM ve), reach AS (SELECT 'tpch:region/1' AS iri UNION SELECT b FROM reach JOIN u ON a = reach.iri) SELECT iri FROM reach"
)
def view_keep_connected(spark, sf):
    """[G-13]"""
    return _view(spark, sf).keep_connected(_some(spark, "tpch:region/1")).nodes


@_query(_V + "SELECT iri FROM v WHERE iri IN (SELECT src FROM ve UNION SELECT dst FROM ve)")
def view_hide_orphans(spark, sf):
    """[G-14]"""
    return _view(spark, sf).hide_orphans().nodes


@_query(_V + "SELECT DISTINCT src AS iri FROM ve WHERE pred = 'tpch:nation' UNION SELECT dst FROM ve WHERE pred = 'tpch:nation'")
def view_hidden_predicate(spark, sf):
    """[F-18]"""
    return _view(spark, sf, ("tpch:region",)).hide_orphans().nodes


@_query("SELECT least('s/' || l_suppkey, 'p/' || l_partkey) AS a, greatest('s/' || l_suppkey, 'p/' || l_partkey) AS b FROM lineitem GROUP BY ALL")
def view_single_edges(spark, sf):
    """Suppliers and parts have many edges in common. [G-15, U-07]"""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    e = li.select(F.concat(F.lit("s/"), F.col("l_suppkey").cast("string")).alias("src"), F.lit("p").alias("pred"), F.concat(F.lit("p/"), F.col("l_partkey").cast("string")).alias("dst"), F.col("l_orderkey").alias("seq"))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("iri")).distinct()
    v = View(lift(spark, sf, "region").with_(edges=e), nodes).single_edges()
    return v.edges().select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))


@_query(_V + "SELECT a.src AS src, a.pred AS pred, b.dst AS dst FROM ve a JOIN ve b ON a.dst = b.src")
def view_contract(spark, sf):
    """Nations go, and customers are tied to regions. [G-17]"""
    v = _view(spark, sf)
    gone = v.nodes.where("iri like 'tpch:nation/%'")
    return v.contract(gone).edges().select("src", "pred", "dst")


@_query(_V + ", x AS (SELECT src AS iri, dst AS o FROM e UNION ALL SELECT dst, src FROM e) SELECT iri, count(*) AS n FROM x WHERE iri IN (SELECT iri FROM v) AND o NOT IN (SELECT iri FROM v) GROUP BY iri")
def view_hidden_references(spark, sf):
    """[G-32, Q13]"""
    return _view(spark, sf).hidden_references()


@_query(_V + "SELECT src AS iri, pred, count(*) AS total, count(*) FILTER (dst IN (SELECT iri FROM v)) AS visible FROM e WHERE src IN (SELECT iri FROM v) GROUP BY src, pred")
def view_reference_state(spark, sf):
    """[A-21]"""
    return _view(spark, sf).reference_state()


@_query(_V + "SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM ve) AS edges")
def view_counts(spark, sf):
    """[A-22]"""
    return _view(spark, sf).counts()


_SEL = "s AS (SELECT iri FROM v WHERE iri LIKE 'tpch:region/%' OR iri LIKE 'tpch:nation/1%')"


def _selected(v: View) -> DataFrame:
    return v.nodes.where("iri like 'tpch:region/%' or iri like 'tpch:nation/1%'")


@_query(_V + f", {_SEL} SELECT iri FROM v WHERE iri NOT IN (SELECT iri FROM s)")
def sel_invert(spark, sf):
    """[G-22]"""
    v = _view(spark, sf)
    return v.invert(_selected(v))


@_query(_V + f", {_SEL} SELECT iri FROM s UNION SELECT dst FROM ve WHERE src IN (SELECT iri FROM s) UNION SELECT src FROM ve WHERE dst IN (SELECT iri FROM s)")
def sel_grow(spark, sf):
    """[G-23]"""
    v = _view(spark, sf)
    return v.grow_selection(_selected(v))


@_query(_V + f", {_SEL}, x AS (SELECT src, dst FROM ve WHERE src IN (SELECT iri FROM s) AND dst IN (SELECT iri FROM s)) SELECT iri FROM (SELECT src AS iri FROM x UNION ALL SELECT dst FROM x) GROUP BY iri HAVING count(*) > 1")
def sel_shrink(spark, sf):
    """[G-24]"""
    v = _view(spark, sf)
    return v.shrink_selection(_selected(v))


@_query(
    f"WITH {_E}, d AS (SELECT iri, count(*) AS n FROM (SELECT src AS iri FROM e UNION ALL SELECT dst FROM e) GROUP BY iri), u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), "
    "s0 AS (SELECT iri FROM d ORDER BY n DESC, iri LIMIT 1), s1 AS (SELECT iri FROM s0 UNION SELECT * FROM (SELECT d.iri FROM d WHERE d.iri IN (SELECT b FROM u WHERE a IN (SELECT iri FROM s0)) AND d.iri NOT IN (SELECT iri FROM s0) ORDER BY n DESC, iri LIMIT 5)), "
    "s2 AS (SELECT iri FROM s1 UNION SELECT * FROM (SELECT d.iri FROM d WHERE d.iri IN (SELECT b FROM u WHERE a IN (SELECT iri FROM s1)) AND d.iri NOT IN (SELECT iri FROM s1) ORDER BY n DESC, iri LIMIT 20)) SELECT iri FROM s2"
)
def view_auto_start(spark, sf):
    """[G-07, O-12, O-13]"""
    return auto_start(_view(spark, sf).graph).nodes


@_query("SELECT 'tpch:customer/' || c_custkey AS iri FROM customer WHERE c_nationkey = 4")
def ref_filter(spark, sf):
    """What a node refers to, as a type table; here nations to their customers. [F-16]"""
    g = lift(spark, sf, "nation", "customer")
    back = g.edges.select(F.col("dst").alias("src"), "pred", F.col("src").alias("dst"), "seq")
    return filters.reference_filter(g.with_(edges=back), "tpch:nation/4", "tpch:nation", "tpch:Customer").select("iri")


@_query(_V + "SELECT src, pred, dst AS value FROM e WHERE src = 'tpch:nation/1' OR dst = 'tpch:nation/1' UNION ALL SELECT 'tpch:nation/1', 'tpch:n_name', n_name FROM nation WHERE n_nationkey = 1 ORDER BY 1, 2, 3 LIMIT 500")
def node_describe(spark, sf):
    """[S-13, O-15]"""
    return describe(_view(spark, sf).graph, "tpch:nation/1").select("src", "pred", "value")


# --- analytics ---------------------------------------------------------------------------------------

_ENDS = "x AS (SELECT src AS a, dst AS b FROM ve UNION ALL SELECT dst, src FROM ve)"


@_query(_V + f", {_ENDS} SELECT iri, CAST(count(b) AS DOUBLE) AS value FROM v LEFT JOIN x ON a = iri GROUP BY iri")
def g_degree(spark, sf):
    """[M-01]"""
    v = _view(spark, sf)
    return scores.degree(v.nodes, v.edges())


@_query(_V + f", {_ENDS}, d AS (SELECT iri, count(b) AS value FROM v LEFT JOIN x ON a = iri GROUP BY iri) SELECT iri, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 9) AS value FROM d")
def g_degree_scaled(spark, sf):
    """[M-07, X-11]"""
    v = _view(spark, sf)
    return min_max(scores.degree(v.nodes, v.edges()), "value").select("iri", F.round("value", 9).alias("value"))


def _page_rank_sql(rounds: int) -> str:
    parts = [_V, ", o AS (SELECT iri, count(dst) AS k FROM v LEFT JOIN ve ON src = iri GROUP BY iri), c AS (SELECT count(*) AS n FROM v), r0 AS (SELECT iri, 1.0::DOUBLE / n AS value FROM v, c)"]
    for i in range(rounds):
        parts.append(
            f", r{i + 1} AS (SELECT v.iri, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT coalesce(sum(value), 0) FROM r{i} JOIN o USING (iri) WHERE k = 0) / n) AS value FROM v CROSS JOIN c "
            f"LEFT JOIN (SELECT dst AS iri, sum(value / k) AS got FROM ve JOIN r{i} ON r{i}.iri = src JOIN o ON o.iri = src GROUP BY dst) g ON g.iri = v.iri)"
        )
    return "".join(parts) + f" SELECT iri, round(value, 9) AS value FROM r{rounds}"


@_query(_page_rank_sql(4))
def g_page_rank(spark, sf):
    """Four rounds; the SQL is these unrolled. [M-06]"""
    v = _view(spark, sf)
    return scores.page_rank(v.nodes, v.edges(), rounds=4).select("iri", F.round("value", 9).alias("value"))


def _eigen_sql(rounds: int) -> str:
    parts = [_V, f", {_ENDS}, r0 AS (SELECT iri, 1.0::DOUBLE AS value FROM v)"]
    for i in range(rounds):
        parts.append(f", g{i} AS (SELECT v.iri, coalesce(sum(r.value), 0) AS got FROM v LEFT JOIN x ON a = v.iri LEFT JOIN r{i} r ON r.iri = b GROUP BY v.iri), r{i + 1} AS (SELECT iri, got / (SELECT sqrt(sum(got * got)) FROM g{i}) AS value FROM g{i})")
    return "".join(parts) + f" SELECT iri, round(value, 9) AS value FROM r{rounds}"


@_query(_eigen_sql(4))
def g_eigenvector(spark, sf):
    """[M-05]"""
    v = _view(spark, sf)
    return scores.eigenvector(v.nodes, v.edges(), rounds=4).select("iri", F.round("value", 9).alias("value"))


_REACH = (
    _V.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", u AS (SELECT src AS a, dst AS b FROM ve UNION SELECT dst, src FROM ve), w AS (SELECT iri AS s, iri AS t, 0 AS d FROM v UNION SELECT s, b, d + 1 FROM w JOIN u ON a = t WHERE d < 6), m AS (SELECT s, t, min(d) AS d FROM w GROUP BY s, t) "
)


@_query(_REACH + "SELECT s AS iri, min(t) AS component FROM m GROUP BY s")
def g_components(spark, sf):
    """Components here have paths of at most four edges. [G-31]"""
    v = _view(spark, sf)
    return traverse.connected_components(v.nodes, v.edges())


@_query(_REACH + "SELECT t AS iri, d AS distance FROM m WHERE s = 'tpch:region/2'")
def g_bfs(spark, sf):
    """[M-10]"""
    v = _view(spark, sf)
    return traverse.bfs(v.edges(), _some(spark, "tpch:region/2"))


@_query(_REACH + "SELECT s AS iri, round(CASE WHEN sum(d) > 0 THEN (count(*) - 1) / sum(d)::DOUBLE ELSE 0 END, 9) AS value FROM m GROUP BY s")
def g_closeness(spark, sf):
    """[M-03]"""
    v = _view(spark, sf)
    return scores.closeness(v.nodes, v.edges()).select("iri", F.round("value", 9).alias("value"))


@_query(_REACH + "SELECT m1.t AS iri, m1.d AS step FROM m m1 JOIN m m2 ON m1.t = m2.t WHERE m1.s = 'tpch:nation/1' AND m2.s = 'tpch:region/1' AND m1.d + m2.d = (SELECT d FROM m WHERE s = 'tpch:nation/1' AND t = 'tpch:region/1')")
def g_shortest(spark, sf):
    """[M-10, U-05]"""
    return traverse.shortest_connection(_view(spark, sf).edges(), "tpch:nation/1", "tpch:region/1")


@_query(_REACH + ", p AS (SELECT a.s AS s, a.t AS v, b.t AS t FROM m a JOIN m b ON b.s = a.t JOIN m c ON c.s = a.s AND c.t = b.t WHERE a.d > 0 AND b.d > 0 AND c.d = a.d + b.d) SELECT v.iri, CAST(count(p.s) AS DOUBLE) AS value FROM v LEFT JOIN p ON p.v = v.iri GROUP BY v.iri")
def g_betweenness(spark, sf):
    """The view is a forest, where every pair has one shortest path. [M-02]"""
    v = _view(spark, sf)
    return scores.betweenness(v.nodes, v.edges()).select("iri", F.round("value", 6).alias("value"))


def _k_core_sql(rounds: int) -> str:
    """From the degree down: the most neighbours that have at least so many, until nothing changes."""
    parts = [
        "WITH l AS (SELECT 's/' || l_suppkey AS a, 'p/' || l_partkey AS b, count(*) AS w FROM lineitem GROUP BY ALL), u AS (SELECT a, b, w FROM l UNION ALL SELECT b, a, w FROM l), "
        "k0 AS MATERIALIZED (SELECT a, CAST(sum(w) AS BIGINT) AS k FROM u GROUP BY a)"
    ]
    for i in range(rounds):
        parts.append(
            f", k{i + 1} AS MATERIALIZED (SELECT a, CAST(max(least(k, above)) AS BIGINT) AS k FROM (SELECT a, k, sum(w) OVER (PARTITION BY a ORDER BY k DESC) AS above FROM "
            f"(SELECT u.a, least(s.k, o.k) AS k, sum(w) AS w FROM u JOIN k{i} s ON s.a = u.b JOIN k{i} o ON o.a = u.a GROUP BY ALL)) GROUP BY a)"
        )
    return "".join(parts) + f" SELECT a AS iri, CAST(k AS DOUBLE) AS value FROM k{rounds}"


@_query(_k_core_sql(25))
def g_k_core(spark, sf):
    """Suppliers and parts by their orders; the SQL stands still after fewer rounds than it has. [M-04]"""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    e = li.select(F.concat(F.lit("s/"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p/"), F.col("l_partkey").cast("string")).alias("dst"))
    return scores.k_core(e.select(F.explode(F.array("src", "dst")).alias("iri")).distinct(), e)


@_query(_V + ", k AS (SELECT v.iri, CASE WHEN contains(v.iri, 'customer') THEN 1 ELSE 0 END AS c FROM v), m AS (SELECT count(*) AS m FROM ve), p AS (SELECT c, (SELECT count(*) FROM ve JOIN k a ON a.iri = src JOIN k b ON b.iri = dst WHERE a.c = g.c AND b.c = g.c) AS own, (SELECT count(*) FROM (SELECT src AS i FROM ve UNION ALL SELECT dst FROM ve) JOIN k ON k.iri = i WHERE k.c = g.c) AS ends FROM (SELECT DISTINCT c FROM k) g) SELECT round(sum(own / m::DOUBLE - (ends / (2.0 * m)) * (ends / (2.0 * m))), 9) AS modularity FROM p, m")
def g_modularity(spark, sf):
    """[A-23, M-14]"""
    v = _view(spark, sf)
    k = v.nodes.select("iri", F.contains("iri", F.lit("customer")).cast("int").alias("cluster"))
    return community.modularity(v.edges(), k).select(F.round("modularity", 9).alias("modularity"))


@_query()
def g_louvain(spark, sf):
    """[M-08]"""
    v = _view(spark, sf)
    return community.louvain(v.nodes, v.edges())


@_query()
def g_spectral(spark, sf):
    """[M-09]"""
    v = _view(spark, sf)
    return community.spectral(v.nodes, v.edges())


#: The growth of layers by bisection, their last ranks, and values that go whole to one layer.
_LAYERS = (
    _V.replace("WITH ", "WITH RECURSIVE ", 1)
    + f", {_ENDS}, d AS (SELECT iri, count(b) AS value FROM v LEFT JOIN x ON a = iri GROUP BY iri), "
    "s AS (SELECT count(*) AS n, CASE WHEN count(*) < 12 THEN 1 ELSE 4 END AS first FROM v), "
    "q AS (SELECT 0 AS i, 1.0::DOUBLE AS low, greatest(2.0, n / first::DOUBLE) AS high FROM s UNION ALL SELECT i + 1, CASE WHEN below THEN m ELSE low END, CASE WHEN below THEN high ELSE m END "
    "FROM (SELECT i, low, high, (low + high) / 2 AS m, first * (pow((low + high) / 2, 10) - 1) / ((low + high) / 2 - 1) < n AS below FROM q, s WHERE i < 200)), "
    "grow AS (SELECT CASE WHEN first * 10 >= n THEN 1.0 ELSE (SELECT (low + high) / 2 FROM q WHERE i = 200) END AS q FROM s), "
    "c AS (SELECT 0 AS i, CAST(floor(first + 0.5) AS BIGINT) - 1 AS last, first::DOUBLE AS size FROM s UNION ALL "
    "SELECT i + 1, CASE WHEN i + 1 = 9 THEN n - 1 ELSE CAST(floor(last + 1 + size * grow.q + 0.5) AS BIGINT) - 1 END, size * grow.q FROM c, s, grow WHERE i < 9 AND last < n - 1), "
    "cuts AS (SELECT least(last, n - 1) AS cut FROM c, s), "
    "p AS (SELECT value, sum(count(*)) OVER (ORDER BY value DESC) - 1 AS last, sum(count(*)) OVER (ORDER BY value DESC) - count(*) AS first FROM d GROUP BY value), "
    "k AS (SELECT value, least((SELECT count(*) FROM cuts) - 1, (SELECT count(*) FROM cuts WHERE cut < p.first)) AS a, least((SELECT count(*) FROM cuts) - 1, (SELECT count(*) FROM cuts WHERE cut < p.last)) AS b FROM p), "
    "w AS (SELECT value, CASE WHEN a < b AND lag(a) OVER (ORDER BY value DESC) = a THEN b ELSE a END AS slot FROM k) "
    "SELECT iri, CAST(11 - r AS INTEGER) AS layer FROM d JOIN (SELECT value, dense_rank() OVER (ORDER BY slot) AS r FROM w) USING (value)"
)


@_query(_LAYERS)
def g_zoom_layers(spark, sf):
    """[M-11, W-02]"""
    v = _view(spark, sf)
    return scores.zoom_layers(scores.degree(v.nodes, v.edges()))


# --- ingest and export -----------------------------------------------------------------------------


def _triples(spark, sf) -> DataFrame:
    """Customers as triples: a type twice, a name, a nation that is not described, and a bad type."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    t = lambda pred, obj, kind, n, datatype=None: F.struct(F.lit(pred).alias("pred"), obj.alias("obj"), F.lit(kind).alias("obj_kind"), F.lit(datatype).cast("string").alias("datatype"), F.lit(n).alias("n"))
    name = F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string"))
    rows = F.inline(F.array(t(RDF_TYPE, F.lit("C"), "iri", 0), t(RDF_TYPE, F.lit("C"), "iri", 1), t("name", F.col("c_name"), "literal", 2), t("nation", name, "iri", 3), t(RDF_TYPE, F.lit("bad"), "literal", 4), t("bal", F.col("c_acctbal").cast("decimal(18,2)").cast("string"), "literal", 5, "xsd:decimal")))
    return c.select(F.concat(F.lit("c/"), F.col("c_custkey").cast("string")).alias("subj"), F.lit(False).alias("subj_is_blank"), "c_custkey", rows).select("subj", "subj_is_blank", "pred", "obj", "obj_kind", "datatype", F.lit(None).cast("string").alias("lang"), (F.col("c_custkey") * 8 + F.col("n")).alias("seq"))


@_query("SELECT 'c/' || c_custkey AS iri, true AS has_subject, c_custkey * 8 AS node_seq FROM customer UNION ALL SELECT 'nation/' || c_nationkey, false, min(c_custkey) * 8 + 3 FROM customer GROUP BY c_nationkey")
def ing_nodes(spark, sf):
    """[N-01..N-03]"""
    return ingest.build_graph(_triples(spark, sf)).nodes.select("iri", "has_subject", "node_seq")


@_query(f"SELECT 'c/' || c_custkey AS iri, 'name' AS pred, c_name AS value, CASE WHEN strlen(c_name) < 32 THEN 2 ELSE 1 END AS value_type FROM customer UNION ALL SELECT 'c/' || c_custkey, 'bal', {D2('c_acctbal')}, 16 FROM customer")
def ing_properties(spark, sf):
    """[N-04, N-10]"""
    return ingest.build_graph(_triples(spark, sf)).properties.select("iri", "pred", "value", "value_type")


@_query("SELECT 5 * count(*) AS triples FROM customer")
def ing_triple_count(spark, sf):
    """[N-06]"""
    return ingest.triple_count(_triples(spark, sf))


@_query("SELECT 'o/' || l_orderkey AS src, 'items' AS pred, 'p/' || l_partkey AS dst FROM lineitem")
def ing_lists(spark, sf):
    """The items of orders as RDF lists. [N-12]"""
    from pyspark.sql import Window

    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    at = li.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey")))
    cell = lambda i: F.concat(F.lit("cell/"), F.col("l_orderkey").cast("string"), F.lit("/"), i.cast("string"))
    i = F.col("i")
    edge = lambda s, p, d: F.struct(s.alias("src"), F.lit(p).alias("pred"), d.alias("dst"), F.lit(0).cast("long").alias("seq"))
    order = F.concat(F.lit("o/"), F.col("l_orderkey").cast("string"))
    edges = at.select(F.inline(F.array(edge(F.when(i == 1, order), "items", cell(i)), edge(cell(i), RDF_FIRST, F.concat(F.lit("p/"), F.col("l_partkey").cast("string"))), edge(cell(i), RDF_REST, F.when(i < F.col("n"), cell(i + 1)).otherwise(F.lit(RDF_NIL)))))).where("src is not null")
    base = lift(spark, sf, "region")
    g = ingest.resolve_lists(base.with_(edges=edges, properties=base.properties.limit(0)))
    return g.edges.where("pred = 'items'").select("src", "pred", "dst")


@_query(_V + ", i AS (SELECT iri, row_number() OVER (ORDER BY iri) - 1 AS id FROM v) SELECT a.id AS source, b.id AS target, pred AS predicate FROM ve JOIN i a ON a.iri = src JOIN i b ON b.iri = dst")
def export_edges(spark, sf):
    """[K-03]"""
    return sinks.edges_table(_view(spark, sf)).select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), "predicate")


@_query(_V + "SELECT row_number() OVER (ORDER BY iri) - 1 AS id, iri, type, coalesce(c_name, n_name, r_name) AS label FROM v JOIN n USING (iri) " + f"LEFT JOIN customer ON iri = {C} LEFT JOIN nation ON iri = {N} LEFT JOIN region ON iri = {R}")
def export_nodes(spark, sf):
    """[K-04]"""
    return sinks.nodes_table(_view(spark, sf)).select(F.col("id").cast("long").alias("id"), "iri", "type", "label")


@_query(_V + f", {_ENDS}, d AS (SELECT iri, count(b) AS value FROM v LEFT JOIN x ON a = iri GROUP BY iri) SELECT iri, type, printf('%.4f', value::DOUBLE) AS degree FROM d JOIN n USING (iri)")
def export_statistics(spark, sf):
    """[K-05, X-16]"""
    v = _view(spark, sf)
    return sinks.statistics_table(v, {"degree": scores.degree(v.nodes, v.edges())}).select("iri", "type", "degree")


@_query(_V + "SELECT src, pred, dst, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY pred, src) - 1 AS place, count(*) OVER (PARTITION BY least(src, dst), greatest(src, dst)) AS \"of\" FROM ve")
def view_parallel_edges(spark, sf):
    """[G-27, W-03]"""
    return _view(spark, sf).parallel_edges().select("src", "pred", "dst", F.col("place").cast("long").alias("place"), "of")


@_query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_event_counts(spark, sf):
    """[T-05]"""
    return event_counts(spark.read.parquet(f"{sf}/events.parquet")).select("window_start", "event_type", "n", F.round("total", 2).alias("total"))


@_query(f"SELECT {C} AS iri, CAST(1 AS BIGINT) AS n_out, count(o_orderkey) AS n_in FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def node_degrees(spark, sf):
    """[P-11]"""
    return degree_counts(lift(spark, sf, "customer", "orders")).where("iri like 'tpch:customer/%'")


from . import catalog_more  # noqa: E402, F401  its queries register themselves
