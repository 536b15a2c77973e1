"""Visual queries: a tree of type tables, compiled to one DataFrame. [J-01..J-07]"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DEFAULT_LANG, Graph
from ..operators.filters import PredicateFilter, apply_filters
from ..operators.labels import get_property
from ..operators.profile import reference_profile, value_statistics
from ..operators.table import sort_key


@dataclass(frozen=True)
class TableQuery:
    """A table of the tree.  links: (predicate, incoming, child)."""

    type: str
    columns: tuple[str, ...] = ()
    filters: tuple[PredicateFilter, ...] = ()
    links: tuple[tuple[str, bool, TableQuery], ...] = ()

    def link(self, pred: str, child: TableQuery, incoming: bool = False) -> TableQuery:
        return TableQuery(self.type, self.columns, self.filters, (*self.links, (pred, incoming, child)))

    def walk(self) -> Iterator[TableQuery]:
        """Depth first: the order of tables in a row. [J-04]"""
        yield self
        for _, _, child in self.links:
            yield from child.walk()


@dataclass(frozen=True)
class VisualQuery:
    root: TableQuery
    order: tuple[tuple[int, str, bool, int], ...] = field(default=())  # (table, predicate, ascending, value types), last first

    def sort(self, table: int, pred: str, ascending: bool = True, value_types: int = 0) -> VisualQuery:
        return VisualQuery(self.root, ((table, pred, ascending, value_types), *self.order))


def candidates(graph: Graph, type_: str) -> DataFrame:
    """(pred, incoming, target): what a table of this type can be linked to. [J-06]"""
    both = [reference_profile(graph, incoming).where(F.col("type") == type_).select("pred", F.lit(incoming).alias("incoming"), F.explode("target_types").alias("target")) for incoming in (False, True)]
    return both[0].unionByName(both[1])


def instances(graph: Graph, query: TableQuery, enforce_types: bool = False) -> DataFrame:
    """Rows of t0, t1, ...: the node of each table of the tree.

    The root's instances pass its filters [F-21]; a link is an inner join along one predicate, either way; siblings
    multiply.  As a link's target decides its type, children's types are checked only on request."""
    number = [0]
    roots = graph.types.where(F.col("type") == query.type).select("iri")
    rows = apply_filters(roots, graph.properties, list(query.filters)).select(F.col("iri").alias("t0"))

    def add(rows: DataFrame, table: TableQuery, me: int) -> DataFrame:
        for pred, incoming, child in table.links:
            number[0] += 1
            at = number[0]
            near, far = ("dst", "src") if incoming else ("src", "dst")
            links = graph.edges.where(F.col("pred") == pred).select(F.col(near).alias(f"t{me}"), F.col(far).alias(f"t{at}"))
            links = apply_filters(links, graph.properties, list(child.filters), f"t{at}")
            if enforce_types:
                links = links.join(graph.types.where(F.col("type") == child.type).select(F.col("iri").alias(f"t{at}")), f"t{at}", "left_semi")
            rows = add(rows.join(links, f"t{me}"), child, at)
        return rows

    rows = add(rows, query, 0)
    return rows.select(*[f"t{i}" for i in range(number[0] + 1)])


def run(graph: Graph, query: VisualQuery | TableQuery, lang: str = DEFAULT_LANG, iris: bool = True, enforce_types: bool = False) -> DataFrame:
    """The query's rows with the visible columns of each table, named t<i>_<column>. [J-05, J-07, K-02]"""
    query = VisualQuery(query) if isinstance(query, TableQuery) else query
    tables = list(query.root.walk())
    rows = instances(graph, query.root, enforce_types)
    wanted = {i: list(t.columns) for i, t in enumerate(tables)}
    for i, pred, _, _ in query.order:
        if pred not in wanted[i]:
            wanted[i] = [*wanted[i], pred]
    name = lambda i, c: f"t{i}_{c.split(':')[-1]}"
    for i, columns in wanted.items():
        if columns:
            values = get_property(graph.properties.where(F.col("pred").isin(columns)), lang)
            cells = values.groupBy(F.col("iri").alias(f"t{i}")).agg(*[F.max(F.when(F.col("pred") == c, F.col("value"))).alias(name(i, c)) for c in columns])
            rows = rows.join(cells, f"t{i}", "left")
    if query.order:
        rows = rows.orderBy(*[sort_key(F.col(name(i, c)), kinds, up, query=True) for i, c, up, kinds in query.order], *[f"t{i}" for i in range(len(tables))])
    keep = [x for i, t in enumerate(tables) for x in ([f"t{i}"] if iris else []) + [name(i, c) for c in t.columns]]
    return rows.select(*keep)


def column_statistics(graph: Graph, query: TableQuery, table: int, pred: str) -> DataFrame:
    """Statistics of one column over the query's rows. [A-17]"""
    return value_statistics(graph, instances(graph, query).select(F.col(f"t{table}").alias("iri")), pred)
