"""Type tables: instances of a type, filtered, sorted, projected. [P-09..P-12, O-01..O-16]"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import to_double, to_long
from ..model import DEFAULT_LANG, DOUBLE, INTEGER, Graph
from . import filters as flt
from .labels import get_property, get_property_count
from .profile import property_profile, value_statistics


def degree_counts(graph: Graph) -> DataFrame:
    """(iri, n_out, n_in) of nodes with references. [P-11]"""
    out = graph.edges.groupBy(F.col("src").alias("iri")).agg(F.count("*").alias("n_out"), F.lit(0).cast("long").alias("n_in"))
    back = graph.edges.groupBy(F.col("dst").alias("iri")).agg(F.lit(0).cast("long").alias("n_out"), F.count("*").alias("n_in"))
    return out.unionByName(back).groupBy("iri").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))


def sort_key(column: Column, value_types: int, ascending: bool, query: bool = False) -> Column:
    """How a column sorts: whole numbers and fractions by value, absent ones as 0; texts by bytes, absent ones
    last either way in a type table [O-01..O-03], as '' in a query [O-04]."""
    if value_types == INTEGER:
        key = F.coalesce(to_long(column), F.lit(0).cast("bigint"))
    elif value_types == DOUBLE:
        key = to_double(column)
    elif query:
        key = F.coalesce(column, F.lit(""))
    else:
        return column.asc_nulls_last() if ascending else column.desc_nulls_last()
    return key.asc() if ascending else key.desc()


@dataclass(frozen=True)
class TypeTable:
    """An immutable builder: every step gives a new one, and rows() is one plan."""

    graph: Graph
    type: str
    columns: tuple[str, ...] = ()
    lang: str = DEFAULT_LANG
    instances: DataFrame | None = None
    order: tuple[tuple[str, bool, int], ...] = ()

    def _all(self) -> DataFrame:
        return self.instances if self.instances is not None else self.graph.types.where(F.col("type") == self.type).select("iri")

    def _with(self, df: DataFrame) -> TypeTable:
        return replace(self, instances=df)

    def default_columns(self) -> list[str]:
        """Properties of the type, those with 'label' first; one row for each reaches the driver. [P-09]"""
        found = [r["pred"] for r in self.graph.properties.join(self._all(), "iri", "left_semi").select("pred").distinct().collect()]
        return sorted(found, key=lambda p: ("label" not in p, p))

    def show(self, *columns: str) -> TypeTable:
        return replace(self, columns=columns)  # [P-10]

    def hide(self, *columns: str) -> TypeTable:
        return replace(self, columns=tuple(c for c in self.columns or tuple(self.default_columns()) if c not in columns))

    def contains(self, needle: str) -> TypeTable:
        """Restarts from all instances. [F-11]"""
        whole = replace(self, instances=None)
        return self._with(flt.text_filter(whole._all(), self.graph.properties, needle))

    def having(self, pred: str) -> TypeTable:
        return self._with(flt.value_exists(self._all(), self.graph.properties, pred))

    def lacking(self, pred: str) -> TypeTable:
        return self._with(flt.value_missing(self._all(), self.graph.properties, pred))

    def multiple(self, pred: str) -> TypeTable:
        return self._with(flt.multi_value(self._all(), self.graph.properties, pred))

    def only(self, iris: DataFrame) -> TypeTable:
        """Restrict to given nodes, as when a selection is shown as a table. [G-19]"""
        return self._with(self._all().join(iris, "iri", "left_semi"))

    def sort(self, pred: str, ascending: bool = True, value_types: int | None = None) -> TypeTable:
        """Sorts are stable, so an earlier one breaks the ties of a later one. pred: a property, 'iri', or 'references'."""
        if value_types is None and pred not in ("iri", "references"):
            row = property_profile(self.graph).where((F.col("type") == self.type) & (F.col("pred") == pred)).select("value_types").first()
            value_types = row[0] if row else 0
        return replace(self, order=((pred, ascending, value_types or 0), *self.order))

    def rows(self, counts: bool = False) -> DataFrame:
        """iri, n_out, n_in, and a column for each visible property (with counts also <property>_n). [P-11, K-01]"""
        columns = list(self.columns) or self.default_columns()
        wanted = columns + [p for p, _, _ in self.order if p not in (*columns, "iri", "references")]
        ids = self._all()
        cells = self.graph.properties.where(F.col("pred").isin(wanted)) if wanted else None
        out = ids.join(degree_counts(self.graph), "iri", "left").select("iri", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_out", "n_in")])
        if cells is not None:
            one = get_property_count(cells, self.lang) if counts else get_property(cells, self.lang)
            aggs = [F.max(F.when(F.col("pred") == c, F.col("value"))).alias(c) for c in wanted]
            aggs += [F.coalesce(F.max(F.when(F.col("pred") == c, F.col("n"))), F.lit(0)).alias(f"{c}_n") for c in wanted] if counts else []
            out = out.join(one.groupBy("iri").agg(*aggs), "iri", "left")
        if self.order:
            keys = []
            for pred, ascending, kinds in self.order:
                c = F.col("n_out") + F.col("n_in") if pred == "references" else F.col(f"`{pred}`")
                keys.append((c.asc() if ascending else c.desc()) if pred in ("iri", "references") else sort_key(c, kinds, ascending))
            out = out.orderBy(*keys, "iri")
        keep = ["iri", "n_out", "n_in", *columns, *([f"{c}_n" for c in columns] if counts else [])]
        return out.select(*[F.col(f"`{c}`") for c in keep])

    def page(self, offset: int, limit: int) -> DataFrame:
        return self.rows().offset(offset).limit(limit)  # [O-16]

    def statistics(self, pred: str, top: int = 10) -> DataFrame:
        return value_statistics(self.graph, self._all(), pred, top)  # [A-17..A-19]


def sort_types(profile: DataFrame, by: str = "instances") -> DataFrame:
    """Types by label, upwards, or by a count, downwards. [O-08, O-09]"""
    return profile.orderBy("display") if by == "label" else profile.orderBy(F.desc(by), "type")
