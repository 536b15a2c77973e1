"""Exports. [K-01..K-08]"""

from __future__ import annotations

import html
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prefixes import Prefixes
from ..functions.scalars import distinct_colour, fixed
from ..model import MAX_VISIBLE, Graph
from ..operators.labels import highest_priority_types, node_labels
from ..operators.view import View
from .loader import SCHEMAS


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV with a header; equal names get a number. [K-01, K-02]"""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        seen[c] = seen.get(c, 0) + 1
        names.append(c if seen[c] == 1 else f"{c}_{seen[c]}")
    df.toDF(*names).na.fill("").write.mode("overwrite").csv(path, header=True, emptyValue="")


def _numbered(view: View) -> DataFrame:
    """Visible nodes with their place in order of first mention; the view bounds their number."""
    order = Window.orderBy(F.col("node_seq").asc_nulls_last(), "iri")
    return view.nodes.join(view.graph.nodes.select("iri", "node_seq"), "iri", "left").select("iri", (F.row_number().over(order) - 1).alias("id"))


def edges_table(view: View) -> DataFrame:
    """(source, target, predicate) by the places of nodes. [K-03]"""
    ids = _numbered(view)
    return view.edges().join(ids.select(F.col("iri").alias("src"), F.col("id").alias("source")), "src").join(ids.select(F.col("iri").alias("dst"), F.col("id").alias("target")), "dst").select("source", "target", F.col("pred").alias("predicate"))


def nodes_table(view: View, lang: str = "en") -> DataFrame:
    """(id, iri, type, label); type: the first of highest priority. [K-04]"""
    types = highest_priority_types(view.graph).groupBy("iri").agg(F.min("type").alias("type"))
    return _numbered(view).join(types, "iri", "left").join(node_labels(view.graph, lang=lang), "iri", "left").select("id", "iri", F.coalesce("type", F.lit("")).alias("type"), "label")


def statistics_table(view: View, scores: dict[str, DataFrame], lang: str = "en") -> DataFrame:
    """(iri, label, type, one column of four decimals for each score). [K-05]"""
    out = nodes_table(view, lang).select("iri", "label", "type")
    for name, df in scores.items():
        out = out.join(df.select("iri", fixed(F.col("value")).alias(name)), "iri", "left")
    return out


def svg(view: View, positions: DataFrame, radius: float = 20.0) -> str:
    """A drawing of a view of at most MAX_VISIBLE nodes, each of which reaches the driver. [K-06]"""
    if view.nodes.limit(MAX_VISIBLE + 1).count() > MAX_VISIBLE:
        raise ValueError(f"a drawing has at most {MAX_VISIBLE} nodes")
    nodes = nodes_table(view).join(positions.select("iri", "x", "y"), "iri").orderBy("id").collect()
    at = {r["iri"]: (r["x"], r["y"]) for r in nodes}
    types = {t: distinct_colour(i) for i, t in enumerate(sorted({r["type"] for r in nodes}))}
    xs, ys = [p[0] for p in at.values()] or [0], [p[1] for p in at.values()] or [0]
    box = (min(xs) - 60, min(ys) - 60, max(xs) - min(xs) + 120, max(ys) - min(ys) + 120)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{" ".join(f"{v:.1f}" for v in box)}">']
    out.append('<defs><marker id="arrow" viewBox="0 0 10 10" refX="10" refY="5" markerWidth="6" markerHeight="6" orient="auto"><path d="M0 0L10 5L0 10z"/></marker></defs>')
    for e in view.parallel_edges().orderBy("src", "dst", "place").toLocalIterator():
        if e["src"] not in at or e["dst"] not in at:
            continue
        (x0, y0), (x1, y1) = at[e["src"]], at[e["dst"]]
        if e["src"] == e["dst"]:
            d = f"M{x0:.1f} {y0 - radius:.1f}c-40 -60 40 -60 0 0"
        else:
            bend = (e["place"] - (e["of"] - 1) / 2) * 30
            long = max(1e-9, ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5)
            cx, cy = (x0 + x1) / 2 - (y1 - y0) / long * bend, (y0 + y1) / 2 + (x1 - x0) / long * bend
            d = f"M{x0:.1f} {y0:.1f}Q{cx:.1f} {cy:.1f} {x1:.1f} {y1:.1f}"
        out.append(f'<path d="{d}" fill="none" stroke="#888" marker-end="url(#arrow)"><title>{html.escape(e["pred"])}</title></path>')
    for r in nodes:
        out.append(f'<circle cx="{r["x"]:.1f}" cy="{r["y"]:.1f}" r="{radius}" fill="{types[r["type"]]}"/><text x="{r["x"]:.1f}" y="{r["y"] + radius + 12:.1f}" text-anchor="middle">{html.escape(r["label"] or "")}</text>')
    return "\n".join([*out, "</svg>"])


@dataclass
class Settings:
    """[K-07, D-config]"""

    last_files: list[str] = field(default_factory=list)
    last_endpoints: list[str] = field(default_factory=list)
    last_projects: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=lambda: ["en"])
    suppress_other_languages: bool = False
    max_visible: int = 40_000

    def dumps(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @staticmethod
    def loads(text: str) -> Settings:
        return Settings(**json.loads(text))


def store(graph: Graph, path: str, prefixes: Prefixes | None = None, view: DataFrame | None = None, styles: DataFrame | None = None) -> None:
    """A project: a Parquet data set for each table.  view: the visible nodes, with what else is known of them (positions,
    locks, layers). [K-08]"""
    spark = graph.nodes.sparkSession
    for name in SCHEMAS:
        getattr(graph, name).write.mode("overwrite").parquet(f"{path}/{name}")
    (prefixes or Prefixes()).table(spark).write.mode("overwrite").parquet(f"{path}/prefixes")
    if view is not None:
        view.write.mode("overwrite").parquet(f"{path}/view")
    if styles is not None:
        styles.write.mode("overwrite").parquet(f"{path}/styles")


def restore(spark: SparkSession, path: str) -> Graph:
    """[S-14]"""
    tables = (spark.read.schema(s).parquet(f"{path}/{n}").select([c.split()[0] for c in s.split(", ")]) for n, s in SCHEMAS.items())
    return Graph(*tables)


def restore_view(spark: SparkSession, path: str) -> DataFrame:
    """The visible nodes of a project, with their positions. [S-14]"""
    return spark.read.parquet(f"{path}/view")


def restore_prefixes(spark: SparkSession, path: str) -> Prefixes:
    return Prefixes({r["prefix"]: r["base"] for r in spark.read.parquet(f"{path}/prefixes").collect()}, defaults=False)
