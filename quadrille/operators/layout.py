"""Positions of a bounded view's nodes. [L-01..L-07, L-11]"""

from __future__ import annotations

from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .community import least_vectors
from .traverse import connected_components


class Layout(Enum):
    FORCE = "force"
    CIRCULAR = "circular"
    HORIZONTAL = "horizontal"
    VERTICAL = "vertical"
    MULTIPARTITE = "multipartite"
    SPECTRAL = "spectral"
    HIERARCHICAL = "hierarchical"


def circular(nodes: DataFrame, edges: DataFrame, gap: float = 50.0) -> DataFrame:
    """All nodes on one circle, components together, within them by name. [L-03]"""
    parts = connected_components(nodes, edges)
    n = F.count("*").over(Window.partitionBy())
    angle = 2 * F.pi() * (F.row_number().over(Window.orderBy("component", "iri")) - 1) / n
    r = n * gap / (2 * F.pi())
    return parts.select("iri", (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"))


def linear(nodes: DataFrame, edges: DataFrame, sizes: DataFrame | None = None, horizontal: bool = True, gap: float = 50.0) -> DataFrame:
    """One line, components together; a running sum of sizes. [L-05]"""
    parts = connected_components(nodes, edges)
    sized = parts.join(sizes, "iri", "left") if sizes is not None else parts.withColumn("size", F.lit(0.0))
    order = Window.orderBy("component", "iri")
    at = F.sum(F.coalesce("size", F.lit(0.0)) + gap).over(order) - F.coalesce("size", F.lit(0.0)) / 2
    zero = F.lit(0.0)
    return sized.select("iri", (at if horizontal else zero).alias("x"), (zero if horizontal else at).alias("y"))


def multipartite(nodes: DataFrame, types: DataFrame, gap: float = 50.0, columns: float = 300.0) -> DataFrame:
    """A column for each type. types: (iri, type) of highest priority. [L-06]"""
    one = nodes.join(types.groupBy("iri").agg(F.min("type").alias("type")), "iri", "left").withColumn("type", F.coalesce("type", F.lit("")))
    place = F.row_number().over(Window.partitionBy("type").orderBy("iri")) - (F.count("*").over(Window.partitionBy("type")) + 1) / 2
    return one.select("iri", ((F.dense_rank().over(Window.orderBy("type")) - 1) * columns).alias("x"), (place * gap).alias("y"))


def layers_local(names: list[str], links: set[tuple[str, str]]) -> dict[str, int]:
    """The longest path to each node; an edge that closes a cycle, seen depth first from the least names, does not count."""
    after: dict[str, list[str]] = {x: [] for x in names}
    for a, b in sorted(links):
        after[a].append(b)
    state: dict[str, int] = {}
    order: list[str] = []
    good: list[tuple[str, str]] = []
    entered = {b for _, b in links}
    for root in sorted(names, key=lambda x: (x in entered, x)):  # sources first
        if root in state:
            continue
        state[root] = 1
        stack = [(root, iter(after[root]))]
        while stack:
            at, rest = stack[-1]
            for b in rest:
                if state.get(b) != 1:
                    good.append((at, b))
                if b not in state:
                    state[b] = 1
                    stack.append((b, iter(after[b])))
                    break
            else:
                state[at] = 2
                order.append(at)
                stack.pop()
    into: dict[str, list[str]] = {x: [] for x in names}
    for a, b in good:
        into[b].append(a)
    layer: dict[str, int] = {}
    for x in reversed(order):
        layer[x] = max((layer[a] + 1 for a in into[x]), default=0)
    return layer


def _one_view(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of a view as one group, so in one task: (src, dst), and (iri, null) for each node."""
    rows = nodes.select(F.col("iri").alias("src"), F.lit(None).cast("string").alias("dst")).unionByName(edges.select("src", "dst").distinct())
    return rows.withColumn("_all", F.lit(1)).groupBy("_all")


def hierarchical(nodes: DataFrame, edges: DataFrame, gap: float = 50.0, level: float = 150.0) -> DataFrame:
    """Layers by the longest path to a node; edges that close a cycle do not count. [L-04]"""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["src"]) | set(pdf["dst"].dropna()))
        found = layers_local(names, {(a, b) for a, b in zip(pdf["src"], pdf["dst"]) if isinstance(b, str) and a != b})
        return pd.DataFrame({"iri": names, "layer": [found[x] for x in names]})

    state = _one_view(nodes, edges).applyInPandas(run, "iri string, layer int")
    place = F.row_number().over(Window.partitionBy("layer").orderBy("iri")) - (F.count("*").over(Window.partitionBy("layer")) + 1) / 2
    return state.select("iri", (place * gap).alias("x"), (F.col("layer") * level).alias("y"))


def spectral(nodes: DataFrame, edges: DataFrame, size: float = 800.0) -> DataFrame:
    """By the first two eigenvectors of the Laplacian whose values are not 0. [L-07]"""
    parts = connected_components(nodes, edges).select("component").distinct().count()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["src"]) | set(pdf["dst"].dropna()))
        at = {x: i for i, x in enumerate(names)}
        # as many values are 0 as the view has components
        values, vectors = least_vectors(len(names), [(at[a], at[b]) for a, b in zip(pdf["src"], pdf["dst"]) if isinstance(b, str)], min(len(names), parts + 2))
        good = [i for i in np.argsort(values, kind="stable") if values[i] > 1e-9][:2]
        xy = np.zeros((len(names), 2))
        for k, i in enumerate(good):
            xy[:, k] = vectors[:, i] / max(1e-12, np.abs(vectors[:, i]).max()) * size
        return pd.DataFrame({"iri": names, "x": xy[:, 0], "y": xy[:, 1]})

    return _one_view(nodes, edges).applyInPandas(run, "iri string, x double, y double")


def force_step(positions: DataFrame, edges: DataFrame, temperature: float, repulsion: float = 30_000.0, cutoff: float = 600.0, attraction: float = 1e-3, damping: float = 0.4) -> DataFrame:
    """One step: nodes repel within a radius, found by a grid of cells of that size; edges attract with the square of their
    length; steps are damped and no longer than the temperature; locked nodes stay. positions: (iri, x, y, vx, vy, locked). [L-01]"""
    cell = lambda c: F.floor(F.col(c) / cutoff)
    here = positions.select("iri", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    spread = here.withColumn("d", around).select(F.col("iri").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    d2 = F.greatest(dx * dx + dy * dy, F.lit(1.0))
    push = here.join(spread, ["cx", "cy"]).where("iri <> o").where(d2 < cutoff * cutoff).groupBy("iri").agg(F.sum(dx / d2 * repulsion / F.sqrt(d2)).alias("fx"), F.sum(dy / d2 * repulsion / F.sqrt(d2)).alias("fy"))
    ends = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).where("a <> b")
    a, b = positions.select(F.col("iri").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), positions.select(F.col("iri").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    far = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    pull = ends.join(a, "a").join(b, "b").groupBy(F.col("a").alias("iri")).agg(F.sum((F.col("bx") - F.col("ax")) * far * attraction).alias("gx"), F.sum((F.col("by") - F.col("ay")) * far * attraction).alias("gy"))
    zero = F.lit(0.0)
    moved = positions.join(push, "iri", "left").join(pull, "iri", "left")
    moved = moved.withColumn("vx", (F.col("vx") + F.coalesce("fx", zero) + F.coalesce("gx", zero)) * damping).withColumn("vy", (F.col("vy") + F.coalesce("fy", zero) + F.coalesce("gy", zero)) * damping)
    speed = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2)
    part = F.when(F.col("locked"), zero).when(speed > temperature, temperature / speed).otherwise(F.lit(1.0))
    return moved.withColumn("_s", part).select("iri", (F.col("x") + F.col("vx") * F.col("_s")).alias("x"), (F.col("y") + F.col("vy") * F.col("_s")).alias("y"), "vx", "vy", "locked")


def force(nodes: DataFrame, edges: DataFrame, steps: int = 20, temperature: float = 100.0) -> DataFrame:
    """From the circle, with a falling temperature, until nothing moves much. [L-02]"""
    from ..plans.staging import cut

    state = cut(circular(nodes, edges).select("iri", "x", "y", F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), F.lit(False).alias("locked")))
    for _ in range(steps):
        new = cut(force_step(state, edges, temperature))
        moved = new.join(state.select("iri", F.col("x").alias("px"), F.col("y").alias("py")), "iri").agg(F.max(F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2))).first()[0]
        state, temperature = new, temperature * 0.98
        if moved is None or (moved < 0.8 and temperature < 0.5):
            break
    return state


def arrange(layout: Layout, nodes: DataFrame, edges: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """[L-11]"""
    return {
        Layout.FORCE: lambda: force(nodes, edges).select("iri", "x", "y"),
        Layout.CIRCULAR: lambda: circular(nodes, edges),
        Layout.HORIZONTAL: lambda: linear(nodes, edges),
        Layout.VERTICAL: lambda: linear(nodes, edges, horizontal=False),
        Layout.MULTIPARTITE: lambda: multipartite(nodes, types),
        Layout.SPECTRAL: lambda: spectral(nodes, edges),
        Layout.HIERARCHICAL: lambda: hierarchical(nodes, edges),
    }[layout]()
