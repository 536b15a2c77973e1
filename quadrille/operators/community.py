"""Communities: modularity, Louvain and spectral clustering. [A-23, M-08, M-09, M-14, M-16]"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .traverse import connected_components


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(modularity): over clusters, edges inside by all edges, less the squared share of ends. [M-14]"""
    a, b = clusters.select(F.col("iri").alias("src"), F.col("cluster").alias("x")), clusters.select(F.col("iri").alias("dst"), F.col("cluster").alias("y"))
    met = edges.join(a, "src").join(b, "dst")
    inside = met.select(F.explode(F.array(F.struct(F.col("x").alias("cluster"), (F.col("x") == F.col("y")).cast("double").alias("own")), F.struct(F.col("y").alias("cluster"), F.lit(0.0).alias("own")))).alias("e")).select("e.*")
    per = inside.groupBy("cluster").agg(F.sum("own").alias("own"), F.count("*").alias("ends"))
    m = per.agg(F.sum("ends").alias("all"))
    part = 2 * F.col("own") / F.col("all") - (F.col("ends") / F.col("all")) ** 2
    return per.crossJoin(F.broadcast(m)).agg(F.sum(part).alias("modularity"))


def gain(links: float, da: float, db: float, m: float, resolution: float = 1.0) -> float:
    """What joining two communities adds: m is the number of edges, links those between them. [M-08]"""
    return (resolution * links - da * db / (2 * m)) / m


def louvain_local(n: int, pairs: list[tuple[int, int]], resolution: float = 1.0) -> list[int]:
    """Clusters, numbered from 0 by first member: nodes move to the neighbouring community of the greatest gain, ties to
    the least one, until none gains; communities become nodes, and so on."""
    where = list(range(n))
    weight: dict[tuple[int, int], float] = defaultdict(float)
    for a, b in pairs:
        weight[min(a, b), max(a, b)] += 1
    m = float(len(pairs))
    members = n
    while m and members:
        near: list[dict[int, float]] = [defaultdict(float) for _ in range(members)]
        deg = [0.0] * members
        for (a, b), w in weight.items():
            deg[a] += w
            deg[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w
        own, total, moved = list(range(members)), deg[:], False
        while True:
            again = False
            for v in range(members):
                to: dict[int, float] = defaultdict(float)
                for u, w in near[v].items():
                    to[own[u]] += w
                home = own[v]
                total[home] -= deg[v]
                best, top = home, gain(to.get(home, 0.0), deg[v], total[home], m, resolution)
                for c in sorted(to):
                    g = gain(to[c], deg[v], total[c], m, resolution)
                    if g > top + 1e-12:
                        best, top = c, g
                own[v] = best
                total[best] += deg[v]
                again |= best != home
            moved |= again
            if not again:
                break
        if not moved:
            break
        order = {c: i for i, c in enumerate(dict.fromkeys(own))}
        own = [order[c] for c in own]
        where = [own[w] for w in where]
        merged: dict[tuple[int, int], float] = defaultdict(float)
        for (a, b), w in weight.items():
            x, y = own[a], own[b]
            merged[min(x, y), max(x, y)] += w
        weight, members = merged, len(order)
    order = {c: i for i, c in enumerate(dict.fromkeys(where))}
    return [order[c] for c in where]


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(iri, cluster): a cluster is named by its least node.  Communities never span components, so each component
    is a group of its own; the visible graph bounds its size."""
    parts = connected_components(nodes, edges)
    rows = edges.select("src", "dst").join(parts.withColumnRenamed("iri", "src"), "src").select("component", "src", "dst")
    rows = rows.unionByName(parts.select("component", F.col("iri").alias("src"), F.lit(None).cast("string").alias("dst")))
    all_edges = edges.count()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["src"]) | set(pdf["dst"].dropna()))
        at = {x: i for i, x in enumerate(names)}
        pairs = [(at[a], at[b]) for a, b in zip(pdf["src"], pdf["dst"]) if isinstance(b, str)]
        # gains are those of the whole view, whose number of edges weighs the links against chance
        found = louvain_local(len(names), pairs, resolution * all_edges / len(pairs) if pairs else resolution)
        first: dict[int, str] = {}
        for x, c in zip(names, found):
            first.setdefault(c, x)
        return pd.DataFrame({"iri": names, "cluster": [first[c] for c in found]})

    return rows.groupBy("component").applyInPandas(run, "iri string, cluster string")


def laplacian(n: int, pairs: list[tuple[int, int]]) -> np.ndarray:
    """Degrees less adjacency, repeated edges once. [M-16]"""
    a = np.zeros((n, n))
    for i, j in pairs:
        if i != j:
            a[i, j] = a[j, i] = 1
    return np.diag(a.sum(axis=1)) - a


def _signed(v: np.ndarray) -> np.ndarray:
    i = int(np.argmax(np.abs(v) > 1e-9))
    return v if v[i] >= 0 else -v


#: Nodes up to which the Laplacian is a dense matrix, and numbers of a Krylov space and of its restarts beyond.
DENSE, _SPACE, _RESTARTS = 4000, 120, 60


def least_vectors(n: int, pairs: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least eigenvalues of the Laplacian and their vectors: all at once up to DENSE nodes, else by restarted
    Krylov spaces, until the residuals are a millionth of the greatest eigenvalue's bound or no longer fall."""
    if n <= DENSE:
        values, vectors = np.linalg.eigh(laplacian(n, pairs))
        order = np.argsort(values, kind="stable")[:k]
        return values[order], vectors[:, order]
    links = np.unique(np.sort(np.array([p for p in pairs if p[0] != p[1]] or np.zeros((0, 2)), np.int64).reshape(-1, 2), axis=1), axis=0)
    a, b = np.r_[links[:, 0], links[:, 1]], np.r_[links[:, 1], links[:, 0]]
    deg = np.bincount(a, minlength=n).astype(float)
    times = lambda x: deg * x - np.bincount(a, weights=x[b], minlength=n)
    top = 2 * max(1.0, deg.max(initial=1.0))
    kept = np.random.default_rng(0).standard_normal((n, k))
    kept[:, 0] = 1.0
    values, worst = np.zeros(k), np.inf
    for _ in range(_RESTARTS):
        base = np.linalg.qr(kept)[0]
        v = base[:, -1]
        for _ in range(_SPACE - k):
            w = times(v)
            for _ in range(2):  # twice, as once leaves rounding
                w -= base @ (base.T @ w)
            norm = np.linalg.norm(w)
            if norm < 1e-12 * top:
                w = np.random.default_rng(base.shape[1]).standard_normal(n)
                w -= base @ (base.T @ w)
                norm = np.linalg.norm(w)
            v = w / norm
            base = np.column_stack([base, v])
        image = np.column_stack([times(base[:, i]) for i in range(base.shape[1])])
        values, turn = np.linalg.eigh(base.T @ image)
        kept, values = base @ turn[:, :k], values[:k]
        residual = np.linalg.norm(image @ turn[:, :k] - kept * values, axis=0).max()
        if residual < 1e-6 * top or residual > 0.999 * worst:
            break
        worst = residual
    return values, kept


def spectral_local(n: int, pairs: list[tuple[int, int]], resolution: float = 1.0) -> tuple[list[int], np.ndarray]:
    """(cluster of each node, Fiedler vector): the vector of the second least eigenvalue is cut in two by one-dimensional
    2-means, parts again while their spread is over resolution times the vector's."""
    if n < 3:
        return [0] * n, np.zeros(n)
    f = _signed(least_vectors(n, pairs, 2)[1][:, 1])
    bar, parts, out = resolution * f.std(), [np.arange(n)], []
    for _ in range(max(1, n // 3)):
        split = next((p for p in parts if len(p) > 1 and (f[p].std() > bar or len(parts) == 1)), None)
        if split is None:
            break
        low, high = f[split].min(), f[split].max()
        for _ in range(100):
            left = np.abs(f[split] - low) <= np.abs(f[split] - high)
            new = f[split][left].mean(), f[split][~left].mean() if (~left).any() else high
            if new == (low, high):
                break
            low, high = new
        if left.all() or not left.any():
            break
        parts = [p for p in parts if p is not split] + [split[left], split[~left]]
    out = np.zeros(n, int)
    for i, p in enumerate(sorted(parts, key=lambda p: p[0])):
        out[p] = i
    return out.tolist(), f


def spectral(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(iri, cluster, fiedler) of a view: one eigenproblem in one task, which holds the view."""
    rows = nodes.select(F.col("iri").alias("src"), F.lit(None).cast("string").alias("dst")).unionByName(edges.select("src", "dst"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["src"]) | set(pdf["dst"].dropna()))
        at = {x: i for i, x in enumerate(names)}
        found, f = spectral_local(len(names), [(at[a], at[b]) for a, b in zip(pdf["src"], pdf["dst"]) if isinstance(b, str)], resolution)
        return pd.DataFrame({"iri": names, "cluster": found, "fiedler": f})

    return rows.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, "iri string, cluster int, fiedler double")
