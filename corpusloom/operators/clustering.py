"""Clustering of a layer's experts. A layer has at most some hundred experts, so each layer is one pandas group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def linkage_labels(matrix: np.ndarray, n_clusters: int, linkage: str = "average", max_size: int | None = None) -> np.ndarray:
    """Labels of a bottom-up clustering, numbered by first member. linkage: single, complete, average (weighted by size)
    or 'two-row mean' (unweighted); merges that would exceed max_size are left out."""
    d = matrix.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    groups = {i: [i] for i in range(len(d))}
    while len(groups) > n_clusters:
        live = sorted(groups)
        sub = d[np.ix_(live, live)]
        if max_size is not None:
            size = np.array([len(groups[i]) for i in live])
            sub = np.where(np.add.outer(size, size) <= max_size, sub, np.inf)
        at = int(np.argmin(sub))
        if not np.isfinite(sub.flat[at]):
            break
        a, b = sorted((live[at // len(live)], live[at % len(live)]))
        na, nb = len(groups[a]), len(groups[b])
        row = {"single": np.minimum(d[a], d[b]), "complete": np.maximum(d[a], d[b]), "average": (na * d[a] + nb * d[b]) / (na + nb), "two-row mean": (d[a] + d[b]) / 2}[linkage]
        d[a], d[:, a] = row, row
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        groups[a] += groups.pop(b)
    out = np.empty(len(d), np.int64)
    for k, g in enumerate(sorted(groups.values(), key=min)):
        out[g] = k
    return out


def merge_heights(matrix: np.ndarray) -> list[float]:
    """Distances at which average linkage merges, in order."""
    d, size = matrix.astype(float).copy(), np.ones(len(matrix))
    np.fill_diagonal(d, np.inf)
    out = []
    for _ in range(len(d) - 1):
        a, b = sorted(divmod(int(np.argmin(d)), len(d)))
        out.append(float(d[a, b]))
        row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = row, row
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        size[a] += size[b]
    return out


def _square(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    names = np.unique(np.concatenate([pdf["i"], pdf["j"]]))
    m = np.zeros((len(names), len(names)))
    m[np.searchsorted(names, pdf["i"]), np.searchsorted(names, pdf["j"])] = pdf["distance"]
    return names, m


def agglomerative(distances: DataFrame, layer: str, n_clusters: int, linkage: str = "average", max_size: int | None = None) -> DataFrame:
    """(layer, expert, cluster) from (layer, i, j, distance)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, m = _square(pdf)
        return pd.DataFrame({layer: pdf[layer].iloc[0], "expert": names, "cluster": linkage_labels(m, n_clusters, linkage, max_size)})

    return distances.groupBy(layer).applyInPandas(run, f"{layer} long, expert int, cluster long")


def allocate(heights: DataFrame, layer: str, merges: int) -> DataFrame:
    """(layer, merges): the cheapest merges over all layers; a layer's merges come in its own order."""
    # A merge cannot come before the ones below it, so it costs at least as much as they do.
    cost = F.max("height").over(W.partitionBy(layer).orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    chosen = heights.withColumn("cost", cost).orderBy("cost", layer, "step").limit(merges)
    return heights.select(layer).distinct().join(chosen.groupBy(layer).agg(F.count("*").alias("merges")), layer, "left").fillna(0, ["merges"])


def multi_layer(distances: DataFrame, layer: str, merges: int) -> DataFrame:
    """(layer, expert, cluster) with a number of merges shared by all layers."""
    def climb(pdf: pd.DataFrame) -> pd.DataFrame:
        h = merge_heights(_square(pdf)[1])
        return pd.DataFrame({layer: pdf[layer].iloc[0], "step": range(len(h)), "height": h})

    heights = distances.groupBy(layer).applyInPandas(climb, f"{layer} long, step long, height double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, m = _square(pdf)
        return pd.DataFrame({layer: pdf[layer].iloc[0], "expert": names, "cluster": linkage_labels(m, len(names) - int(pdf["merges"].iloc[0]))})

    return distances.join(allocate(heights, layer, merges), layer).groupBy(layer).applyInPandas(run, f"{layer} long, expert int, cluster long")


def lloyd(x: np.ndarray, k: int, seed: int = 0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """(labels, cost) of k-means from spread-out seeds; labels numbered by first member."""
    r = np.random.default_rng(seed)
    centres = [x[0]]
    for _ in range(1, k):
        d = np.min([((x - c) ** 2).sum(1) for c in centres], 0)
        centres.append(x[r.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[len(centres) % len(x)])
    c = np.stack(centres)
    for _ in range(rounds):
        label = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        new = np.stack([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse], float(((x - c[label]) ** 2).sum())


def _ordered(pdf: pd.DataFrame, expert: str, vector: str) -> tuple[pd.DataFrame, np.ndarray]:
    pdf = pdf.sort_values(expert)
    return pdf, np.stack(pdf[vector].to_numpy())


def kmeans(vectors: DataFrame, layer: str, expert: str, vector: str, k: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x = _ordered(pdf, expert, vector)
        return pd.DataFrame({layer: pdf[layer], expert: pdf[expert], "cluster": lloyd(x, min(k, len(x)))[0]})

    return vectors.groupBy(layer).applyInPandas(run, f"{layer} long, {expert} int, cluster long")


def kmeans_costs(vectors: DataFrame, layer: str, expert: str, vector: str) -> DataFrame:
    """(layer, k, cost) of k-means at every k."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x = _ordered(pdf, expert, vector)
        return pd.DataFrame({layer: pdf[layer].iloc[0], "k": range(1, len(x) + 1), "cost": [lloyd(x, k)[1] for k in range(1, len(x) + 1)]})

    return vectors.groupBy(layer).applyInPandas(run, f"{layer} long, k long, cost double")


def multi_layer_kmeans(vectors: DataFrame, layer: str, expert: str, vector: str, merges: int) -> DataFrame:
    """k of each layer from the cheapest rises of cost over all layers, then k-means."""
    costs = kmeans_costs(vectors, layer, expert, vector)
    w = W.partitionBy(layer).orderBy(F.col("k").desc())
    steps = costs.select(layer, (F.row_number().over(w) - 2).cast("long").alias("step"), (F.col("cost") - F.lag("cost").over(w)).alias("height")).where("step >= 0")
    plan = allocate(steps, layer, merges)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x = _ordered(pdf, expert, vector)
        return pd.DataFrame({layer: pdf[layer], expert: pdf[expert], "cluster": lloyd(x, max(1, len(x) - int(pdf["merges"].iloc[0])))[0]})

    return vectors.join(plan, layer).groupBy(layer).applyInPandas(run, f"{layer} long, {expert} int, cluster long")


def cluster_experts(vectors: DataFrame, layer: str, expert: str, vector: str, weight: str, n_clusters: int, metric: str = "cosine", linkage: str = "average", isolated: list[tuple[int, int]] | None = None) -> DataFrame:
    """(layer, expert, cluster): distances scaled by frequency; isolated (layer, expert) stay alone."""
    alone = isolated or []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x = _ordered(pdf, expert, vector)
        here = int(pdf[layer].iloc[0])
        names, p = pdf[expert].to_numpy(), pdf[weight].to_numpy()
        n = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        d = 1 - n @ n.T if metric == "cosine" else np.linalg.norm(x[:, None] - x, axis=2)
        d = d * (1 + p[:, None] + p)
        lone = np.isin(names, [e for y, e in alone if y == here])
        out = np.empty(len(names), np.int64)
        rest = np.flatnonzero(~lone)
        out[rest] = linkage_labels(d[np.ix_(rest, rest)], max(1, n_clusters - int(lone.sum())), linkage)
        out[lone] = out[rest].max(initial=-1) + 1 + np.arange(int(lone.sum()))
        return pd.DataFrame({layer: here, expert: names, "cluster": out})

    return vectors.groupBy(layer).applyInPandas(run, f"{layer} long, {expert} int, cluster long")


def _summed(vectors: DataFrame, vector: str, layer: str | None = None) -> DataFrame:
    """(layer, n, s, q) parts of the count, sum and sum of outer products, one an Arrow batch and layer: vectors are not gathered."""
    rows = vectors.select(F.col(layer).cast("long").alias("layer") if layer else F.lit(0).cast("long").alias("layer"), F.col(vector).alias("v")).where("v IS NOT NULL")

    def partial(batches):
        for pdf in batches:
            for key, part in pdf.groupby("layer"):
                x = np.stack(part["v"].to_numpy())
                yield pd.DataFrame({"layer": [key], "n": [len(x)], "s": [x.sum(0).tolist()], "q": [(x.T @ x).ravel().tolist()]})

    return rows.mapInPandas(partial, "layer long, n long, s array<double>, q array<double>")


def _covariance(parts: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance from the parts of a layer."""
    n, s, q = parts["n"].sum(), np.sum(np.stack(parts["s"].to_numpy()), 0), np.sum(np.stack(parts["q"].to_numpy()), 0)
    return int(n), s / n, q.reshape(len(s), -1) / n - np.outer(s / n, s / n)


def mean_coupling(vectors: DataFrame, vector: str) -> DataFrame:
    """Mean absolute correlation of different coordinates."""
    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        cov = _covariance(pdf)[2]
        sd = np.sqrt(np.diag(cov))
        r = cov / np.outer(sd, sd)
        return pd.DataFrame({"coupling": [float(np.abs(r[np.triu_indices(len(r), 1)]).mean())]})

    return _summed(vectors, vector).groupBy("layer").applyInPandas(final, "coupling double")


def effective_rank(vectors: DataFrame, layer: str, vector: str) -> DataFrame:
    """exp of the entropy of the covariance's eigenvalues."""
    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        e = np.clip(np.linalg.eigvalsh(_covariance(pdf)[2]), 0, None)
        p = e / max(e.sum(), 1e-300)
        return pd.DataFrame({layer: [pdf["layer"].iloc[0]], "effective_rank": [float(np.exp(-(p[p > 0] * np.log(p[p > 0])).sum()))]})

    return _summed(vectors, vector, layer).groupBy("layer").applyInPandas(final, f"{layer} long, effective_rank double")


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull of 2-D points, by a monotone chain."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return 0.0

    def chain(points: list) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    ring = np.array(chain(p) + chain(p[::-1]))
    x, y = ring[:, 0], ring[:, 1]
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of 2-D points in order, by a monotone chain; fewer than three points as they are."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return np.array(p).reshape(-1, 2)

    def chain(points: list) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull of 2-D points."""
    ring = hull(points)
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def collapse_metrics(vectors: DataFrame, layer: str, vector: str, bins: int = 10) -> DataFrame:
    """Of each layer's vectors: shares of the first two principal components, mean distance to the mean, entropy of a
    2-D histogram and hull area of the projection.

    Vectors are read three times and never gathered: for the moments, whose principal axes (two vectors a layer) go to
    the driver; for the distances, edges and hull of the projection, a few corners an Arrow batch; for the histogram.
    """
    axes: dict[int, tuple] = {}
    parts = _summed(vectors, vector, layer)
    sums = parts.groupBy("layer").applyInPandas(_axes, "layer long, n long, mean array<double>, one array<double>, two array<double>, first double, second double")
    for r in sums.collect():
        axes[r["layer"]] = (np.array(r["mean"]), np.array([r["one"], r["two"]]).T, r["first"], r["second"], r["n"])
    rows = vectors.select(F.col(layer).cast("long").alias("layer"), F.col(vector).alias("v")).where("v IS NOT NULL")

    def edges(batches):
        for pdf in batches:
            for key, part in pdf.groupby("layer"):
                x = np.stack(part["v"].to_numpy()) - axes[key][0]
                yield pd.DataFrame({"layer": [key], "spread": [np.linalg.norm(x, axis=1).sum()], "ring": [hull(x @ axes[key][1]).ravel().tolist()]})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = hull(np.concatenate([np.array(r).reshape(-1, 2) for r in pdf["ring"]]))
        return pd.DataFrame({"layer": [pdf["layer"].iloc[0]], "spread": [pdf["spread"].sum()], "hull_area": [hull_area(ring)], "box": [[*ring.min(0), *ring.max(0)]]})

    boxes = {r["layer"]: r for r in rows.mapInPandas(edges, "layer long, spread double, ring array<double>").groupBy("layer").applyInPandas(joined, "layer long, spread double, hull_area double, box array<double>").collect()}

    def counted(batches):
        for pdf in batches:
            for key, part in pdf.groupby("layer"):
                y = (np.stack(part["v"].to_numpy()) - axes[key][0]) @ axes[key][1]
                low, high = np.array(boxes[key]["box"]).reshape(2, 2)
                at = np.clip(np.floor((y - low) / np.maximum(high - low, 1e-300) * bins), 0, bins - 1).astype(int)
                cell, n = np.unique(at[:, 0] * bins + at[:, 1], return_counts=True)
                yield pd.DataFrame({"layer": key, "cell": cell, "n": n})

    share = F.col("n") / F.sum("n").over(W.partitionBy("layer"))
    cells = rows.mapInPandas(counted, "layer long, cell long, n long").groupBy("layer", "cell").agg(F.sum("n").alias("n"))
    entropy = cells.select("layer", (share * F.log(share)).alias("h")).groupBy("layer").agg((-F.sum("h")).alias("entropy"))
    found = [(k, a[2], a[3], boxes[k]["spread"] / a[4], boxes[k]["hull_area"]) for k, a in axes.items()]
    names = f"{layer} long, pc1_share double, pc2_share double, spread double, hull_area double"
    return vectors.sparkSession.createDataFrame([(int(k), *map(float, x)) for k, *x in found], names).join(entropy.withColumnRenamed("layer", layer), layer)


def _axes(parts: pd.DataFrame) -> pd.DataFrame:
    """A layer's count, mean, first two principal axes and their shares of the variance."""
    n, mean, cov = _covariance(parts)
    value, vector = np.linalg.eigh(cov)
    value, two = np.clip(value[::-1], 0, None), vector[:, ::-1][:, :2]
    share = value / max(value.sum(), 1e-300)
    return pd.DataFrame({"layer": [parts["layer"].iloc[0]], "n": [n], "mean": [mean.tolist()], "one": [two[:, 0].tolist()], "two": [two[:, -1].tolist()], "first": [share[0]], "second": [share[1] if len(share) > 1 else 0.0]})
