"""Classification of samples on the driver and of all cells in Spark.

Samples (cluster centres, trees, ordinations) are of a size that a parameter sets; cells are not.

Cases: an empty sample gives no classes, centres or points, and then no row is classified; asking for more classes than the
sample has rows gives one a row; ties go to the first; rows without a vector are in no class.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from betascape.functions.scalar import manhattan
from betascape.operators.grids import nearest


def ranks(x: np.ndarray) -> np.ndarray:
    """Ranks along rows, ties averaged."""
    out = np.empty(x.shape)
    for i, row in enumerate(x):
        _, inverse, count = np.unique(row, return_inverse=True, return_counts=True)
        out[i] = (np.cumsum(count) - (count - 1) / 2)[inverse]
    return out


def distance_matrix(x: np.ndarray, metric: str = "cityblock") -> np.ndarray:
    """Distances between rows: euclidean (mean square), cityblock (mean), and correlation kinds."""
    if metric in ("euclidean", "cityblock"):
        d = np.abs(x[:, None] - x[None])
        return (d**2).mean(2) if metric == "euclidean" else d.mean(2)
    if metric == "kendall":
        s = np.sign(x[:, :, None] - x[:, None, :]).reshape(len(x), -1)
        norm = np.sqrt((s**2).sum(1))
        return 1 - s @ s.T / np.maximum(np.outer(norm, norm), 1e-300)
    y = ranks(x) if metric == "spearman" else x
    y = y if metric.startswith("uncentered") or metric == "abs_uncentered" else y - y.mean(1, keepdims=True)
    norm = np.sqrt((y**2).sum(1))
    r = y @ y.T / np.maximum(np.outer(norm, norm), 1e-300)
    return 1 - np.abs(r) if metric.startswith("abs") else 1 - r


def linkage(distance: np.ndarray, method: str = "average", x: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Merges (left, right, distance); node n + k is the k-th merge.  ``centroid`` needs the vectors."""
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    n = len(d)
    name, size = list(range(n)), np.ones(n)
    centre = None if x is None else x.astype(float).copy()
    out = []
    live = np.ones(n, bool)
    for k in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        out.append((name[i], name[j], float(d[i, j])))
        others = live.copy()
        others[[i, j]] = False
        if method == "single":
            new = np.minimum(d[i], d[j])
        elif method == "maximum":
            new = np.maximum(np.where(others, d[i], -np.inf), np.where(others, d[j], -np.inf))
        elif method == "average":
            new = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        else:
            centre[i] = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
            new = ((centre - centre[i]) ** 2).mean(1)
        d[i] = d[:, i] = np.where(others, new, np.inf)
        d[j] = d[:, j] = np.inf
        size[i] += size[j]
        live[j] = False
        name[i] = n + k
    return out


def cut_tree(merges: list[tuple[int, int, float]], k: int) -> np.ndarray:
    """Class (0..k-1, in order of the first member) of each leaf of a tree cut into k."""
    n = len(merges) + 1
    k = min(max(k, 1), n)
    root = list(range(2 * n - 1))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for m, (a, b, _) in enumerate(merges[: n - k]):
        root[find(a)] = root[find(b)] = n + m
    tops = [find(i) for i in range(n)]
    order = {t: c for c, t in enumerate(dict.fromkeys(tops))}
    return np.array([order[t] for t in tops])


def k_clusters(x: np.ndarray, k: int, centre: str = "mean", metric: str = "cityblock", rounds: int = 100, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(classes, centres) of k-means, k-medians (``median``) or k-medoids (``medoid``)."""
    if not len(x):
        return np.empty(0, int), np.empty((0, x.shape[1] if x.ndim > 1 else 0))
    pick = [int(np.random.default_rng(seed).integers(len(x)))]
    while len(pick) < min(k, len(x)):  # farthest first
        d = np.abs(x[:, None] - x[pick][None]).sum(2).min(1)
        pick.append(int(d.argmax()))
    centres, classes = x[pick].astype(float), None
    for _ in range(rounds):
        diff = np.abs(x[:, None] - centres[None])
        new = ((diff**2) if metric == "euclidean" else diff).sum(2).argmin(1)
        if classes is not None and (new == classes).all():
            break
        classes = new
        for c in range(len(centres)):
            own = x[classes == c]
            if len(own):
                centres[c] = own.mean(0) if centre == "mean" else np.median(own, 0) if centre == "median" else own[np.abs(own[:, None] - own[None]).sum((1, 2)).argmin()]
    return classes, centres


def self_organising_map(x: np.ndarray, shape: tuple[int, int], rounds: int = 2000, rate: float = 0.5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(cells of the rows, weights) of a small map trained in place."""
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(*shape, x.shape[1])) * x.std(0) + x.mean(0)
    at = np.stack(np.meshgrid(*map(np.arange, shape), indexing="ij"), -1)
    reach = max(shape)
    for t in range(rounds):
        v = x[rng.integers(len(x))]
        best = np.array(np.unravel_index(((w - v) ** 2).sum(2).argmin(), shape))
        left = 1 - t / rounds
        near = np.sqrt(((at - best) ** 2).sum(2)) < max(1e-9, reach * left)
        w[near] += rate * left * (v - w[near])
    cells = np.array([np.unravel_index(((w - v) ** 2).sum(2).argmin(), shape) for v in x])
    return cells, w


def cluster_distance(x: np.ndarray, a: Sequence[int], b: Sequence[int], kind: str = "mean", metric: str = "cityblock") -> float:
    """Distance of two groups of rows: of means or medians, or least, largest or mean of pairs."""
    if kind in ("mean", "median"):
        f = np.mean if kind == "mean" else np.median
        return float(distance_matrix(np.stack([f(x[list(a)], 0), f(x[list(b)], 0)]), metric)[0, 1])
    d = distance_matrix(x, metric)[np.ix_(list(a), list(b))]
    return float({"least": d.min, "largest": d.max, "average": d.mean}[kind]())


def pco(distance: np.ndarray, axes: int = 3) -> np.ndarray:
    """Principal coordinates of a distance matrix, the largest axes first, signs fixed."""
    n = len(distance)
    j = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * j @ (distance**2) @ j)
    top = np.argsort(-values)[:axes]
    v = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
    return v * np.where(v[np.abs(v).argmax(0), range(v.shape[1])] < 0, -1, 1)


def to_rgb(x: np.ndarray) -> np.ndarray:
    spread = np.ptp(x, 0)
    return np.where(spread > 0, (x - x.min(0)) / np.where(spread > 0, spread, 1) * 255, 0).round().astype(int)


def farthest_first(x: np.ndarray, limit: float = 3.0, start: int = 0) -> list[int]:
    """Demand points: the farthest row from those chosen, until none is farther than the limit (L1)."""
    if not len(x):
        return []
    chosen, d = [start], np.abs(x - x[start]).sum(1)
    while d.max() > limit:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, np.abs(x - x[chosen[-1]]).sum(1))
    return chosen


def balanced_sample(rows: DataFrame, label: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """At most n rows of each class, those of least hash; a partial limit keeps n a task and class."""
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), key), key))
    return rows.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def subsample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def assign(rows: DataFrame, centres: np.ndarray, vector: str = "v") -> DataFrame:
    """Class and L1 distance of the nearest centre, as one expression; centres are few, and without any both are null."""
    if not len(centres):
        return rows.withColumn("class", F.lit(None).cast("int")).withColumn("class_distance", F.lit(None).cast("double"))
    each = [F.struct(manhattan(F.col(vector), F.array(*[F.lit(float(x)) for x in c])).alias("distance"), F.lit(k).alias("class")) for k, c in enumerate(centres)]
    best = F.array_min(F.array(*each))
    return rows.withColumn("__b", best).select("*", F.col("__b.class").alias("class"), F.col("__b.distance").alias("class_distance")).drop("__b")


def classify(rows: DataFrame, sample: DataFrame, k: int, key: str = "id", vector: str = "v", metric: str = "cityblock", method: str = "average") -> tuple[DataFrame, list[dict]]:
    """Hierarchical classes of a sample, given to all rows by their nearest sample row; and a legend.

    The legend has each class's size in the sample and its colour, from principal coordinates of class means.
    """
    held = sample.where(F.col(vector).isNotNull()).select(key, vector).orderBy(key).toPandas()
    if not len(held):
        return rows.limit(0).select(key, F.lit(None).cast("int").alias("class")), []
    x = np.array(held[vector].to_list(), float)
    classes = cut_tree(linkage(distance_matrix(x, metric), method, x), k)
    means = np.stack([x[classes == c].mean(0) for c in range(classes.max() + 1)])
    colours = to_rgb(pco(np.abs(means[:, None] - means[None]).sum(2)))
    spark = rows.sparkSession
    training = spark.createDataFrame([(i, int(c), [float(z) for z in v]) for i, c, v in zip(held[key].tolist(), classes, x, strict=True)], "tid long, label int, v array<double>")
    found = nearest(rows, training, 1, key, vector).select(F.col("id").alias(key), F.col("label").alias("class"))
    legend = [{"class": c, "n": int((classes == c).sum()), "rgb": colours[c].tolist()} for c in range(len(means))]
    return found, legend
