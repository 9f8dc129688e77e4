"""Raster cells as rows (row, col, one column per layer): lookups, transforms, change, classes, density.

Cases: (row, col) is distinct; a null in a layer gives a null in all that needs it, and no distance; points outside have null
layers; neighbours at one distance come by their id; rows without a vector have no neighbours; empty tables give empty results,
and a grid's range, or principal component, of one value is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from betascape.functions.scalar import albers, albers_inverse, manhattan, spline_sum, spline_value
from betascape.operators.blocks import FIRST, SECOND, block_join
from betascape.operators.model import Model
from betascape.operators.order import quantiles
from betascape.operators.pairs import attach
from betascape.sources.grid import Header

METHODS = ("Clamped", "Conservative", "End10", "WholeGrad")


def cell_of(x: Column, y: Column, h: Header) -> tuple[Column, Column]:
    """(row, col) of the cell that holds a point; rows count from the top."""
    return F.floor((h.ymax - y) / h.cellsize).cast("int"), F.floor((x - h.xll) / h.cellsize).cast("int")


def extract(points: DataFrame, cells: DataFrame, h: Header, layers: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Layer values at points; null outside the grid and where it has none."""
    r, c = cell_of(F.col(x), F.col(y), h)
    return points.withColumn("row", r).withColumn("col", c).join(cells.select("row", "col", *layers), ["row", "col"], "left").drop("row", "col")


def extract_pairs(pairs: DataFrame, cells: DataFrame, h: Header, layers: Sequence[str]) -> DataFrame:
    """Layer values at both ends of pairs (s1_xCoord, ...), as s1_* and s2_*."""
    for s in ("s1", "s2"):
        named = cells.select("row", "col", *[F.col(k).alias(f"{s}_{k}") for k in layers])
        pairs = extract(pairs, named, h, [f"{s}_{k}" for k in layers], f"{s}_xCoord", f"{s}_yCoord")
    return pairs


def extract_all_pairs(pairs: DataFrame, sites: DataFrame, cells: DataFrame, h: Header, layers: Sequence[str]) -> DataFrame:
    """The same for all pairs (i, j) of the sites (site, xCoord, yCoord): values are looked up once a site."""
    return attach(pairs, extract(sites.select("site", "xCoord", "yCoord"), cells, h, layers, "xCoord", "yCoord"), layers, every=True)


def centroids(spark, h: Header) -> DataFrame:
    r, c = F.floor(F.col("id") / h.ncols).cast("int"), (F.col("id") % h.ncols).cast("int")
    return spark.range(h.nrows * h.ncols).select(r.alias("row"), c.alias("col"), (F.lit(h.xll) + (c + 0.5) * h.cellsize).alias("x"), (F.lit(h.ymax) - (r + 0.5) * h.cellsize).alias("y"))


def layer_ranges(cells: DataFrame, layers: Sequence[str]) -> DataFrame:
    """(layer, min, max, n) of each layer's cells with values, from one aggregation."""
    one = cells.agg(*[F.struct(F.lit(k).alias("layer"), F.min(k).cast("double").alias("min"), F.max(k).cast("double").alias("max"), F.count(k).alias("n")).alias(k) for k in layers])
    return one.select(F.inline(F.array(*layers)))


def conforms(a: Header, b: Header) -> bool:
    return (a.ncols, a.nrows) == (b.ncols, b.nrows) and all(math.isclose(x, y, abs_tol=1e-9) for x, y in ((a.xll, b.xll), (a.yll, b.yll), (a.cellsize, b.cellsize)))


def one_sided(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    """Counts of cells that have a value in one grid only."""
    have = [d.where(F.col(value).isNotNull()).select("row", "col", F.lit(1).alias(k)) for d, k in ((a, "in_a"), (b, "in_b"))]
    joined = have[0].join(have[1], ["row", "col"], "full_outer")
    return joined.agg(F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"))


def lines(knots: Sequence[float], coefs: Sequence[float], method: str, edge_mode: str = "compat") -> tuple[tuple[float, float], tuple[float, float]]:
    """(slope, constant) of the lines below and above the knots.

    Edge slopes are taken over a tenth of the range at the top and, as the fitted maps have it, over
    a hundredth at the bottom (``compat``); ``documented`` takes a tenth at both ends.  Conservative
    compares the edge line with the line over all knots at a further tenth of the same stretch outside,
    and takes the lower at the top and the higher at the bottom.  Unknown methods mean Conservative.
    """
    lo, hi = knots[0], knots[-1]
    f = lambda v: spline_value(v, knots, coefs)
    y_lo, y_hi = f(lo), f(hi)
    if method == "Clamped":
        return (0.0, 0.0), (0.0, float(sum(coefs)))
    if hi == lo:
        return (0.0, y_lo), (0.0, y_hi)
    whole = ((y_hi - y_lo) / (hi - lo), y_lo - lo * (y_hi - y_lo) / (hi - lo))
    if method == "WholeGrad":
        return whole, whole
    top = (hi - lo) / 10
    bottom = top / 10 if edge_mode == "compat" else top
    m_hi, m_lo = (y_hi - f(hi - top)) / top, (f(lo + bottom) - y_lo) / bottom
    edge_hi, edge_lo = (m_hi, y_hi - hi * m_hi), (m_lo, y_lo - lo * m_lo)
    if method == "End10":
        return edge_lo, edge_hi
    at = lambda line, x: line[0] * x + line[1]
    x_hi, x_lo = hi + top / 10, lo - bottom / 10
    return (whole if at(whole, x_lo) > at(edge_lo, x_lo) else edge_lo), (whole if at(whole, x_hi) < at(edge_hi, x_hi) else edge_hi)


def transformed(v: Column, knots: Sequence[float], coefs: Sequence[float], method: str = "Conservative", edge_mode: str = "compat") -> Column:
    (m0, c0), (m1, c1) = lines(knots, coefs, method, edge_mode)
    return F.when(v < knots[0], v * m0 + c0).when(v > knots[-1], v * m1 + c1).otherwise(spline_sum(v, knots, coefs))


def transform_grids(cells: DataFrame, model: Model, method: str = "Conservative", h: Header | None = None, edge_mode: str = "compat") -> DataFrame:
    """Every layer through its predictor's spline, as one projection; with geo also the grids of x and y.

    Predictors without weight are left out.
    """
    if absent := [p for p in model.predictors if p not in cells.columns]:
        raise ValueError(f"no layers for {absent}")
    out = [transformed(F.col(p).cast("double"), k, c, method, edge_mode).alias(p) for p, k, c in zip(model.predictors, model.knots[model.geo :], model.coefficients[model.geo :], strict=True) if any(c)]
    if model.geo:
        if h is None:
            raise ValueError("the grids of x and y need a header")
        mask = F.col(model.predictors[-1]).isNotNull() if model.predictors else F.lit(True)
        for name, at in (("GeoX", "col"), ("GeoY", "row")):
            d = F.col(at) * F.lit(h.cellsize)
            out.append(F.when(mask, transformed(d, model.knots[0], model.coefficients[0], "Clamped")).alias(name))
    return cells.select("row", "col", *out)


def extrapolation(cells: DataFrame, model: Model, method: str = "Conservative") -> DataFrame:
    """Per cell the summed absolute part of the transforms that lies beyond the ends of the fitted curves."""
    total = F.lit(0.0)
    for p, k, c in zip(model.predictors, model.knots[model.geo :], model.coefficients[model.geo :], strict=True):
        v = F.col(p).cast("double")
        out = transformed(v, k, c, method)
        total = total + F.when(v < k[0], F.abs(out - spline_value(k[0], k, c))).when(v > k[-1], F.abs(out - spline_value(k[-1], k, c))).otherwise(0.0)
    return cells.select("row", "col", total.alias("extrapolation"))


def categorical_transform(cells: DataFrame, layer: str, reference: int, table: DataFrame, knots: Sequence[float], coefs: Sequence[float]) -> DataFrame:
    """Spline of the tabled distance (class_a, class_b, dist, symmetric) between each cell's class and a reference."""
    both = table.select("class_a", "class_b", "dist").union(table.select("class_b", "class_a", "dist")).distinct()
    to = both.where(F.col("class_b") == reference).select(F.col("class_a").alias(layer), "dist")
    d = F.when(F.col(layer) == reference, 0.0).otherwise(F.col("dist"))
    return cells.join(to, layer, "left").select("row", "col", spline_sum(d, knots, coefs).alias(layer))


def combine(cells: DataFrame, names: Sequence[str], out: str) -> DataFrame:
    return cells.withColumn(out, sum((F.col(n) for n in names), F.lit(0.0)))


def l1(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return sum((F.abs(x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))


def two_epoch(first: DataFrame, second: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Dissimilarity of each cell between two epochs of transformed layers."""
    other = second.select("row", "col", *[F.col(k).alias(f"__{k}") for k in layers])
    d = l1([F.col(k) for k in layers], [F.col(f"__{k}") for k in layers])
    return first.join(other, ["row", "col"]).select("row", "col", (1 - F.exp(-d)).alias("dissimilarity"))


def numbers(t: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Columns side by side as doubles; null is NaN."""
    return np.stack([t.column(n).to_numpy().astype(float) for n in names], 1) if names else np.zeros((t.num_rows, 0))


def impact(first: DataFrame, second: DataFrame, points: DataFrame, layers: Sequence[str]) -> DataFrame:
    """For each demand point the least dissimilarity to any cell, in either epoch, and the change.

    Cells and points meet block by block.  Cells, and points, with a null in a layer have no distance;
    a point without any has null results.
    """
    layers = list(layers)

    def least(cells: pa.Table, some: pa.Table) -> pa.Table:
        x, p = numbers(cells, layers), numbers(some, layers)
        x = x[~np.isnan(x).any(1)]
        d = [np.abs(x - q).sum(1).min(initial=np.inf) if not np.isnan(q).any() else np.inf for q in p]
        found = pa.array([v if np.isfinite(v) else None for v in d], pa.float64())
        return pa.table({"point": some.column("point"), "d": found})

    out = points.select("point")
    named = points.select("point", *[F.col(c).cast("double").alias(c) for c in layers])
    for k, cells in ((0, first), (1, second)):
        met = block_join(cells.select(*[F.col(c).cast("double").alias(c) for c in layers]), named, least, f"point {dict(points.dtypes)['point']}, d double")
        out = out.join(met.groupBy("point").agg((1 - F.exp(-F.min("d"))).alias(f"d{k}")), "point", "left")
    return out.withColumn("difference", F.col("d1") - F.col("d0"))


def impact_totals(table: DataFrame) -> DataFrame:
    return table.agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"), F.sum("difference").alias("difference"), (F.sum("difference") * 100 / F.count("*")).alias("percent_lost"))


def point_table(points: DataFrame, layers: Sequence[str], similarity: bool = False) -> DataFrame:
    """(a, b, value) for all pairs of demand points."""
    other = points.select([F.col(c).alias(f"{c}_2") for c in points.columns])
    d = l1([F.col(c) for c in layers], [F.col(f"{c}_2") for c in layers])
    value = F.exp(-d) if similarity else 1 - F.exp(-d)
    return points.join(other, F.col("point") < F.col("point_2")).select(F.col("point").alias("a"), F.col("point_2").alias("b"), value.alias("value"))


def class_vectors(rows: DataFrame, label: str, vector: str, how: str = "mean") -> DataFrame:
    """(label, n, vector): means or medians of each component by class."""
    long = rows.select(F.col(label).alias("__label"), F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    each = long.groupBy("__label", "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    if how != "mean":
        middle = quantiles(long, ["__label", "pos"], "x", [0.5]).select(F.col("__label").alias("__own"), F.col("pos").alias("__pos"), F.get("q", F.lit(0)).alias("__m"))
        each = each.join(middle, F.col("__label").eqNullSafe(F.col("__own")) & (F.col("pos") == F.col("__pos")), "left").select("__label", "pos", F.col("__m").alias("x"), "n")
    vectors = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return each.groupBy(F.col("__label").alias(label)).agg(F.max("n").alias("n"), vectors.alias(vector))


def class_similarity(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(a, b, similarity): exp(-L1) of class vectors, a <= b; classes are few."""
    other = vectors.select(F.col(label).alias("b"), F.col(vector).alias("__v"))
    return vectors.join(other, F.col(label) <= F.col("b")).select(F.col(label).alias("a"), "b", F.exp(-manhattan(F.col(vector), F.col("__v"))).alias("similarity"))


def density(cells: DataFrame, sample: DataFrame, layers: Sequence[str], share: float, condition: str | None = None, block: int = SECOND) -> DataFrame:
    """Sum over sampled cells of exp(-L1) (times their condition), scaled up by the share sampled.

    Cells meet the sample block by block.  Sampled cells with a null add nothing; cells with one have a null sum.
    """
    layers = list(layers)

    def sums(some: pa.Table, held: pa.Table) -> pa.Table:
        x, s = numbers(some, layers), numbers(held, [*layers, "__w"])
        s = s[~np.isnan(s).any(1)]
        out = np.full(len(x), np.nan)
        for lo in range(0, len(x), 64):
            part = x[lo : lo + 64]
            out[lo : lo + 64] = (np.exp(-sum(np.abs(part[:, k, None] - s[None, :, k]) for k in range(len(layers)))) * s[:, -1]).sum(1)
        known = ~np.isnan(x).any(1) & (len(s) > 0)
        return pa.table({"row": some.column("row"), "col": some.column("col"), "v": pa.array(np.where(known, out, 0.0), mask=~known)})

    w = F.col(condition) if condition else F.lit(1.0)
    held = sample.select(*[F.col(c).cast("double").alias(c) for c in layers], w.cast("double").alias("__w"))
    some = cells.select("row", "col", *[F.col(c).cast("double").alias(c) for c in layers])
    types = dict(cells.dtypes)
    met = block_join(some, held, sums, f"row {types['row']}, col {types['col']}, v double", (FIRST, block))
    return met.groupBy("row", "col").agg((F.sum("v") / share).alias("density"))


def nearest(rows: DataFrame, training: DataFrame, k: int, key: str = "id", vector: str = "v", label: str = "label", block: int = SECOND) -> DataFrame:
    """(id, label, tid, dist, rank): the k nearest training rows (tid, label, v) by L1, ties by tid.

    Rows meet training rows block by block, and the bests of the blocks are merged.  In a block the distance to a
    pivot bounds that to a row: only those within the k-th best of a first few are measured.
    """
    types = dict(training.dtypes)
    schema = f"id {dict(rows.dtypes)[key]}, label {types[label]}, tid {types['tid']}, dist double"

    def best(some: pa.Table, held: pa.Table) -> pa.Table:
        x, t = (np.array(c.column("v").to_pylist(), float) for c in (some, held))
        tid = held.column("tid").to_numpy(zero_copy_only=False)
        pivot = t.mean(0)
        far = np.abs(t - pivot).sum(1)
        order = np.argsort(far, kind="stable")
        t, tid, far = t[order], tid[order], far[order]
        n = min(k, len(t))
        at: list[np.ndarray] = []
        dist: list[np.ndarray] = []
        for v, own in zip(x, np.abs(x - pivot).sum(1), strict=True):
            mid = min(max(0, int(np.searchsorted(far, own)) - 2 * n), max(0, len(t) - 4 * n))
            bound = np.partition(np.abs(t[mid : mid + 4 * n] - v).sum(1), n - 1)[n - 1] * (1 + 1e-12)
            lo, hi = np.searchsorted(far, own - bound - 1e-9), np.searchsorted(far, own + bound + 1e-9, "right")
            d = np.abs(t[lo:hi] - v).sum(1)
            near = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1])
            near = near[np.lexsort((tid[lo:hi][near], d[near]))[:n]]
            at.append(order[lo + near])
            dist.append(d[near])
        chosen = pa.array(np.concatenate(at))
        ids = some.column("id").take(pa.array(np.repeat(np.arange(len(x)), [len(a) for a in at])))
        return pa.table({"id": ids, "label": held.column("label").take(chosen), "tid": held.column("tid").take(chosen), "dist": np.concatenate(dist)})

    queries = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    held = training.select("tid", F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    found = block_join(queries.where("v IS NOT NULL"), held.where("v IS NOT NULL"), best, schema, (FIRST, block))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("dist", "tid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def class_probability(near: DataFrame, r: float) -> DataFrame:
    """(id, label, p): kernel weights exp(-d^2 / (2 (r * mean d)^2)) of the neighbours, normalised, by class."""
    mean = F.avg("dist").over(Window.partitionBy("id"))
    theta = 2 * (mean * r) * (mean * r)
    rows = near.withColumn("w", F.when(theta > 0, F.exp(-(F.col("dist") * F.col("dist")) / theta)).otherwise(0.0))
    rows = rows.groupBy("id", "label").agg(F.sum("w").alias("w"))
    total = F.sum("w").over(Window.partitionBy("id"))
    return rows.select("id", "label", F.when(total > 0, F.col("w") / total).otherwise(0.0).alias("p"))


def masked(rows: DataFrame, mask: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Rows whose keys the mask has; a mask may name a key twice."""
    return rows.join(mask.select(*keys).distinct(), list(keys), "left_semi")


def probability_change(first: DataFrame, second: DataFrame, training: DataFrame, k: int, r: float) -> DataFrame:
    """(id, label, p0, p1, difference): class probabilities of rows in two epochs, 0 where an epoch's neighbours have no such class.

    Rows of one epoch alone are left out.
    """
    both = first.select("id").join(second.select("id"), "id", "left_semi").distinct()
    sides = [class_probability(nearest(masked(e, both), training, k), r).withColumnRenamed("p", f"p{n}") for n, e in enumerate((first, second))]
    p = lambda n: F.coalesce(f"p{n}", F.lit(0.0))
    return sides[0].join(sides[1], ["id", "label"], "full_outer").select("id", "label", p(0).alias("p0"), p(1).alias("p1"), (p(1) - p(0)).alias("difference"))


def best_jr(training: DataFrame, js: Sequence[int] | None = None, rs: Sequence[float] | None = None, objective: str = "compat") -> tuple[int, float, DataFrame]:
    """(J, R) whose leave-one-out class probabilities score best, and all scores.

    By default J is 30 to 100, or to what the table allows, and R 0.1 to 0.9.  The score is the summed squared
    shortfall of the true class's probability, by J.  ``compat`` takes the largest, and the first R whose best J is not at
    an end; ``min`` the smallest of all.  One table of neighbours serves all settings.
    """
    rs = list(rs) if rs is not None else [k / 10 for k in range(1, 10)]
    if js is None:
        top = min(100, training.count() - 1)
        js = range(min(30, top), top + 1)
    js = list(js)
    near = nearest(training.withColumn("id", F.col("tid")), training, max(js) + 1).where(F.col("tid") != F.col("id"))
    own = training.select(F.col("tid").alias("id"), F.col("label").alias("own"))
    near = near.join(own, "id").groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "tid", F.col("label").eqNullSafe(F.col("own")).alias("same")))), 1, max(js)).alias("x"))
    near = own.select("id").join(near, "id", "left").select(F.transform("x", lambda x: x["dist"]).alias("dist"), F.transform("x", lambda x: x["same"]).alias("same"))

    def shortfalls(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(js), len(rs)))
        for b in it:
            for dist, same in zip(*(b.column(c).to_pylist() for c in range(2)), strict=True):
                d, s = np.array(dist or [], float), np.array(same or [], bool)
                for a, j in enumerate(js):
                    x = d[:j]
                    mean = x.mean() if len(x) else 0.0
                    theta = 2 * (mean * np.array(rs)) ** 2
                    w = np.exp(-(x[None] ** 2) / np.where(theta > 0, theta, 1.0)[:, None]) * (theta > 0)[:, None]
                    whole = w.sum(1)
                    p = np.where(whole > 0, w[:, s[:j]].sum(1) / np.where(whole > 0, whole, 1.0), 0.0)
                    total[a] += (1 - p) ** 2
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(js, len(rs)).astype(np.int32)), pa.array(np.tile(rs, len(js)).astype(float)), pa.array(total.ravel())], ["j", "r", "sos"])

    scores = near.mapInArrow(shortfalls, "j int, r double, sos double").groupBy("j", "r").agg(F.sum("sos").alias("sos"))
    rows = scores.select("j", "r", (F.col("sos") / F.col("j")).alias("score")).collect()
    if objective == "min":
        best = min(rows, key=lambda x: (x.score, x.r, x.j))
    else:
        best = max(rows, key=lambda x: (x.score, -x.r, -x.j))
        for r in rs:
            top = max((x for x in rows if x.r == r), key=lambda x: (x.score, -x.j))
            if min(js) < top.j < max(js):
                best = top
                break
    return best.j, best.r, training.sparkSession.createDataFrame(rows, "j int, r double, score double")


def zonal_counts(zones: DataFrame, data: DataFrame, zone: str = "zone", value: str = "value") -> DataFrame:
    joined = zones.join(data, ["row", "col"])
    return joined.groupBy(zone).agg(F.count(value).alias("n_cells"), F.sum(F.col(value).cast("double")).alias("total"), F.avg(F.col(value).cast("double")).alias("mean"))


def crosstab(classes: DataFrame, regions: DataFrame, names: Sequence | None = None) -> DataFrame:
    """Cells of each class by region; region columns are named r_*."""
    joined = classes.join(regions, ["row", "col"])
    names = sorted(r[0] for r in regions.select("region").distinct().collect()) if names is None else list(names)
    return joined.groupBy("class").agg(*[F.count_if(F.col("region") == n).alias(f"r_{n}") for n in names])


def site_by_species(comp: DataFrame, species: Sequence | None = None, abundance: str | None = None) -> DataFrame:
    """Presence (or summed abundance) of all species, one row a site: a map that leaves out absent species.

    With a list of species, a wide table of these only, with zeros.
    """
    if species is None:
        held = comp.where("species IS NOT NULL").groupBy("site", "species").agg((F.sum(abundance).cast("double") if abundance else F.lit(1)).alias("v"))
        return held.groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("species", "v")))).alias("species"))
    value = (lambda s: F.sum(F.when(F.col("species") == s, F.col(abundance)).otherwise(0))) if abundance else (lambda s: F.max((F.col("species") == s).cast("int")))
    return comp.groupBy("site").agg(*[value(s).alias(f"sp_{s}") for s in species])


def response_and_weights(sxs: DataFrame, species: Sequence) -> DataFrame:
    """(site, species, response, weight): the wide table back as rows, weight the site's total."""
    pairs = F.array(*[F.struct(F.lit(s).alias("species"), F.col(f"sp_{s}").cast("double").alias("response")) for s in species])
    total = sum((F.col(f"sp_{s}").cast("double") for s in species), F.lit(0.0))
    return sxs.select("site", total.alias("weight"), F.inline(pairs)).select("site", "species", "response", "weight")


def pca_rgb(cells: DataFrame, layers: Sequence[str]) -> DataFrame:
    """First three principal components of the layers, scaled to 0..255 by their ranges.

    Axes come from the covariance of all cells, by one aggregation.
    """
    rows = cells.dropna("any", subset=list(layers))
    stats = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in layers], *[F.covar_samp(a, b).alias(f"c_{a}_{b}") for a in layers for b in layers]).first()
    if not stats["n"]:
        return rows.select("row", "col", *[F.lit(None).cast("double").alias(f"pc{i + 1}") for i in range(min(3, len(layers)))])
    cov = np.nan_to_num(np.array([[stats[f"c_{a}_{b}"] for b in layers] for a in layers], float))
    values, vectors = np.linalg.eigh(cov)
    top = vectors[:, np.argsort(-values)[:3]]
    top = top * np.where(top[np.abs(top).argmax(0), range(top.shape[1])] < 0, -1, 1)
    pcs = [sum((F.col(c) - float(stats[f"m_{c}"])) * float(top[k, i]) for k, c in enumerate(layers)).alias(f"pc{i + 1}") for i in range(top.shape[1])]
    out = rows.select("row", "col", *pcs)
    names = [f"pc{i + 1}" for i in range(top.shape[1])]
    ends = out.agg(*[f(c).alias(f"{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))])
    scale = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * 255).otherwise(0.0)
    return out.join(F.broadcast(ends)).select("row", "col", *[scale(c).alias(c) for c in names])


def projected_extent(spark, h: Header) -> tuple[float, float, float, float]:
    """(xmin, xmax, ymin, ymax) of a geographic grid's edge, projected."""
    edge = centroids(spark, h).where((F.col("row") == 0) | (F.col("row") == h.nrows - 1) | (F.col("col") == 0) | (F.col("col") == h.ncols - 1))
    x, y = albers(F.col("x"), F.col("y"))
    e = edge.select(x.alias("px"), y.alias("py")).agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    return tuple(e)


def reproject(cells: DataFrame, source: Header, target: Header, layers: Sequence[str]) -> DataFrame:
    """Layers of a geographic grid on a projected one: each target cell takes the source cell at its centre."""
    lon, lat = albers_inverse(F.col("x"), F.col("y"))
    points = centroids(cells.sparkSession, target).select(F.col("row").alias("__r"), F.col("col").alias("__c"), lon.alias("lon"), lat.alias("lat"))
    found = extract(points, cells, source, layers, "lon", "lat")
    return found.select(F.col("__r").alias("row"), F.col("__c").alias("col"), *layers)


def transform_points(points: DataFrame, cells: DataFrame, h: Header, model: Model, method: str = "Conservative") -> DataFrame:
    """Transformed layers at points, for training tables: all columns of the points and one per predictor."""
    return extract(points, transform_grids(cells, model, method, h), h, [p for p, c in zip(model.predictors, model.coefficients[model.geo :], strict=True) if any(c)])
