"""Fitting and applying dissimilarity models: spline design, non-negative IRLS, prediction.

One pass of the data per iteration gives the normal equations: each task sums its rows' Gram
matrix, Spark adds the sums entry by entry, and the driver solves a p x p non-negative problem.

Cases: rows with a null in a column that a fit uses are left out, and predictions of such rows are null; a fit without
complete rows is an error; predictors of one value get equal knots and a flat curve; repeated rows count each for itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from betascape.functions.scalar import basis, spline_sum
from betascape.operators.order import ranked_by
from betascape.operators.pairs import geographic_distance

ITERATIONS, TOLERANCE, EDGE = 12, 1e-4, 1e-10


@dataclass(frozen=True)
class Model:
    """Knots and coefficients by predictor; with ``geo`` the first entry is the distance between sites."""

    predictors: list[str]
    knots: list[list[float]]
    coefficients: list[list[float]]
    intercept: float = 0.0
    geo: bool = False
    null_deviance: float = 0.0
    deviance: float = 0.0
    n: int = 0
    extra: dict = field(default_factory=dict)

    @property
    def explained(self) -> float:
        return (self.null_deviance - self.deviance) / self.null_deviance * 100 if self.null_deviance else 0.0

    @property
    def splines(self) -> list[int]:
        return [len(k) for k in self.knots]

    def flat(self) -> list[float]:
        return [self.intercept, *(c for cs in self.coefficients for c in cs)]

    def with_flat(self, beta: Sequence[float]) -> Model:
        rest, out = list(beta[1:]), []
        for k in self.knots:
            out.append([float(x) for x in rest[: len(k)]])
            rest = rest[len(k) :]
        return replace(self, intercept=float(beta[0]), coefficients=out)


def save(model: Model, spark, path: str) -> None:
    """One row of Parquet, with the model as JSON."""
    spark.createDataFrame([(json.dumps(asdict(model)),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> Model:
    return Model(**json.loads(spark.read.parquet(path).first()["model"]))


def predictor_values(model: Model) -> list[tuple[Column, Column]]:
    """Both ends' values of each predictor; for the distance, itself and 0."""
    env = [(F.col(f"s1_{p}"), F.col(f"s2_{p}")) for p in model.predictors]
    return [(geographic_distance(None), F.lit(0.0)), *env] if model.geo else env


def design_columns(model: Model) -> list[Column]:
    """1, then |I(s2) - I(s1)| for every predictor and knot."""
    out = [F.lit(1.0)]
    for (a, b), knots in zip(predictor_values(model), model.knots, strict=True):
        out += [F.abs(y - x) for x, y in zip(basis(a, knots), basis(b, knots), strict=True)]
    return out


def design_matrix(pairs: DataFrame, model: Model) -> DataFrame:
    return pairs.withColumn("x", F.array(*design_columns(model)))


def ecological_distance(model: Model) -> Column:
    """Intercept and weighted design terms, straight as one expression; zero weights leave no trace."""
    total = F.lit(float(model.intercept))
    for (a, b), knots, coefs in zip(predictor_values(model), model.knots, model.coefficients, strict=True):
        terms = [F.abs(y - x) * float(c) for x, y, c in zip(basis(a, knots), basis(b, knots), coefs, strict=True) if c]
        for t in terms:
            total = total + t
    return total


def predict(pairs: DataFrame, model: Model, name: str = "predicted") -> DataFrame:
    return pairs.withColumn(name, 1 - F.exp(-ecological_distance(model)))


def predictor_curve(spark, model: Model, predictor: str, points: int = 200) -> DataFrame:
    """(x, response) of one predictor's spline at evenly spaced values between its outer knots."""
    at = model.predictors.index(predictor) + model.geo
    knots, coefs = model.knots[at], model.coefficients[at]
    x = F.lit(float(knots[0])) + F.col("id") * ((knots[-1] - knots[0]) / max(1, points - 1))
    return spark.range(points).select(x.alias("x")).withColumn("response", spline_sum(F.col("x"), knots, coefs))


def order_rank(n: int, k: int, i: int) -> int:
    """Place of knot i of k among n sorted values: the ends, and whole steps of n div (k - 1)."""
    return 0 if i == 0 else n - 1 if i == k - 1 else n // (k - 1) * i


def percentile_rank(n: int, percent: int) -> int:
    """The other variant: by percentage, rounded down or up as the remainder of n by it says."""
    if percent in (0, 100):
        return 0 if percent == 0 else n - 1
    p = percent / 100
    return int(np.floor(n * p) if np.fmod(n, p) < 0.5 else min(n - 1, np.ceil(n * p)))


def quantile_knots(pairs: DataFrame, predictors: Sequence[str], k: int = 3, geo: bool = False) -> list[list[float]]:
    """Order-statistic knots of each predictor over both ends (and of the distance first)."""
    return knots_by(pairs.withColumn("__set", F.lit(0)), "__set", predictors, k, geo)[0]


def knots_by(pairs: DataFrame, key: str, predictors: Sequence[str], k: int = 3, geo: bool = False) -> dict[object, list[list[float]]]:
    """The same for each value of a key."""
    ends = lambda s: F.struct(*[F.col(f"{s}_{p}").cast("double").alias(p) for p in predictors], (geographic_distance(None) if geo and s == "s1" else F.lit(None).cast("double")).alias("__geo"))
    both = pairs.select(F.col(key).alias("__key"), F.explode(F.array(ends("s1"), ends("s2"))).alias("v"))
    names = (["__geo"] if geo else []) + list(predictors)
    found = ranked_by(both, "__key", {p: F.col(f"v.{p}") for p in names}, lambda n: [order_rank(n, k, i) for i in range(k)])
    return {f: [out[p] for p in names] for f, out in found.items()}


def nnls(gram: np.ndarray, right: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """Least squares with x >= 0 from normal equations, by an active set; columns are scaled first."""
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    g, r = gram / np.outer(scale, scale), right / scale
    x, passive = np.zeros(len(r)), np.zeros(len(r), bool)
    for _ in range(30 * len(r) + 30):
        slope = r - g @ x
        free = ~passive & (slope > tolerance)
        if not free.any():
            break
        passive[np.argmax(np.where(free, slope, -np.inf))] = True
        while True:
            s = np.zeros(len(r))
            s[passive] = np.linalg.lstsq(g[np.ix_(passive, passive)], r[passive], rcond=1e-12)[0]
            low = passive & (s <= tolerance)
            if not low.any():
                break
            step = (x[low] / (x[low] - s[low] + 1e-300)).min()
            x = x + step * (s - x)
            passive &= x > tolerance
            x[~passive] = 0
        x = s
    return x / scale


def deviance_of(y: np.ndarray, mu: np.ndarray, w: np.ndarray) -> float:
    with np.errstate(divide="ignore", invalid="ignore"):
        one = np.where(y > 0, y * np.log(y / mu), 0.0)
        rest = np.where(y < 1, (1 - y) * np.log((1 - y) / (1 - mu)), 0.0)
    return float(2 * (w * (one + rest)).sum())


def row_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray | None, offset: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Normal equations of one step, and the deviance of the present fit, of some rows."""
    mu = (y * w + 0.5) / (w + 1) if beta is None else 1 - np.exp(-(x @ beta + offset))
    mu = np.clip(mu, EDGE, 1 - EDGE)
    eta = -np.log(1 - mu)
    weight = w * (1 - mu) / mu
    z = eta + (y - mu) / (1 - mu) - offset
    return (x * weight[:, None]).T @ x, x.T @ (weight * z), deviance_of(y, mu, w)


def iterate(step: Callable[[np.ndarray | None], tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Coefficients, and the deviance of the fit before the last solve."""
    beta, old = None, None
    for _ in range(ITERATIONS):
        gram, right, dev = step(beta)
        beta = nnls(gram, right)
        if old is not None and abs((dev - old) / (old + TOLERANCE)) < TOLERANCE:
            break
        old = dev
    return beta, dev


def fit_local(x: np.ndarray, y: np.ndarray, w: np.ndarray, offset: np.ndarray | float = 0.0) -> tuple[np.ndarray, float]:
    return iterate(lambda beta: row_sums(x, y, w, beta, offset))


def spark_step(rows: DataFrame, p: int) -> Callable[[np.ndarray | None], tuple[np.ndarray, np.ndarray, float]]:
    """The step over rows with columns x (array), y, w and o (offset)."""

    def step(beta: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float]:
        def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(p * p + p + 1)
            for b in it:
                if b.num_rows:
                    x = b.column(0).flatten().to_numpy().reshape(b.num_rows, p)
                    y, w, o = (b.column(k).to_numpy() for k in (1, 2, 3))
                    g, r, d = row_sums(x, y, w, beta, o)
                    total += np.concatenate([g.ravel(), r, [d]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "v"])

        found = rows.select("x", "y", "w", "o").mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        v = np.zeros(p * p + p + 1)
        for r in found:
            v[r.k] = r.v
        return v[: p * p].reshape(p, p), v[p * p : -1], float(v[-1])

    return step


def null_deviance(rows: DataFrame) -> float:
    """Deviance of the intercept alone, from rows with y and w; a row that stands for n of weight 1 has weight n.

    Its mean is the weighted mean of y, so one aggregation finds it and one more the deviance.
    """
    mean = rows.agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("m")).first()["m"]
    if mean is None:
        return 0.0
    mu, y = F.lit(min(max(float(mean), EDGE), 1 - EDGE)), F.col("y")
    one = F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) + F.when(y < 1, (1 - y) * F.log((1 - y) / (1 - mu))).otherwise(0.0)
    return float(rows.agg(F.sum(2 * F.col("w") * one).alias("d")).first()["d"])


def fit(pairs: DataFrame, predictors: Sequence[str], knots: list[list[float]] | None = None, geo: bool = False, n_knots: int = 3, fixed: Model | None = None) -> Model:
    """Fit to pairs with distance, weights and s1_*, s2_* columns; rows with a null are left out.

    ``fixed`` holds coefficients of predictors that stay as they are (a residual fit): its ecological
    distance is an offset, and only the given predictors are fitted.
    """
    need = ["distance", "weights", *[f"{s}_{p}" for s in ("s1", "s2") for p in predictors]] + ([f"{s}_{c}" for s in ("s1", "s2") for c in ("xCoord", "yCoord")] if geo else [])
    rows = pairs.dropna("any", subset=need)
    model = Model(list(predictors), knots or quantile_knots(rows, predictors, n_knots, geo), [], geo=geo)
    offset = ecological_distance(fixed) if fixed else F.lit(0.0)
    x = design_matrix(rows, model).select("x", F.col("distance").cast("double").alias("y"), F.col("weights").cast("double").alias("w"), offset.alias("o"))
    x = x.persist(StorageLevel.MEMORY_ONLY)  # what does not fit is worked out again, not written
    try:
        n = x.count()
        if not n:
            raise ValueError("no complete rows to fit")
        beta, dev = iterate(spark_step(x, 1 + sum(model.splines)))
        null = null_deviance(x)
    finally:
        x.unpersist()
    return replace(model.with_flat(beta), deviance=dev, null_deviance=null, n=n)


def glm_nnls(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, offset: np.ndarray | float = 0.0, family: str = "binomial", link: str = "negexp", iterations: int = 25, tolerance: float = 1e-8) -> dict:
    """General IRLS with non-negative coefficients, and step halving where the deviance would grow."""
    links = {
        "negexp": (lambda m: -np.log(1 - m), lambda e: 1 - np.exp(-e), lambda e: np.exp(-e)),
        "identity": (lambda m: m, lambda e: e, np.ones_like),
        "log": (np.log, np.exp, np.exp),
        "logit": (lambda m: np.log(m / (1 - m)), lambda e: 1 / (1 + np.exp(-e)), lambda e: np.exp(-e) / (1 + np.exp(-e)) ** 2),
    }
    variance = {"binomial": lambda m: m * (1 - m), "gaussian": np.ones_like, "poisson": lambda m: m}[family]
    loss = {
        "binomial": lambda m: deviance_of(y, m, w), "gaussian": lambda m: float((w * (y - m) ** 2).sum()),
        "poisson": lambda m: float(2 * (w * (np.where(y > 0, y * np.log(np.maximum(y, EDGE) / m), 0) - (y - m))).sum()),
    }[family]
    to_eta, to_mu, slope = links[link]
    w = np.ones(len(y)) if w is None else w
    bound = (lambda m: np.clip(m, EDGE, 1 - EDGE)) if family == "binomial" else (lambda m: np.maximum(m, EDGE)) if family == "poisson" else (lambda m: m)
    mu = bound((y * w + 0.5) / (w + 1) if family == "binomial" else y + (0.1 if family == "poisson" else 0))
    eta, beta, dev, converged = to_eta(mu), None, loss(mu), False
    for k in range(iterations):
        d = slope(eta)
        weight = w * d * d / variance(mu)
        new = nnls((x * weight[:, None]).T @ x, x.T @ (weight * (eta - offset + (y - mu) / d)))
        for _ in range(30):
            eta = x @ new + offset
            mu = bound(to_mu(eta))
            fresh = loss(mu)
            if np.isfinite(fresh) and (beta is None or fresh <= dev * (1 + 1e-12) + 1e-12):
                break
            new = (new + (beta if beta is not None else 0)) / 2
        converged = k > 0 and abs(fresh - dev) / (abs(fresh) + 0.1) < tolerance
        beta, dev = new, fresh
        if converged:
            break
    return {"coefficients": beta, "deviance": dev, "fitted": mu, "converged": converged, "iterations": k + 1}


def distance_residual_fit(match: np.ndarray, geographic: np.ndarray, ecological: np.ndarray) -> dict:
    """Two fits of match on distance: alone, and with the ecological distance as an offset."""
    x = np.stack([np.ones(len(match)), geographic], 1)
    return {"alone": glm_nnls(x, match), "residual": glm_nnls(x, match, offset=ecological)}


def mean_model(models: Sequence[Model]) -> Model:
    """Knots, coefficients and deviances averaged one by one."""
    avg = lambda rows: [[float(np.mean(v)) for v in zip(*ks, strict=True)] for ks in zip(*rows, strict=True)]
    return replace(
        models[0], knots=avg([m.knots for m in models]), coefficients=avg([m.coefficients for m in models]),
        intercept=float(np.mean([m.intercept for m in models])), deviance=float(np.mean([m.deviance for m in models])),
        null_deviance=float(np.mean([m.null_deviance for m in models])),
    )
