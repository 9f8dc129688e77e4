"""Scalar formulas as Column builders: no UDF, so they stay inside whole-stage codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def ispline(v: Column, q1: float, q2: float, q3: float) -> Column:
    """Quadratic I-spline: 0 up to q1, 1 from q3, and two parabolas that meet at q2."""
    v = v.cast("double")
    out = F.when(v <= q1, 0.0).when(v >= q3, 1.0)
    if q2 > q1:
        out = out.when(v < q2, (v - q1) / (q2 - q1) * ((v - q1) / (q3 - q1)))
    if q3 > q2:
        out = out.otherwise(1 - (q3 - v) / (q3 - q2) * ((q3 - v) / (q3 - q1)))
    return F.when(v.isNull(), F.lit(None).cast("double")).otherwise(out)


def spline_knots(knots: Sequence[float]) -> list[tuple[float, float, float]]:
    """The three knots of each basis function; the ends are doubled."""
    ends = [knots[0], *knots, knots[-1]]
    return [tuple(ends[i : i + 3]) for i in range(len(knots))]


def basis(v: Column, knots: Sequence[float]) -> list[Column]:
    return [ispline(v, *q) for q in spline_knots(knots)]


def spline_sum(v: Column, knots: Sequence[float], coefs: Sequence[float]) -> Column:
    """Weighted sum of the basis; functions of weight 0 are left out of the plan."""
    terms = [ispline(v, *q) * float(c) for q, c in zip(spline_knots(knots), coefs, strict=True) if c]
    return reduce(lambda a, b: a + b, terms) if terms else F.when(v.isNotNull(), 0.0)


def ispline_value(v: float, q1: float, q2: float, q3: float) -> float:
    """The same for one number, on the driver."""
    if v <= q1:
        return 0.0
    if v >= q3:
        return 1.0
    return (v - q1) / (q2 - q1) * ((v - q1) / (q3 - q1)) if v < q2 else 1 - (q3 - v) / (q3 - q2) * ((q3 - v) / (q3 - q1))


def spline_value(v: float, knots: Sequence[float], coefs: Sequence[float]) -> float:
    return sum(c * ispline_value(v, *q) for q, c in zip(spline_knots(knots), coefs, strict=True))


def sorensen(shared: Column, r1: Column, r2: Column, single: bool = False) -> Column:
    """1 - 2c / (r1 + r2); null for two empty sites.  ``single`` rounds as 32-bit arithmetic does."""
    total = (r1 + r2).cast("double")
    d = F.when(total > 0, 1 - F.lit(2.0) * shared.cast("double") / total)
    return d.cast("float").cast("double") if single else d


def bray_curtis(shared: Column, total: Column, empty: float) -> Column:
    """Dissimilarity 1 - 2 * shared / total, and ``empty`` where the total is 0."""
    return F.when(total > 0, 1 - F.lit(2.0) * shared / total).otherwise(F.lit(empty))


def pair_weight(r1: Column, r2: Column, kind: str = "one") -> Column:
    total = (r1 + r2).cast("double")
    return {"one": F.lit(1.0), "sum": total, "sqrt": F.sqrt(total)}[kind]


def decay(x: Column | float, a: float, b: Column | float, c: float) -> Column:
    """a + (1 - a) / (1 + (x / b) ^ c)."""
    return F.lit(float(a)) + (1.0 - a) / (1 + F.pow(num(x) / num(b), F.lit(float(c))))


def deviance_unit(y: Column, mu: Column) -> Column:
    """Contribution of one row to the deviance, before the factor of 2."""
    one = F.when(mu == 0, y).when(y == 0, 0.0).otherwise(y * F.log(y / mu))
    rest = F.when(mu == 1, 1 - y).when(y == 1, 1 - y).otherwise((1 - y) * F.log((1 - y) / (1 - mu)))
    return one + rest


def deviance(y: Column, mu: Column, w: Column | None = None) -> Column:
    unit = deviance_unit(y, mu)
    return F.lit(2.0) * F.sum(unit if w is None else w * unit)


def explained(null: Column, dev: Column) -> Column:
    """Per cent of the null deviance that is explained."""
    return (null - dev) / null * 100


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def dissimilarity(a: Column, b: Column) -> Column:
    """1 - exp(-L1) of transformed vectors."""
    return 1 - F.exp(-manhattan(a, b))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def gaussian_weight(d: Column, bandwidth: float) -> Column:
    return F.exp(F.lit(-0.5) * (d / bandwidth) * (d / bandwidth))


def link(mu: Column) -> Column:
    return -F.log(1 - mu)


def inverse_link(eta: Column) -> Column:
    return 1 - F.exp(-eta)


def bin_of(x: Column, width: float, bins: int) -> Column:
    """Number (from 1) of the bin (a, b] that holds x; bin 1 also holds its lower edge.

    Edges are k * width as doubles, so the cases compare with just these.
    """
    out = F.when((x >= 0) & (x <= width), 1)
    for k in range(2, bins + 1):
        out = out.when(x <= k * width, k)
    return F.when(x >= 0, out)


def hash_uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / float(1 << 40)


def lcg_uniform(key: Column, seed: int = 0) -> Column:
    """The same in arithmetic that any SQL engine repeats."""
    return F.pmod((key.cast("long") + seed) * 1103515245 + 12345, F.lit(2147483648)) / 2147483648.0


def site_key(x: Column, y: Column) -> Column:
    return F.concat_ws("_", x.cast("string"), y.cast("string"))


def folder(path: Column) -> Column:
    """A path that ends in a slash."""
    return F.when(path.rlike("/$"), path).otherwise(F.concat(path, F.lit("/")))


def clean_species(name: Column) -> Column:
    """First two words of a name; null if it holds a stop or comma, or its epithet is a letter or capitalised."""
    two = F.array_join(F.slice(F.split(F.trim(name), r"\s+"), 1, 2), " ")
    return F.when(~name.rlike("[.,]") & two.rlike(r"^\S+ [^A-Z\s]\S+$"), two)


#: Conic of EPSG:3577 on GRS80: semi-major axis, flattening, standard parallels, origin.
GRS80, ALBERS = (6378137.0, 1 / 298.257222101), (-18.0, -36.0, 0.0, 132.0)


def _albers_constants() -> tuple[float, ...]:
    a, f = GRS80
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def q(phi: float) -> float:
        s = math.sin(phi)
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m2(phi: float) -> float:
        return math.cos(phi) ** 2 / (1 - e2 * math.sin(phi) ** 2)

    p1, p2, p0 = (math.radians(x) for x in ALBERS[:3])
    n = (m2(p1) - m2(p2)) / (q(p2) - q(p1))
    c = m2(p1) + n * q(p1)
    return a, e2, e, n, c, a * math.sqrt(c - n * q(p0)) / n


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Projected x and y, in metres."""
    a, e2, e, n, c, rho0 = _albers_constants()
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho, theta = F.sqrt(c - n * q) * (a / n), F.radians(lon - ALBERS[3]) * n
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def albers_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a projected point, by the series from authalic to geographic latitude."""
    a, e2, e, n, c, rho0 = _albers_constants()
    up = F.lit(rho0) - y
    rho, theta = F.sqrt(x * x + up * up), F.atan2(x, up) if n > 0 else F.atan2(-x, -up)
    q = (c - (rho * n / a) * (rho * n / a)) / n
    pole = 1 - (1 - e2) / (2 * e) * math.log((1 - e) / (1 + e))
    b = F.asin(q / pole)
    e4, e6 = e2 * e2, e2**3
    lat = b + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * b) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * b) + 761 * e6 / 45360 * F.sin(6 * b)
    return F.degrees(theta / n) + ALBERS[3], F.degrees(lat)
