"""Measures of fits and of samples: deviance, errors, binned errors, evenness, summaries.

Cases: rows with a null in what is measured are left out; values on an edge are in the bin below; of empty tables counts are 0,
all else null; the evenness of less than two numbers, or of zeros, is null, and so is a correlation with a constant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from betascape.functions.scalar import bin_of, deviance
from betascape.operators.order import quantiles


def correlation(a: str, b: str) -> Column:
    """Pearson's, over rows that have both; null where either is constant."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def error_metrics(df: DataFrame, y: str = "distance", mu: str = "predicted") -> DataFrame:
    """Deviance, mean error, mean absolute error, root mean square error and correlation, in one pass."""
    e = F.col(mu) - F.col(y)
    return df.agg(
        deviance(F.col(y), F.col(mu)).alias("deviance"), F.avg(e).alias("me"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"), correlation(y, mu).alias("corr"),
    )


def rmse_by_bin(df: DataFrame, y: str = "distance", mu: str = "predicted", width: float = 0.05, bins: int = 20) -> DataFrame:
    e = F.col(mu) - F.col(y)
    rows = df.withColumn("bin", bin_of(F.col(y), width, bins)).where("bin IS NOT NULL")
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"))


def equalised_rmse(df: DataFrame, **options) -> DataFrame:
    """Mean of the bins' errors, bins without rows left out."""
    return rmse_by_bin(df, **options).agg(F.avg("rmse").alias("ermse"))


def histogram(df: DataFrame, x: str, width: float = 0.025, bins: int = 40, times: str | None = None) -> DataFrame:
    """(bin, n) for all bins, empty ones with 0.  A row counts as often as its column ``times`` says, if that is named."""
    n = F.col(times) if times else F.lit(1)
    counts = df.select(bin_of(F.col(x), width, bins).alias("bin"), n.alias("n")).groupBy("bin").agg(F.sum("n").alias("n"))
    all_ = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return all_.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def gini(df: DataFrame, x: str = "n") -> DataFrame:
    """Unbiased Gini coefficient of a column: ranks come from counts of equal values, so no task sorts all."""
    values = df.groupBy(F.col(x).cast("double").alias("v")).agg(F.count("*").alias("k"))
    # Ranks below a value: a sum over smaller values, joined through one sorted array of (v, k).
    total = values.agg(F.array_sort(F.collect_list(F.struct("v", "k"))).alias("a"))
    begin = F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("s"), F.lit(0.0).alias("t"))
    add = lambda a, p: F.struct(
        (a["r"] + p["k"]).alias("r"), (a["s"] + p["v"] * p["k"] * (a["r"] + (p["k"] + 1) / 2)).alias("s"), (a["t"] + p["v"] * p["k"]).alias("t")
    )
    m = total.select(F.aggregate("a", begin, add).alias("m")).select("m.r", "m.s", "m.t")
    g = (F.lit(2.0) * F.col("s") / (F.col("r") * F.col("t")) - (F.col("r") + 1) / F.col("r")) * F.col("r") / (F.col("r") - 1)
    return m.select(F.when((F.col("r") > 1) & (F.col("t") > 0), g).alias("gini"))


def evenness(df: DataFrame, x: str = "n") -> DataFrame:
    return gini(df, x).select((1 - F.col("gini")).alias("evenness"))


def six_numbers(df: DataFrame, x: str) -> DataFrame:
    """Least, quartiles, mean and largest; quartiles interpolate linearly.  All null without values."""
    v = F.col(x).cast("double")
    whole = df.agg(F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"))
    q = quantiles(df.select(v.alias("v")), [], "v", (0.25, 0.5, 0.75))
    return whole.join(F.broadcast(q)).select("min", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), "mean", F.get("q", F.lit(2)).alias("q3"), "max")


def site_use(pairs: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, n): how often each site is an end of a pair, unused ones with 0."""
    used = pairs.select(F.explode(F.array("i", "j")).alias("site")).groupBy("site").agg(F.count("*").alias("n"))
    return sites.select("site").join(used, "site", "left").select("site", F.coalesce("n", F.lit(0)).alias("n"))


def box(z: Column, origin: float | Column, width: float | Column) -> Column:
    return F.ceil((z - origin) / width).cast("long")


def box_counts(sites: DataFrame, ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_sites, n) for boxes that hold a site; n counts pair ends there, 0 if none."""
    own = sites.groupBy(*keys).agg(F.count("*").alias("n_sites"))
    used = ends.groupBy(*keys).agg(F.count("*").alias("n"))
    return own.join(used, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def spatial_boxes(sites: DataFrame, pairs: DataFrame, width: float) -> DataFrame:
    """Boxes of the plane (site, x, y) with their sites and pair ends."""
    e = sites.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    boxed = sites.join(F.broadcast(e)).select("site", box(F.col("x"), F.col("x0"), width).alias("bx"), box(F.col("y"), F.col("y0"), width).alias("by"))
    ends = pairs.select(F.explode(F.array("i", "j")).alias("site")).join(boxed, "site")
    return box_counts(boxed, ends, ("bx", "by"))


def environment_boxes(sites: DataFrame, pairs: DataFrame, columns: tuple[str, str], n: int = 100, margin: float = 0.0001) -> DataFrame:
    """n x n boxes over two predictors, their ranges widened by the margin."""
    e = sites.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])
    at = [box(F.col(c), F.col(f"lo_{c}") - margin, (F.col(f"hi_{c}") - F.col(f"lo_{c}") + 2 * margin) / n) for c in columns]
    boxed = sites.join(F.broadcast(e)).select("site", at[0].alias("bx"), at[1].alias("by"))
    ends = pairs.select(F.explode(F.array("i", "j")).alias("site")).join(boxed, "site")
    return box_counts(boxed, ends, ("bx", "by"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) of all column pairs from one aggregation; each skips rows where either is null."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    one = df.agg(*[correlation(a, b).alias(f"{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{k}`").alias("r")) for k, (a, b) in enumerate(pairs)])))


def dissimilarity_summary(df: DataFrame) -> DataFrame:
    d = F.col("distance")
    return df.agg(F.count("*").alias("n_pairs"), F.avg(d).alias("mean"), F.min(d).alias("min"), F.max(d).alias("max"), F.avg((d < 1).cast("int")).alias("share_below_1"))


def assess_sample(sites: DataFrame, samplings: Sequence[DataFrame], width: float, columns: tuple[str, str]) -> DataFrame:
    """One row per sampling of pairs: evenness over plane, environment and distances, and mean use."""
    out = None
    for k, pairs in enumerate(samplings):
        pairs = pairs.persist()
        row = evenness(spatial_boxes(sites, pairs, width)).select(F.col("evenness").alias("spatial"))
        row = row.join(evenness(environment_boxes(sites, pairs, columns)).select(F.col("evenness").alias("environment")))
        row = row.join(six_numbers(site_use(pairs, sites), "n").select(F.col("mean").alias("mean_use"), F.col("max").alias("max_use")))
        row = row.select(F.lit(k).alias("sampling"), "*")
        out = row if out is None else out.union(row)
    return out
