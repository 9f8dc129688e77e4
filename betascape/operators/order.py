"""Order statistics without a task that holds all values.

Equal values are counted first; the counts are dealt out by ranges of the value, and each range's size
says how many values come before it.  Nulls are left out; NaN counts as larger than all numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from betascape.sources.checkpoint import cut


def same(a: str, b: str, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))


def sorted_counts(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n, start): each value of a key, how often it comes, and how many lesser ones the key has."""
    return count_values(rows, keys, value)


def count_values(rows: DataFrame, keys: Sequence[str], value: str, times: str | None = None) -> DataFrame:
    """The same where a row counts as often as its column ``times`` says, if that is named."""
    keys = list(keys)
    n = F.sum(times) if times else F.count("*")
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"))
    dealt = cut(counts.repartitionByRange(*keys, value).withColumn("__p", F.spark_partition_id()))
    earlier = lambda by, order: F.coalesce(F.sum(order[1]).over(Window.partitionBy(*by).orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A key lies in neighbouring ranges, so there are about as many of these rows as keys and ranges.
    sizes = dealt.groupBy(*keys, "__p").agg(F.sum("n").alias("__m"))
    sizes = sizes.withColumn("__before", earlier(keys, ("__p", "__m")))
    within = dealt.withColumn("__in", earlier([*keys, "__p"], (value, "n")))
    both = within.alias("a").join(sizes.alias("b"), same("a", "b", [*keys, "__p"]))
    return both.select(*[F.col(f"a.{k}") for k in keys], F.col(f"a.{value}"), F.col("a.n"), (F.col("a.__in") + F.col("b.__before")).alias("start"))


def ranked_values(df: DataFrame, values: dict[str, Column], ranks: Callable[[int], list[int]]) -> dict[str, list[float]]:
    """Values at given ranks (from 0) of sorted columns, for all columns at once; columns without values are left out."""
    return ranked_by(df.withColumn("__set", F.lit(0)), "__set", values, ranks).get(0, {})


def ranked_by(df: DataFrame, key: str, values: dict[str, Column], ranks: Callable[[int], list[int]]) -> dict[object, dict[str, list[float]]]:
    """The same for each value of a key; keys are few."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("double").alias("v")) for k, v in values.items()])).alias("x")
    return at_ranks(sorted_counts(df.select(F.col(key).alias("key"), each).select("key", "x.k", "x.v"), ["key", "k"], "v"), ranks)


def at_ranks(counts: DataFrame, ranks: Callable[[int], list[int]]) -> dict[object, dict[str, list[float]]]:
    """Values at ranks of each key, and k of it, from (key, k, v, n, start)."""
    counts = counts.persist()
    try:
        sizes = {(r.key, r.k): r.n for r in counts.groupBy("key", "k").agg(F.sum("n").alias("n")).collect()}
        if not sizes:
            return {}
        wanted = {k: ranks(n) for k, n in sizes.items()}
        here = lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n"))
        asked = reduce(lambda a, b: a | b, [F.col("key").eqNullSafe(F.lit(f)) & (F.col("k") == k) & F.exists(F.array(*[F.lit(int(r)) for r in rs]), here) for (f, k), rs in wanted.items()])
        found = counts.where(asked).collect()
    finally:
        counts.unpersist()
    out: dict[object, dict[str, list[float]]] = {}
    for (f, k), rs in wanted.items():
        out.setdefault(f, {})[k] = [next(x.v for x in found if (x.key, x.k) == (f, k) and x.start <= r < x.start + x.n) for r in rs]
    return out


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], name: str = "q") -> DataFrame:
    """(keys, name): the quantiles of each key as an array, by linear interpolation."""
    keys = list(keys)
    counts = cut(sorted_counts(rows.withColumn(value, F.col(value).cast("double")), keys, value))
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("__n"))
    both = counts.alias("a").join(sizes.alias("b"), same("a", "b", keys))
    at = [F.lit(float(p)) * (F.col("__n") - 1) for p in shares]
    held = lambda r: F.max(F.when((F.col("start") <= r) & (r < F.col("start") + F.col("n")), F.col(f"a.{value}")))
    ends = [f(a) for a in at for f in (F.floor, F.ceil)]
    out = both.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(F.max("__n").alias("__n"), *[held(e).alias(f"__{i}") for i, e in enumerate(ends)])
    part = lambda i, a: F.col(f"__{2 * i}") + (a - F.floor(a)) * (F.col(f"__{2 * i + 1}") - F.col(f"__{2 * i}"))
    return out.select(*keys, F.array(*[part(i, a) for i, a in enumerate(at)]).alias(name))
