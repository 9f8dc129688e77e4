"""Occurrence records to cells: quality filters, snapping, counts, neighbourhoods.

All steps are lazy but the greedy aggregation, which runs rounds over checkpoints.

Cases: nulls in a tested column fail the test; points without a coordinate meet nobody and are in no cell; repeated
records count each for itself, but once in a composition; ties go to the first in the order named; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from betascape.functions.scalar import distance
from betascape.operators.order import ranked_values
from betascape.sources.checkpoint import cut

# The quality flags of the occurrence service, and the ranks and limits of the standard filter.
QA_FLAGS = (
    "Name.not.supplied", "Name.not.recognised", "Cultivated...escapee", "Unparseable.verbatim.coordinates",
    "Decimal.latitude.longitude.conversion.failed", "Unable.to.convert.UTM.coordinates", "Supplied.coordinates.are.zero",
    "Zero.latitude", "Zero.longitude", "Coordinates.centre.of.country", "Supplied.coordinates.centre.of.state",
    "processing.Error",
)
RANKS = ("species", "subspecies")
FIRST_YEAR, LARGEST_UNCERTAINTY = 1970, 2000


def qa_passes(df: DataFrame, flags: Sequence[str]) -> Column:
    """No flag says true (in any case); a null flag fails.  A missing flag column is an error."""
    if absent := [f for f in flags if f not in df.columns]:
        raise ValueError(f"no such quality columns: {absent}")
    return reduce(lambda a, b: a & b, [F.lower(F.col(f"`{f}`").cast("string")) != "true" for f in flags], F.lit(True))


def inside(x: Column, y: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Strictly within (xmin, xmax, ymin, ymax)."""
    return (x > bounds[0]) & (x < bounds[1]) & (y > bounds[2]) & (y < bounds[3])


def in_extent(x: Column, y: Column, bounds: tuple[float, float, float, float]) -> Column:
    """At or above the lower edges, below the upper ones."""
    return (x >= bounds[0]) & (x < bounds[1]) & (y >= bounds[2]) & (y < bounds[3])


def filter_occurrences(
    df: DataFrame, flags: Sequence[str] = QA_FLAGS, ranks: Sequence[str] = RANKS, first_year: int = FIRST_YEAR,
    uncertainty: float = LARGEST_UNCERTAINTY, bounds: tuple[float, float, float, float] | None = None,
    keep_null_uncertainty: bool = False, lon: str = "decimalLongitude", lat: str = "decimalLatitude",
) -> DataFrame:
    """All record filters as one conjunction, which reaches the scan.  Nulls fail as in WHERE."""
    error = F.col("coordinateUncertaintyInMeters") <= uncertainty
    if keep_null_uncertainty:
        error = error | F.col("coordinateUncertaintyInMeters").isNull()
    ok = qa_passes(df, flags) & F.col("taxonRank").isin(*ranks) & (F.col("year") >= first_year) & error & F.col(lon).isNotNull() & F.col(lat).isNotNull()
    if bounds:
        ok = ok & inside(F.col(lon), F.col(lat), bounds)
    return df.where(ok)


def select_record_columns(df: DataFrame) -> DataFrame:
    """The columns that later stages use; the epithet stands for the name where the table has it."""
    name = "specificEpithet" if "specificEpithet" in df.columns else "scientificName"
    rest = ("taxonRank", "eventDate", "decimalLatitude", "decimalLongitude", "coordinateUncertaintyInMeters")
    return df.select("occurrenceID", F.col(name).alias("scientificName"), *rest)


def cell_index(z: Column, origin: float, res: float) -> Column:
    return F.floor((z - origin) / res).cast("long")


def snap(z: Column, origin: float, res: float) -> Column:
    """Centre of the cell that holds z."""
    return F.lit(res / 2 + origin) + F.lit(res) * F.floor((z - origin) / res)


def on_mask(points: DataFrame, mask: DataFrame, keys: Sequence[str] = ("col", "row"), value: str = "value") -> DataFrame:
    """Points whose mask cell holds a value."""
    return points.join(mask.where(F.col(value).isNotNull()).select(*keys).distinct(), list(keys), "left_semi")


def pairs_on_mask(pairs: DataFrame, mask: DataFrame, value: str = "value") -> DataFrame:
    """Site pairs with both ends on the mask: columns s1_col, s1_row, s2_col, s2_row."""
    for s in ("s1", "s2"):
        ends = mask.where(F.col(value).isNotNull()).select(F.col("col").alias(f"{s}_col"), F.col("row").alias(f"{s}_row")).distinct()
        pairs = pairs.join(ends, [f"{s}_col", f"{s}_row"], "left_semi")
    return pairs


def within_class_envelope(points: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Records in the grid of their own class: both have class, col and row."""
    return points.join(envelopes.select("class", "col", "row").distinct(), ["class", "col", "row"], "left_semi")


def cell_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_records"))


def richness(df: DataFrame, keys: Sequence[str], species: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct(species).alias("richness"))


def composition(df: DataFrame, site: str, species: str) -> DataFrame:
    return df.select(F.col(site).alias("site"), F.col(species).alias("species")).dropna().distinct()


def near_pairs(left: DataFrame, right: DataFrame, radius: float, strict: bool = False) -> DataFrame:
    """Pairs (all columns, right ones with a trailing 2, and dist) of points within a radius.

    Points are dealt into square tiles of the radius; left ones meet the 3 x 3 tiles around theirs,
    so the plan is an equi-join with the distance as a residual test, never a nested loop.
    """
    size = radius or 1.0
    tile = lambda c: F.floor(F.col(c) / size).cast("long")
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    a = left.withColumn("__dx", around).withColumn("__dy", around).withColumn("__tx", tile("x") + F.col("__dx")).withColumn("__ty", tile("y") + F.col("__dy")).drop("__dx", "__dy")
    b = right.select([F.col(c).alias(f"{c}2") for c in right.columns]).withColumn("__tx", tile("x2")).withColumn("__ty", tile("y2"))
    d = distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    joined = a.join(b, ["__tx", "__ty"]).withColumn("dist", d).drop("__tx", "__ty")
    return joined.where(F.col("dist") < radius if strict else F.col("dist") <= radius)


def neighbour_values(cells: DataFrame, radius: float, key: str, value: str) -> DataFrame:
    """(key, v): for each cell its own value and that of each cell within the radius; keys are distinct.

    Each pair of cells is joined once: a cell meets those of its own tile and of four of the eight around it.
    """
    size = radius or 1.0
    tile = lambda c: F.floor(F.col(c) / size).cast("long")
    ahead = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])).alias("__o")
    rows = cells.select(F.col(key).alias("__k"), "x", "y", F.col(value).alias("__v"))
    a = rows.select("*", ahead).select("*", (tile("x") + F.col("__o.x")).alias("__tx"), (tile("y") + F.col("__o.y")).alias("__ty"), ((F.col("__o.x") == 0) & (F.col("__o.y") == 0)).alias("__own"))
    b = rows.select(tile("x").alias("__tx"), tile("y").alias("__ty"), F.col("__k").alias("__k2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("__v").alias("__v2"))
    near = a.join(b, ["__tx", "__ty"]).where((~F.col("__own") | (F.col("__k") < F.col("__k2"))) & (distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")) <= radius))
    both = near.select(F.inline(F.array(F.struct(F.col("__k").alias(key), F.col("__v2").alias("v")), F.struct(F.col("__k2").alias(key), F.col("__v").alias("v")))))
    return both.union(rows.where("x IS NOT NULL AND y IS NOT NULL").select(F.col("__k").alias(key), F.col("__v").alias("v")))


def neighbour_sum(cells: DataFrame, radius: float, key: str = "cell", value: str = "n_records") -> DataFrame:
    """Sum of a value over all cells within the radius, the cell itself included."""
    return neighbour_values(cells, radius, key, value).groupBy(key).agg(F.sum("v").alias("neighbour_sum"))


def relative_richness(cells: DataFrame, radius: float, share: float, key: str = "cell") -> DataFrame:
    """Cells with at least that share of the largest richness within the radius; all compared at once."""
    top = neighbour_values(cells, radius, key, "richness").groupBy(key).agg(F.max("v").alias("max_richness"))
    return cells.join(top, key).where(F.col("richness") >= share * F.col("max_richness"))


def nearest_kept(cells: DataFrame, kept: DataFrame, radius: float, key: str = "cell", order: str = "ord") -> DataFrame:
    """For each cell the nearest kept cell closer than the radius, else itself; ties go to the first in order."""
    near = near_pairs(cells.select(key, "x", "y"), kept.select(key, "x", "y", order), radius, strict=True)
    best = near.groupBy(key).agg(F.min(F.struct(F.col("dist"), F.col(f"{order}2"), F.col(f"{key}2").alias("kept"))).alias("b"))
    return cells.join(best, key, "left").select(*cells.columns, F.coalesce("b.kept", key).alias("target"))


def greedy_cells(cells: DataFrame, radius: float, key: str = "cell") -> DataFrame:
    """Cells that the greedy rule keeps: the best first, and none within the radius of a kept one.

    Best is by neighbour_sum, then n_records, both descending, then the key as text.  In each round
    every undecided cell that beats all its undecided neighbours is kept and these go, which gives
    the set that one pass in order gives.
    """
    ranked = cells.join(neighbour_sum(cells, radius, key), key)
    best = F.struct((-F.col("neighbour_sum")).alias("a"), (-F.col("n_records")).alias("b"), F.col(key).cast("string").alias("c"))
    state = cut(ranked.select(key, "x", "y", best.alias("ord")))
    edges = cut(near_pairs(state, state.select(key, "x", "y", "ord"), radius).where(F.col(key) != F.col(f"{key}2")).select(F.col(key), F.col(f"{key}2").alias("other"), F.col("ord"), F.col("ord2")))
    kept = None
    while True:
        rival = edges.join(state.select(F.col(key).alias("other")), "other", "left_semi").groupBy(key).agg(F.min("ord2").alias("rival"))
        won = cut(state.join(rival, key, "left").where(F.col("rival").isNull() | (F.col("ord") < F.col("rival"))).select(key, "x", "y", "ord"))
        if won.isEmpty():
            return state if kept is None else kept
        kept = won if kept is None else kept.union(won)
        gone = edges.join(won.select(F.col(key).alias("other")), "other", "left_semi").select(key).union(won.select(key)).distinct()
        state = cut(state.join(gone, key, "left_anti"))


def aggregate_cells(cells: DataFrame, radius: float, key: str = "cell") -> DataFrame:
    """Each cell with the kept cell (``target``) that its records move to."""
    return nearest_kept(cells, greedy_cells(cells, radius, key), radius, key)


def outersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of exactly one of two one-column tables, each once."""
    return a.distinct().exceptAll(b.distinct()).union(b.distinct().exceptAll(a.distinct()))


def null_outliers(df: DataFrame, columns: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Values beyond ``reach`` hinge spreads of the hinges become null.

    A hinge is the order statistic at depth floor((n + 3) / 2) / 2, halves meaning the mean of two.  Columns without
    values stay as they are.
    """

    def ranks(n: int) -> list[int]:
        twice = (n + 3) // 2 - 2  # twice the place from 0
        return [twice // 2, -(-twice // 2), n - 1 - -(-twice // 2), n - 1 - twice // 2]

    hinges = ranked_values(df, {c: F.col(c) for c in columns}, lambda n: ranks(n) if n > 1 else [0] * 4)
    for c, (a, b, x, y) in hinges.items():
        lo, hi = (a + b) / 2, (x + y) / 2
        df = df.withColumn(c, F.when(F.col(c).between(lo - reach * (hi - lo), hi + reach * (hi - lo)), F.col(c)))
    return df
