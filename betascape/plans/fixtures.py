"""Occurrences, compositions, sites and grids as projections of the generated tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from betascape.operators.model import Model
from betascape.operators.pairs import all_pair_sorensen, attach
from betascape.operators.tiles import AllPairs
from betascape.sources.grid import Header

SIZE = 50
#: Grids of customers are 50 cells wide, as high as the table needs.
RADIUS = 2.25

MODEL = Model(
    ["acctbal", "discount", "quantity"], [[-1000.0, 4500.0, 10000.0], [0.045, 0.05, 0.055], [24.0, 25.5, 27.0]],
    [[0.2, 0.1, 0.3], [0.05, 0.0, 0.4], [0.1, 0.25, 0.05]], intercept=0.9,
)
GEO_MODEL = Model(MODEL.predictors, [[0.0, 20.0, 50.0], *MODEL.knots], [[0.1, 0.2, 0.3], *MODEL.coefficients], intercept=0.7, geo=True)
GRID_MODEL = Model(["balance", "nation"], [[-500.0, 2000.0, 8000.0], [3.0, 10.0, 20.0]], [[0.4, 0.3, 0.6], [0.2, 0.5, 0.1]])


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t(spark, sf_dir, "lineitem")
    return df.select(
        F.col("l_partkey").alias("species"), ((F.col("l_partkey") % SIZE) + F.col("l_discount")).alias("decimalLongitude"),
        ((F.col("l_suppkey") % SIZE) + F.col("l_tax")).alias("decimalLatitude"), F.year("l_shipdate").alias("year"),
        (F.col("l_quantity") * 100).alias("coordinateUncertaintyInMeters"), (F.col("l_returnflag") == "R").cast("string").alias("flag"),
        F.when(F.col("l_linestatus") == "O", "species").otherwise("genus").alias("taxonRank"), F.col("l_returnflag").alias("source"),
    )


OCC = f"""occ AS (SELECT l_partkey AS species, (l_partkey % {SIZE}) + l_discount AS x, (l_suppkey % {SIZE}) + l_tax AS y,
  year(l_shipdate) AS yr, l_quantity * 100 AS unc, l_returnflag = 'R' AS flag, l_linestatus = 'O' AS is_species, l_returnflag AS source FROM lineitem)"""


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("species")).distinct()


COMP = "comp AS (SELECT DISTINCT l_suppkey AS site, l_partkey AS species FROM lineitem), rich AS (SELECT site, count(*) AS r FROM comp GROUP BY site)"


def customer_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(F.col("o_custkey").alias("site"), F.col("l_partkey").alias("species")).distinct()


COMP_C = """comp AS (SELECT DISTINCT o_custkey AS site, l_partkey AS species FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
rich AS (SELECT site, count(*) AS r FROM comp GROUP BY site)"""


def abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("species")).agg(F.sum("l_quantity").alias("n"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with coordinates and three predictors."""
    means = t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("discount"), F.avg("l_quantity").alias("quantity"))
    k = F.col("s_suppkey")
    x, y = (k % SIZE).cast("double"), F.floor(k / SIZE).cast("double")
    return t(spark, sf_dir, "supplier").join(means, F.col("s_suppkey") == F.col("l_suppkey")).select(
        k.alias("site"), x.alias("x"), y.alias("y"), x.alias("xCoord"), y.alias("yCoord"), F.col("s_acctbal").alias("acctbal"), "discount", "quantity"
    )


SITES = f"""sites AS (SELECT s_suppkey AS site, CAST(s_suppkey % {SIZE} AS DOUBLE) AS x, CAST(s_suppkey // {SIZE} AS DOUBLE) AS y, s_acctbal AS acctbal,
  discount, quantity FROM supplier JOIN (SELECT l_suppkey, avg(l_discount) AS discount, avg(l_quantity) AS quantity FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey)"""


def pair_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All supplier pairs with distance, weights and both ends' columns."""
    pairs = all_pair_sorensen(composition(spark, sf_dir)).withColumn("weights", F.lit(1.0))
    return attach(pairs, sites(spark, sf_dir), ["xCoord", "yCoord", *MODEL.predictors], every=True)


def all_pairs(spark: SparkSession, sf_dir: str, bucket=None, geo: bool = False, **options) -> AllPairs:
    """The same as tiles, for work that is done where pairs are counted."""
    columns = [*(["xCoord", "yCoord"] if geo else []), *MODEL.predictors]
    return AllPairs(composition(spark, sf_dir), sites(spark, sf_dir), columns, bucket, **options)


PAIRS = f"""{COMP}, {SITES}, sh AS (SELECT a.site AS i, b.site AS j, count(*) AS shared FROM comp a JOIN comp b ON a.species = b.species AND a.site < b.site GROUP BY 1, 2),
pairs AS (SELECT a.site AS i, b.site AS j, a.r AS r1, b.r AS r2, coalesce(shared, 0) AS shared, 1 - 2.0::DOUBLE * coalesce(shared, 0) / (a.r + b.r) AS distance,
  p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2, p.acctbal AS a1, q.acctbal AS a2, p.discount AS d1, q.discount AS d2, p.quantity AS q1, q.quantity AS q2
  FROM rich a JOIN rich b ON a.site < b.site LEFT JOIN sh ON sh.i = a.site AND sh.j = b.site JOIN sites p ON p.site = a.site JOIN sites q ON q.site = b.site)"""


def header(spark: SparkSession, sf_dir: str) -> Header:
    n = (t(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] or 0) + 1
    return Header(SIZE, -(-n // SIZE), 0.0, 0.0, 1.0)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return t(spark, sf_dir, "customer").select(
        F.floor(k / SIZE).cast("int").alias("row"), (k % SIZE).cast("int").alias("col"),
        F.when(F.col("c_acctbal") >= -900, F.col("c_acctbal")).alias("balance"), F.col("c_nationkey").cast("double").alias("nation"), F.col("c_mktsegment").alias("segment"),
    )


GRID = f"""grid AS (SELECT CAST(c_custkey // {SIZE} AS INTEGER) AS row, CAST(c_custkey % {SIZE} AS INTEGER) AS col,
  CASE WHEN c_acctbal >= -900 THEN c_acctbal END AS balance, CAST(c_nationkey AS DOUBLE) AS nation, c_mktsegment AS segment FROM customer)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))


def ispline_sql(v: str, q1: float, q2: float, q3: float) -> str:
    part = lambda top, width: f"{top} / {width!r}::DOUBLE"
    rise, fall = f"({v} - {q1}::DOUBLE)", f"({q3}::DOUBLE - {v})"
    up = f"WHEN {v} < {q2} THEN {part(rise, q2 - q1)} * ({part(rise, q3 - q1)}) " if q2 > q1 else ""
    down = f"1 - {part(fall, q3 - q2)} * ({part(fall, q3 - q1)})" if q3 > q2 else "NULL"
    return f"(CASE WHEN {v} IS NULL THEN NULL WHEN {v} <= {q1} THEN 0.0::DOUBLE WHEN {v} >= {q3} THEN 1.0::DOUBLE {up}ELSE {down} END)"


def triples(knots: list[float]) -> list[tuple[float, float, float]]:
    n = len(knots)
    return [(knots[max(0, i - 1)], knots[i], knots[min(n - 1, i + 1)]) for i in range(n)]


def spline_sql(v: str, knots: list[float], coefs: list[float]) -> str:
    return "(" + " + ".join(f"{c} * {ispline_sql(v, *q)}" for q, c in zip(triples(knots), coefs, strict=True)) + ")"


def eta_sql(model: Model) -> str:
    ends = [("a1", "a2"), ("d1", "d2"), ("q1", "q2")]
    parts = [f"{model.intercept}::DOUBLE"]
    if model.geo:
        d = "sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))"
        parts += [f"{c} * {ispline_sql(d, *q)}" for q, c in zip(triples(model.knots[0]), model.coefficients[0], strict=True)]
    for (a, b), ks, cs in zip(ends, model.knots[model.geo :], model.coefficients[model.geo :], strict=True):
        parts += [f"{c} * abs({ispline_sql(b, *q)} - {ispline_sql(a, *q)})" for q, c in zip(triples(ks), cs, strict=True)]
    return " + ".join(parts)
