"""All registered queries on the generated tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from betascape.functions import scalar as fn
from betascape.operators import assess, cluster, grids, model, pairs, prepare, select, tiles
from betascape.plans.fixtures import (
    COMP, COMP_C, GEO_MODEL, GRID, GRID_MODEL, MODEL, OCC, PAIRS, RADIUS, SITES, SIZE, abundance, all_pairs, composition, customer_composition, eta_sql,
    grid, header, ispline_sql, occurrences, pair_inputs, sites, spline_sql, t, triples, vectors,
)
from betascape.sources import grid as grid_io
from betascape.sources import occurrences as occ_io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of the dissimilarities of all supplier pairs."""
    return pair_table_summary(spark, sf_dir)


# --- preparation -------------------------------------------------------------------------------


@query(f"WITH {OCC} SELECT species, count(*) AS n FROM occ WHERE NOT flag GROUP BY species")
def qa_filter(spark, sf):
    df = occurrences(spark, sf)
    return df.where(prepare.qa_passes(df, ["flag"])).groupBy("species").agg(F.count("*").alias("n"))


@query(f"""WITH {OCC} SELECT species, yr AS year, count(*) AS n FROM occ WHERE NOT flag AND is_species AND yr >= 1998 AND unc <= 2000
  AND x > 5 AND x < 45 AND y > 5 AND y < 45 GROUP BY 1, 2""")
def rank_year_uncertainty_filter(spark, sf):
    df = prepare.filter_occurrences(occurrences(spark, sf), ["flag"], first_year=1998, bounds=(5, 45, 5, 45))
    return df.groupBy("species", F.col("year").cast("long").alias("year")).agg(F.count("*").alias("n"))


@query(f"WITH {OCC} SELECT species, count(*) AS n FROM occ WHERE x > 10 AND x < 20 AND y > 10 AND y < 40 GROUP BY species")
def bbox_strict(spark, sf):
    df = occurrences(spark, sf)
    return df.where(prepare.inside(F.col("decimalLongitude"), F.col("decimalLatitude"), (10, 20, 10, 40))).groupBy("species").agg(F.count("*").alias("n"))


@query(f"WITH {OCC} SELECT species, count(*) AS n FROM occ WHERE x >= 10 AND x < 20 AND y >= 10 AND y < 40 GROUP BY species")
def point_in_extent(spark, sf):
    df = occurrences(spark, sf)
    return df.where(prepare.in_extent(F.col("decimalLongitude"), F.col("decimalLatitude"), (10, 20, 10, 40))).groupBy("species").agg(F.count("*").alias("n"))


CELL = f"{OCC}, cell AS (SELECT CAST(floor(x) AS BIGINT) AS col, CAST(floor(y) AS BIGINT) AS row, species FROM occ)"


def cells_of(spark, sf):
    df = occurrences(spark, sf)
    return df.select(prepare.cell_index(F.col("decimalLongitude"), 0, 1).alias("col"), prepare.cell_index(F.col("decimalLatitude"), 0, 1).alias("row"), "species")


@query(f"WITH {CELL}, {GRID} SELECT species, count(*) AS n FROM cell WHERE EXISTS (SELECT 1 FROM grid WHERE grid.row = cell.row AND grid.col = cell.col AND balance IS NOT NULL) GROUP BY species")
def mask_semi_join(spark, sf):
    return prepare.on_mask(cells_of(spark, sf), grid(spark, sf), value="balance").groupBy("species").agg(F.count("*").alias("n"))


@query(f"""WITH {CELL}, {GRID}, e AS (SELECT DISTINCT segment, row, col FROM grid), p AS (SELECT *, CASE species % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE'
  WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS segment FROM cell) SELECT segment, count(*) AS n FROM p JOIN e USING (segment, row, col) GROUP BY segment""")
def presence_in_class_envelope(spark, sf):
    names = F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    points = cells_of(spark, sf).withColumn("class", F.get(names, (F.col("species") % 5).cast("int")))
    envelopes = grid(spark, sf).withColumnRenamed("segment", "class")
    return prepare.within_class_envelope(points, envelopes).groupBy(F.col("class").alias("segment")).agg(F.count("*").alias("n"))


@query(f"WITH {OCC} SELECT 0.25 + 0.5 * floor((x - 0.0) / 0.5) AS cx, 0.25 + 0.5 * floor(y / 0.5) AS cy, count(*) AS n FROM occ GROUP BY 1, 2".replace("0.25", "0.25::DOUBLE").replace("0.5 *", "0.5::DOUBLE *"))
def snap_to_cell(spark, sf):
    df = occurrences(spark, sf)
    return df.groupBy(prepare.snap(F.col("decimalLongitude"), 0, 0.5).alias("cx"), prepare.snap(F.col("decimalLatitude"), 0, 0.5).alias("cy")).agg(F.count("*").alias("n"))


@query(f"WITH {CELL} SELECT col, row, count(*) AS n_records FROM cell GROUP BY 1, 2")
def cell_record_count(spark, sf):
    return prepare.cell_counts(cells_of(spark, sf), ["col", "row"])


@query(f"WITH {CELL} SELECT col, row, count(DISTINCT species) AS richness FROM cell GROUP BY 1, 2")
def cell_richness(spark, sf):
    return prepare.richness(cells_of(spark, sf), ["col", "row"], "species")


@query(f"WITH {CELL} SELECT col, row, count(DISTINCT species) AS richness FROM cell GROUP BY 1, 2 HAVING count(DISTINCT species) BETWEEN 3 AND 200")
def richness_threshold(spark, sf):
    return prepare.richness(cells_of(spark, sf), ["col", "row"], "species").where(F.col("richness").between(3, 200))


CELLS = f"""{CELL}, cells AS (SELECT col * 100000 + row AS cell, CAST(col AS DOUBLE) AS x, CAST(row AS DOUBLE) AS y, count(*) AS n_records,
  count(DISTINCT species) AS richness FROM cell GROUP BY col, row)"""


def numbered_cells(spark, sf):
    df = cells_of(spark, sf).groupBy("col", "row").agg(F.count("*").alias("n_records"), F.countDistinct("species").alias("richness"))
    return df.select((F.col("col") * 100000 + F.col("row")).alias("cell"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), "n_records", "richness")


NEAR = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query(f"WITH {CELLS} SELECT a.cell, CAST(sum(b.n_records) AS BIGINT) AS neighbour_sum FROM cells a JOIN cells b ON {NEAR} <= {RADIUS} GROUP BY 1")
def neighbour_record_sum(spark, sf):
    return prepare.neighbour_sum(numbered_cells(spark, sf), RADIUS)


@query(f"""WITH {CELLS}, m AS (SELECT a.cell, a.richness, max(b.richness) AS max_richness FROM cells a JOIN cells b ON {NEAR} <= {RADIUS} GROUP BY 1, 2)
  SELECT cell, richness, max_richness FROM m WHERE richness >= 0.8::DOUBLE * max_richness""")
def relative_richness_filter(spark, sf):
    return prepare.relative_richness(numbered_cells(spark, sf), RADIUS, 0.8).select("cell", "richness", "max_richness")


@query(f"""WITH {CELLS}, k AS (SELECT * FROM cells WHERE (CAST(x AS BIGINT) + CAST(y AS BIGINT)) % 3 = 0),
  p AS (SELECT a.cell, b.cell AS target, row_number() OVER (PARTITION BY a.cell ORDER BY {NEAR}, b.cell) AS r FROM cells a JOIN k b ON {NEAR} < 1.5)
  SELECT cells.cell, coalesce(target, cells.cell) AS target FROM cells LEFT JOIN p ON p.cell = cells.cell AND r = 1""")
def nearest_cell_assign(spark, sf):
    cells = numbered_cells(spark, sf)
    kept = cells.where((F.col("x").cast("long") + F.col("y").cast("long")) % 3 == 0).withColumn("ord", F.col("cell"))
    return prepare.nearest_kept(cells, kept, 1.5).select("cell", "target")


STAY = f"""s AS (SELECT a.cell, a.x, a.y, a.n_records, sum(b.n_records) AS total FROM cells a JOIN cells b ON {NEAR} <= {RADIUS} GROUP BY 1, 2, 3, 4),
  o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY total DESC, n_records DESC, CAST(cell AS VARCHAR)) AS k FROM s),
  g(k, kept) AS (SELECT 0::BIGINT, []::STRUCT(x DOUBLE, y DOUBLE, cell BIGINT, k BIGINT)[] UNION ALL SELECT o.k,
    CASE WHEN len(list_filter(kept, lambda z: sqrt((z.x - o.x) * (z.x - o.x) + (z.y - o.y) * (z.y - o.y)) <= {RADIUS})) > 0 THEN kept
      ELSE list_append(kept, {{'x': o.x, 'y': o.y, 'cell': CAST(o.cell AS BIGINT), 'k': o.k}}) END FROM g JOIN o ON o.k = g.k + 1),
  f AS (SELECT unnest(kept, recursive := true) FROM g WHERE k = (SELECT count(*) FROM cells)),
  p AS (SELECT a.cell, b.cell AS target, row_number() OVER (PARTITION BY a.cell ORDER BY {NEAR}, b.k) AS r FROM cells a JOIN f b ON {NEAR} < {RADIUS})"""


@query(f"WITH RECURSIVE {CELLS}, {STAY} SELECT c.cell, c.n_records, coalesce(p.target, c.cell) AS target FROM cells c LEFT JOIN p ON p.cell = c.cell AND p.r = 1")
def greedy_aggregate(spark, sf):
    return prepare.aggregate_cells(numbered_cells(spark, sf), RADIUS).select("cell", "n_records", "target")


@query(f"WITH {OCC} SELECT source, count(*) AS n_records FROM occ GROUP BY source")
def merge_audit(spark, sf):
    return occ_io.merge_audit(occurrences(spark, sf), "source")


@query(f"WITH {COMP} SELECT site, species FROM comp")
def composition_distinct(spark, sf):
    return prepare.composition(t(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


@query("SELECT count(*) AS n_rows, 5 AS n_columns, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer")
def table_facts(spark, sf):
    return occ_io.table_facts(t(spark, sf, "customer"), "c_acctbal")


@query("SELECT c_custkey AS site FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def remaining_downloads(spark, sf):
    done = t(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("site"))
    return occ_io.remaining(t(spark, sf, "customer").select(F.col("c_custkey").alias("site")), done, "site")


@query("""WITH a AS (SELECT DISTINCT l_suppkey % 7 * 10 + l_linenumber AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30),
  b AS (SELECT DISTINCT l_suppkey % 5 * 10 + l_linenumber AS k FROM lineitem WHERE l_returnflag <> 'R')
  (SELECT k FROM a EXCEPT SELECT k FROM b) UNION (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def outersect(spark, sf):
    df = t(spark, sf, "lineitem")
    a = df.where("l_returnflag = 'R' AND l_quantity > 30").select((F.col("l_suppkey") % 7 * 10 + F.col("l_linenumber")).alias("k"))
    b = df.where("l_returnflag <> 'R'").select((F.col("l_suppkey") % 5 * 10 + F.col("l_linenumber")).alias("k"))
    return prepare.outersect(a, b)


@query(r"""WITH n AS (SELECT p_partkey, p_name, array_to_string(list_slice(string_split_regex(trim(p_name), '\s+'), 1, 2), ' ') AS two FROM part)
  SELECT p_partkey, CASE WHEN NOT regexp_matches(p_name, '[.,]') AND regexp_matches(two, '^\S+ [^A-Z\s]\S+$') THEN two END AS species FROM n""")
def species_name_clean(spark, sf):
    return t(spark, sf, "part").select("p_partkey", fn.clean_species(F.col("p_name")).alias("species"))


@query("""SELECT s_suppkey AS site, (s_suppkey * 1103515245 + 12345) % 2147483648 / 2147483648.0::DOUBLE < 0.8 AS is_train FROM supplier""")
def train_test_split_hash(spark, sf):
    train, test = select.split_sites(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("site")), 0.8, arithmetic=True)
    return train.withColumn("is_train", F.lit(True)).union(test.withColumn("is_train", F.lit(False)))


# --- pairs -------------------------------------------------------------------------------------


@query(f"WITH {COMP} SELECT a.site AS i, b.site AS j FROM rich a JOIN rich b ON a.site < b.site")
def pair_enumerate(spark, sf):
    return pairs.enumerate_pairs(pairs.with_richness(composition(spark, sf)))


@query(f"WITH {COMP_C} SELECT a.site AS i, b.site AS j, count(*) AS shared FROM comp a JOIN comp b ON a.species = b.species AND a.site < b.site GROUP BY 1, 2")
def pair_shared_species(spark, sf):
    return pairs.shared_species(customer_composition(spark, sf))


@query(f"WITH {PAIRS} SELECT i, j, r1, r2, shared, round(distance, 9) AS distance FROM pairs")
def pair_sorensen(spark, sf):
    return rounded(pairs.all_pair_sorensen(composition(spark, sf)), "distance", digits=9)


@query(f"WITH {PAIRS} SELECT i, j, r1, r2, shared, round(distance, 9) AS distance, round(sqrt(r1 + r2), 9) AS weights FROM pairs")
def pair_sorensen_arrays(spark, sf):
    df = pairs.all_pair_sorensen(composition(spark, sf))
    return rounded(df.withColumn("weights", fn.pair_weight(F.col("r1"), F.col("r2"), "sqrt")), "distance", "weights", digits=9)


@query(f"""WITH {COMP_C}, s AS (SELECT a.site AS i, b.site AS j, count(*) AS c FROM comp a JOIN comp b ON a.species = b.species AND a.site < b.site GROUP BY 1, 2)
  SELECT i, j, round(1 - 2.0::DOUBLE * c / (a.r + b.r), 9) AS distance FROM s JOIN rich a ON a.site = i JOIN rich b ON b.site = j""")
def pair_braycurtis_pa(spark, sf):
    return rounded(pairs.bray_curtis_presence(customer_composition(spark, sf)), "distance", digits=9)


@query("""WITH ab AS (SELECT l_suppkey AS site, l_partkey AS species, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2), tot AS (SELECT site, sum(n) AS t FROM ab GROUP BY 1),
  low AS (SELECT a.site AS i, b.site AS j, sum(least(a.n, b.n)) AS low FROM ab a JOIN ab b ON a.species = b.species AND a.site < b.site GROUP BY 1, 2)
  SELECT i, j, round(1 - 2.0::DOUBLE * low / (a.t + b.t), 9) AS distance FROM low JOIN tot a ON a.site = i JOIN tot b ON b.site = j""")
def pair_braycurtis_abundance(spark, sf):
    return rounded(pairs.bray_curtis_abundance(abundance(spark, sf)), "distance", digits=9)


@query(f"WITH {PAIRS} SELECT i, j, CAST(r1 + r2 AS DOUBLE) AS w_sum, round(sqrt(r1 + r2), 9) AS w_sqrt FROM pairs")
def pair_weights_sum_sqrt(spark, sf):
    df = pairs.all_pair_sorensen(composition(spark, sf))
    w = [fn.pair_weight(F.col("r1"), F.col("r2"), k).alias(f"w_{k}") for k in ("sum", "sqrt")]
    return rounded(df.select("i", "j", *w), "w_sqrt", digits=9)


@query(f"WITH {PAIRS} SELECT i, j, round(sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)), 9) AS d FROM pairs")
def pair_geo_distance(spark, sf):
    return rounded(pair_inputs(spark, sf).select("i", "j", pairs.geographic_distance(None).alias("d")), "d", digits=9)


@query(f"""WITH {COMP}, {SITES}, z AS (SELECT site, (acctbal - avg(acctbal) OVER ()) / stddev_samp(acctbal) OVER () AS a, (discount - avg(discount) OVER ()) / stddev_samp(discount) OVER () AS b FROM sites)
  SELECT p.site AS i, q.site AS j, round(sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)), 6) AS d FROM z p JOIN z q ON p.site < q.site""")
def pair_env_distance_standardised(spark, sf):
    s = pairs.standardise(sites(spark, sf), ("acctbal", "discount"))
    df = pairs.attach(pairs.enumerate_pairs(s), s, ("acctbal", "discount"))
    return rounded(df.select("i", "j", pairs.environment_distance(("acctbal", "discount")).alias("d")), "d")


@query(f"""WITH {PAIRS} SELECT i, j, a1 AS s1_acctbal, a2 AS s2_acctbal, round(d1, 9) AS s1_discount, round(d2, 9) AS s2_discount, round(q1, 9) AS s1_quantity, round(q2, 9) AS s2_quantity FROM pairs""")
def pair_env_attach(spark, sf):
    df = pair_inputs(spark, sf).select("i", "j", *[f"{s}_{p}" for s in ("s1", "s2") for p in MODEL.predictors])
    return rounded(df, *[f"{s}_{p}" for s in ("s1", "s2") for p in ("discount", "quantity")], digits=9)


@query(f"WITH {PAIRS} SELECT count(*) AS n_pairs, round(avg(distance), 9) AS mean, round(min(distance), 9) AS min, round(max(distance), 9) AS max, avg(CAST(distance < 1 AS INT)) AS share_below_1 FROM pairs")
def pair_table_summary(spark, sf):
    return rounded(assess.dissimilarity_summary(pairs.all_pair_sorensen(composition(spark, sf))), "mean", "min", "max", digits=9)


@query(f"""WITH {SITES} SELECT a.site, round(sum(exp(-({NEAR} * {NEAR}) / 18.0) / (18.0 * pi())), 9) AS density FROM sites a JOIN sites b ON {NEAR} <= 24 GROUP BY 1""")
def kernel_density_at_points(spark, sf):
    return rounded(pairs.kernel_density(sites(spark, sf), 3.0), "density", digits=9)


@query("""WITH g AS (SELECT r, c FROM range(6) a(r), range(10) b(c))
  SELECT r, c, round(0.5 + r % 2 * 1.0 + c * 2.0, 6)::DOUBLE AS x, round((1.0 + r * sqrt(3.0))::DOUBLE, 6) AS y FROM g""")
def hex_net(spark, sf):
    return rounded(pairs.hex_net(spark, (0.5, 1.0), (20.0, 11.0), 2.0), "x", "y")


@query()
def sample_random(spark, sf):
    return pairs.pair_table(pairs.sample_random(sites(spark, sf), 500), located(spark, sf))


def located(spark, sf):
    return sites(spark, sf).withColumn("decimalLongitude", F.col("x")).withColumn("decimalLatitude", F.col("y"))


@query()
def sample_geographic(spark, sf):
    return pairs.pair_table(pairs.sample_geographic(sites(spark, sf), 300), located(spark, sf))


@query()
def sample_environment(spark, sf):
    return pairs.pair_table(pairs.sample_environment(sites(spark, sf), 300, ("acctbal", "discount")), located(spark, sf))


@query()
def sample_density(spark, sf):
    return pairs.pair_table(pairs.sample_density(sites(spark, sf), 300, 3.0), located(spark, sf))


@query()
def sample_geo_weighted(spark, sf):
    return pairs.pair_table(pairs.sample_geo_weighted(sites(spark, sf), 200, 4.0), located(spark, sf))


@query()
def sample_assessor(spark, sf):
    s = sites(spark, sf)
    return assess.assess_sample(s, [pairs.sample_random(s, 300, k) for k in range(2)], 5.0, ("acctbal", "discount"))


@query("SELECT a, b, c FROM (VALUES (1), (2)) x(a), (VALUES ('u'), ('v')) y(b), (VALUES (0.5::DOUBLE), (1.5::DOUBLE)) z(c)".replace("(1), (2)", "(1::BIGINT), (2::BIGINT)"))
def parameter_grid(spark, sf):
    return pairs.parameter_grid(spark, a=[1, 2, 2], b=["u", "v"], c=[0.5, 1.5])


# --- models ------------------------------------------------------------------------------------


def knots_sql(k: int) -> str:
    at = ", ".join(f"v[{'1' if i == 0 else 'len(v)' if i == k - 1 else f'len(v) // {k - 1} * {i} + 1'}]" for i in range(k))
    ends = {"acctbal": ("a1", "a2"), "discount": ("d1", "d2"), "quantity": ("q1", "q2")}
    each = [f"SELECT '{n}' AS predictor, list_sort(list(v)) AS v FROM (SELECT {a} AS v FROM pairs UNION ALL SELECT {b} FROM pairs)" for n, (a, b) in ends.items()]
    return f"WITH {PAIRS}, l AS ({' UNION ALL '.join(each)}), u AS (SELECT predictor, unnest([{at}]) AS knot, unnest(range({k})) AS k FROM l) SELECT predictor, k, round(knot, 6) AS knot FROM u"


@query(knots_sql(3))
def knots_order_stat(spark, sf):
    found = model.quantile_knots(pair_inputs(spark, sf), MODEL.predictors)
    rows = [(p, i, round(float(v), 6)) for p, ks in zip(MODEL.predictors, found, strict=True) for i, v in enumerate(ks)]
    return spark.createDataFrame(rows, "predictor string, k long, knot double")


@query(f"""WITH {SITES} SELECT site, {', '.join(f'round({ispline_sql("acctbal", *q)}, 9) AS i{k}' for k, q in enumerate(triples(MODEL.knots[0])))} FROM sites""")
def ispline_basis(spark, sf):
    terms = [F.round(b, 9).alias(f"i{k}") for k, b in enumerate(fn.basis(F.col("acctbal"), MODEL.knots[0]))]
    return sites(spark, sf).select("site", *terms)


def design_sql() -> str:
    out, k = ["1.0::DOUBLE AS x0"], 1
    for (a, b), ks in zip((("a1", "a2"), ("d1", "d2"), ("q1", "q2")), MODEL.knots, strict=True):
        for q in triples(ks):
            out.append(f"round(abs({ispline_sql(b, *q)} - {ispline_sql(a, *q)}), 6) AS x{k}")
            k += 1
    return f"WITH {PAIRS} SELECT i, j, {', '.join(out)} FROM pairs"


@query(design_sql())
def design_matrix(spark, sf):
    return tiles.design_rows(all_pairs(spark, sf, alike=0), MODEL)


@query(f"WITH {PAIRS} SELECT i, j, round(1 - exp(-({eta_sql(MODEL)})), 6) AS predicted FROM pairs")
def predict_fixed_model(spark, sf):
    return rounded(model.predict(pair_inputs(spark, sf), MODEL).select("i", "j", "predicted"), "predicted")


@query(f"WITH {PAIRS} SELECT i, j, round(1 - exp(-({eta_sql(GEO_MODEL)})), 6) AS predicted FROM pairs")
def predict_geo_model(spark, sf):
    return tiles.predict_rows(all_pairs(spark, sf, alike=0, geo=True), GEO_MODEL)


@query(f"WITH p AS (SELECT -1000.0 + i * (11000.0 / 199)::DOUBLE AS x FROM range(200) r(i)) SELECT round(x, 6) AS x, round({spline_sql('x', MODEL.knots[0], MODEL.coefficients[0])}, 6) AS response FROM p")
def predictor_curve(spark, sf):
    return rounded(model.predictor_curve(spark, MODEL, "acctbal"), "x", "response")


PREDICTED = f"{PAIRS}, pr AS (SELECT *, 1 - exp(-({eta_sql(MODEL)})) AS mu FROM pairs)"
DEVIANCE = """2 * sum((CASE WHEN mu = 0 THEN distance WHEN distance = 0 THEN 0 ELSE distance * ln(distance / mu) END)
  + (CASE WHEN mu = 1 THEN 1 - distance WHEN distance = 1 THEN 1 - distance ELSE (1 - distance) * ln((1 - distance) / (1 - mu)) END))"""


METRICS = ("deviance", "me", "mae", "rmse", "corr")


@query(f"WITH {PREDICTED} SELECT round({DEVIANCE}, 4) AS deviance FROM pr")
def gdm_deviance(spark, sf):
    e = tiles.errors(all_pairs(spark, sf), MODEL)
    return rounded(spark.createDataFrame([(e["deviance"],)], "deviance double"), "deviance", digits=4)


@query(f"""WITH {PREDICTED} SELECT round({DEVIANCE}, 4) AS deviance, round(avg(mu - distance), 6) AS me, round(avg(abs(mu - distance)), 6) AS mae,
  round(sqrt(avg((mu - distance) * (mu - distance))), 6) AS rmse, round(corr(distance, mu), 6) AS corr FROM pr""")
def cv_error_metrics(spark, sf):
    e = tiles.errors(all_pairs(spark, sf), MODEL)
    row = spark.createDataFrame([tuple(e[c] for c in METRICS)], ", ".join(f"{c} double" for c in METRICS))
    return rounded(rounded(row, "me", "mae", "rmse", "corr"), "deviance", digits=4)


def bin_sql(x: str, width: float, n: int) -> str:
    return f"(CASE WHEN {x} >= 0 AND {x} <= {width} THEN 1 " + " ".join(f"WHEN {x} <= {k * width!r}::DOUBLE THEN {k}" for k in range(2, n + 1)) + " END)"


@query(f"WITH {PREDICTED} SELECT CAST({bin_sql('distance', 0.05, 20)} AS INTEGER) AS bin, count(*) AS n, round(sqrt(avg((mu - distance) * (mu - distance))), 6) AS rmse FROM pr GROUP BY 1")
def rmse_by_bin(spark, sf):
    return rounded(spark.createDataFrame(tiles.errors(all_pairs(spark, sf), MODEL)["bins"], "bin int, n long, rmse double"), "rmse")


@query(f"WITH {PREDICTED}, b AS (SELECT {bin_sql('distance', 0.05, 20)} AS bin, sqrt(avg((mu - distance) * (mu - distance))) AS rmse FROM pr GROUP BY 1) SELECT round(avg(rmse), 6) AS ermse FROM b")
def equalised_rmse(spark, sf):
    e = tiles.errors(all_pairs(spark, sf), MODEL)
    return rounded(spark.createDataFrame([(e["ermse"],)], "ermse double"), "ermse")


@query(f"""WITH {SITES} SELECT 'acctbal' AS a, 'discount' AS b, round(corr(acctbal, discount), 6) AS r FROM sites UNION ALL SELECT 'acctbal', 'quantity', round(corr(acctbal, quantity), 6) FROM sites
  UNION ALL SELECT 'discount', 'quantity', round(corr(discount, quantity), 6) FROM sites""")
def correlation_matrix(spark, sf):
    return rounded(assess.correlations(sites(spark, sf), MODEL.predictors), "r")


@query(f"""WITH {SITES}, s AS (SELECT list_sort(list(quantity)) AS v, count(*) AS n FROM sites), d AS (SELECT v, n, floor((n + 3) / 2.0) / 2 AS d FROM s),
  h AS (SELECT (v[CAST(floor(d) AS BIGINT)] + v[CAST(ceil(d) AS BIGINT)]) / 2 AS lo, (v[CAST(floor(n + 1 - d) AS BIGINT)] + v[CAST(ceil(n + 1 - d) AS BIGINT)]) / 2 AS hi FROM d)
  SELECT site, CASE WHEN quantity BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo) THEN round(quantity, 9) END AS quantity FROM sites, h""")
def outlier_null(spark, sf):
    return rounded(prepare.null_outliers(sites(spark, sf).select("site", "quantity"), ["quantity"]), "quantity", digits=9)


@query(f"""WITH {PAIRS}, c AS (SELECT {bin_sql('distance', 0.025, 40)} AS bin, count(*) AS n FROM pairs GROUP BY 1)
  SELECT CAST(g.b AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(1, 41) g(b) LEFT JOIN c ON c.bin = g.b""")
def histogram_counts(spark, sf):
    return assess.histogram(pairs.sorensen_counts(composition(spark, sf)), "distance", times="n")


GINI = "SELECT {out} FROM (SELECT n, row_number() OVER (ORDER BY n) AS k, count(*) OVER () AS c FROM {source})"
EVEN = "round(1 - (2.0 * sum(k * n)::DOUBLE / (max(c) * sum(n)) - (max(c) + 1.0) / max(c)) * max(c) / (max(c) - 1.0), 6)::DOUBLE AS evenness"


@query(f"""WITH {PAIRS}, c AS (SELECT {bin_sql('distance', 0.025, 40)} AS bin, count(*) AS n FROM pairs GROUP BY 1),
  h AS (SELECT coalesce(n, 0) AS n FROM range(1, 41) g(b) LEFT JOIN c ON c.bin = g.b) {GINI.format(out=EVEN, source='h')}""")
def histogram_evenness(spark, sf):
    return rounded(assess.evenness(assess.histogram(pairs.sorensen_counts(composition(spark, sf)), "distance", times="n")), "evenness")


@query(f"WITH {COMP}, n AS (SELECT r AS n FROM rich) {GINI.format(out=EVEN, source='n')}")
def gini_evenness(spark, sf):
    return rounded(assess.evenness(pairs.with_richness(composition(spark, sf)), "richness"), "evenness")


USED = "p AS (SELECT DISTINCT l_suppkey AS i, 1 + (l_suppkey * 7 + l_linenumber * 13) % (SELECT count(*) FROM supplier) AS j FROM lineitem), u AS (SELECT s AS site, count(*) AS n FROM (SELECT i AS s FROM p UNION ALL SELECT j FROM p) GROUP BY 1)"


def used_pairs(spark, sf):
    n = t(spark, sf, "supplier").count()
    return t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("i"), (1 + (F.col("l_suppkey") * 7 + F.col("l_linenumber") * 13) % n).alias("j")).distinct()


@query(f"""WITH {USED}, a AS (SELECT coalesce(n, 0)::DOUBLE AS n FROM supplier LEFT JOIN u ON site = s_suppkey)
  SELECT min(n) AS min, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median, round(avg(n), 6) AS mean, quantile_cont(n, 0.75) AS q3, max(n) AS max FROM a""")
def site_usage_summary(spark, sf):
    use = assess.site_use(used_pairs(spark, sf), t(spark, sf, "supplier").select(F.col("s_suppkey").alias("site")))
    return rounded(assess.six_numbers(use, "n"), "mean")


@query(f"""WITH {SITES}, {USED}, e AS (SELECT min(x) AS x0, min(y) AS y0 FROM sites), b AS (SELECT site, CAST(ceil((x - x0) / 5.0::DOUBLE) AS BIGINT) AS bx, CAST(ceil((y - y0) / 5.0::DOUBLE) AS BIGINT) AS "by" FROM sites, e)
  SELECT bx, "by", count(*) AS n_sites, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM b LEFT JOIN u USING (site) GROUP BY 1, 2""")
def spatial_box_counts(spark, sf):
    return assess.spatial_boxes(sites(spark, sf), used_pairs(spark, sf), 5.0)


@query(f"""WITH {SITES}, {USED}, e AS (SELECT min(acctbal) - 0.0001 AS a0, max(acctbal) + 0.0001 AS a1, min(quantity) - 0.0001 AS q0, max(quantity) + 0.0001 AS q1 FROM sites),
  b AS (SELECT site, ceil((acctbal - a0) / ((a1 - a0) / 100)) AS bx, ceil((quantity - q0) / ((q1 - q0) / 100)) AS "by" FROM sites, e),
  g AS (SELECT bx, "by", CAST(coalesce(sum(n), 0) AS DOUBLE) AS n FROM b LEFT JOIN u USING (site) GROUP BY 1, 2) {GINI.format(out=EVEN, source='g')}""")
def env_space_evenness(spark, sf):
    return rounded(assess.evenness(assess.environment_boxes(sites(spark, sf), used_pairs(spark, sf), ("acctbal", "quantity"))), "evenness")


@query()
def fit_gdm(spark, sf):
    m = tiles.fit(all_pairs(spark, sf, geo=True), MODEL.predictors, geo=True)
    rows = [(k, round(float(c), 6)) for k, c in enumerate(m.flat())]
    return spark.createDataFrame(rows, "term int, coefficient double").withColumn("explained", F.lit(round(m.explained, 6)))


def folds_of(spark, sf, folds=3):
    df = pair_inputs(spark, sf)
    return df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("is_test", F.pmod(F.xxhash64("i", "j"), F.lit(folds)) == F.col("fold"))


@query()
def cross_validate(spark, sf):
    every = all_pairs(spark, sf, tiles.hash_bucket(3))
    return select.cross_validate(every.where((1, 2)), every.where((0,)), MODEL.predictors)


@query()
def backward_elimination(spark, sf):
    return spark.createDataFrame(select.backward_elimination(all_pairs(spark, sf, tiles.hash_bucket(3)), MODEL), "n long, predictors string, train_d2 double, test_d2 double, rmse double, ermse double, dropped string")


@query()
def significance(spark, sf):
    found = [select.significance(pair_inputs(spark, sf), MODEL, p) for p in MODEL.predictors]
    return spark.createDataFrame([(p, *map(float, f.values())) for p, f in zip(MODEL.predictors, found, strict=True)], "predictor string, d2 double, p double, least_gain double, largest_gain double")


@query()
def gdm_builder(spark, sf):
    b = select.build(sites(spark, sf), composition(spark, sf), MODEL.predictors, geo=True, threshold=0.9, least_d2=-1e9)
    return spark.createDataFrame([(k, float(c)) for k, c in enumerate(b.model.flat())], "term int, coefficient double").withColumn("predictors", F.lit(",".join(b.model.predictors)))


@query()
def gdm_single_model(spark, sf):
    b = select.build_single(sites(spark, sf), composition(spark, sf), MODEL.predictors)
    return spark.createDataFrame([(k, float(c)) for k, c in enumerate(b.model.flat())], "term int, coefficient double").withColumn("explained", F.lit(round(b.model.explained, 6)))


# --- grids and after ---------------------------------------------------------------------------


def transform_sql(method: str) -> str:
    out = []
    for p, ks, cs in zip(GRID_MODEL.predictors, GRID_MODEL.knots, GRID_MODEL.coefficients, strict=True):
        lo, hi = sql_lines(ks, cs, method)
        v = f"CASE WHEN {p} < {ks[0]} THEN {p} * {lo[0]!r}::DOUBLE + {lo[1]!r}::DOUBLE WHEN {p} > {ks[-1]} THEN {p} * {hi[0]!r}::DOUBLE + {hi[1]!r}::DOUBLE ELSE {spline_sql(p, ks, cs)} END"
        out.append(f"round({v}, 9) AS {p}")
    return f"WITH {GRID} SELECT row, col, {', '.join(out)} FROM grid"


def sql_lines(ks: list[float], cs: list[float], method: str):
    """Slopes and constants for the SQL, in the same arithmetic, since results are compared as rounded."""

    def f(v: float) -> float:
        total = 0.0
        for (a, b, c), w in zip(triples(ks), cs, strict=True):
            total += w * (0.0 if v <= a else 1.0 if v >= c else (v - a) / (b - a) * ((v - a) / (c - a)) if v < b else 1 - (c - v) / (c - b) * ((c - v) / (c - a)))
        return total

    a, z = ks[0], ks[-1]
    if method == "Clamped":
        return (0.0, 0.0), (0.0, sum(cs))
    tenth = (z - a) / 10
    m1, m0 = (f(z) - f(z - tenth)) / tenth, (f(a + tenth / 10) - f(a)) / (tenth / 10)
    top, low = (m1, f(z) - z * m1), (m0, f(a) - a * m0)
    m = (f(z) - f(a)) / (z - a)
    whole = (m, f(a) - a * m)
    if method == "WholeGrad":
        return whole, whole
    if method == "End10":
        return low, top
    x1, x0 = z + (z - a) / 100, a - (z - a) / 1000
    at = lambda line, x: line[0] * x + line[1]
    return (whole if at(whole, x0) > at(low, x0) else low), (whole if at(whole, x1) < at(top, x1) else top)


def _transform(method: str):
    def run(spark, sf):
        return rounded(grids.transform_grids(grid(spark, sf), GRID_MODEL, method), *GRID_MODEL.predictors, digits=9)

    run.__name__ = f"grid_transform_{method.lower()}"
    return query(transform_sql(method))(run)


for _m in grids.METHODS:
    _transform(_m)


GEO_GRID = model.Model(GRID_MODEL.predictors, [[0.0, 10.0, 30.0], *GRID_MODEL.knots], [[0.3, 0.2, 0.4], *GRID_MODEL.coefficients], geo=True)


@query(f"""WITH {GRID} SELECT row, col, {', '.join(f'''CASE WHEN nation IS NOT NULL THEN round(CASE WHEN {at} > 30 THEN 0.9 ELSE {spline_sql(f"CAST({at} AS DOUBLE)", GEO_GRID.knots[0], GEO_GRID.coefficients[0])} END, 6) END AS {n}''' for n, at in (("GeoX", "col"), ("GeoY", "row")))} FROM grid""")
def geo_transform(spark, sf):
    return rounded(grids.transform_grids(grid(spark, sf), GEO_GRID, "Clamped", header(spark, sf)).select("row", "col", "GeoX", "GeoY"), "GeoX", "GeoY")


def summed_extrapolation_sql() -> str:
    out = []
    for p, ks, cs in zip(GRID_MODEL.predictors, GRID_MODEL.knots, GRID_MODEL.coefficients, strict=True):
        lo, hi = sql_lines(ks, cs, "Conservative")
        out.append(f"(CASE WHEN {p} < {ks[0]} THEN abs({p} * {lo[0]!r}::DOUBLE + {lo[1]!r}::DOUBLE) WHEN {p} > {ks[-1]} THEN abs({p} * {hi[0]!r}::DOUBLE + {hi[1]!r}::DOUBLE - {sum(cs)!r}::DOUBLE) ELSE 0 END)")
    return f"WITH {GRID} SELECT row, col, round({' + '.join(out)}, 6) AS extrapolation FROM grid"


@query(summed_extrapolation_sql())
def summed_extrapolation(spark, sf):
    return rounded(grids.extrapolation(grid(spark, sf), GRID_MODEL), "extrapolation")


@query(f"WITH {OCC}, {GRID} SELECT species, count(*) AS n, count(balance) AS n_on, round(avg(balance), 6) AS balance FROM occ LEFT JOIN grid ON col = floor(x) AND row = floor((SELECT ceil((max(c_custkey) + 1) / {SIZE}.0) FROM customer) - y) GROUP BY species")
def raster_lookup(spark, sf):
    found = grids.extract(occurrences(spark, sf), grid(spark, sf), header(spark, sf), ["balance"], "decimalLongitude", "decimalLatitude")
    return found.groupBy("species").agg(F.count("*").alias("n"), F.count("balance").alias("n_on"), F.round(F.avg("balance"), 6).alias("balance"))


@query(f"""WITH {PAIRS}, {GRID}, h AS (SELECT ceil((max(c_custkey) + 1) / {SIZE}.0) AS top FROM customer) SELECT i, j, a.balance AS s1_balance, b.balance AS s2_balance FROM pairs JOIN h ON true
  LEFT JOIN grid a ON a.col = floor(x1) AND a.row = floor(top - y1) LEFT JOIN grid b ON b.col = floor(x2) AND b.row = floor(top - y2)""")
def pair_grid_extract(spark, sf):
    every = pairs.all_pair_shared(composition(spark, sf))
    return grids.extract_all_pairs(every, sites(spark, sf), grid(spark, sf), header(spark, sf), ["balance"]).select("i", "j", "s1_balance", "s2_balance")


@query(f"WITH h AS (SELECT CAST(ceil((max(c_custkey) + 1) / {SIZE}.0) AS BIGINT) AS n FROM customer) SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, (c + 0.5)::DOUBLE AS x, (n - (r + 0.5))::DOUBLE AS y FROM h, LATERAL (SELECT unnest(range(n)) AS r), range({SIZE}) q(c)")
def raster_centroids(spark, sf):
    return grids.centroids(spark, header(spark, sf))


@query(f"WITH {GRID} SELECT 'balance' AS layer, min(balance) AS min, max(balance) AS max, count(balance) AS n FROM grid UNION ALL SELECT 'nation', min(nation), max(nation), count(nation) FROM grid")
def layer_ranges(spark, sf):
    return grids.layer_ranges(grid(spark, sf), ["balance", "nation"])


@query(f"WITH {GRID} SELECT count(*) FILTER (WHERE balance IS NOT NULL AND nation <= 5) AS only_a, count(*) FILTER (WHERE balance IS NULL AND nation > 5) AS only_b FROM grid")
def grid_conformity(spark, sf):
    g = grid(spark, sf)
    return grids.one_sided(g.select("row", "col", F.col("balance").alias("value")), g.select("row", "col", F.when(F.col("nation") > 5, F.col("nation")).alias("value")))


def epochs(spark, sf):
    first = grids.transform_grids(grid(spark, sf), GRID_MODEL, "Clamped")
    second = first.select("row", "col", (F.col("balance") + F.lit(0.1) * (F.col("col") % 7)).alias("balance"), (F.col("nation") + F.lit(0.05) * (F.col("row") % 3)).alias("nation"))
    return first, second


EPOCHS = transform_sql("Clamped").replace("round(", "(").replace(", 9)", ")")
EPOCH = f"e0 AS ({EPOCHS}), e1 AS (SELECT row, col, balance + 0.1::DOUBLE * (col % 7) AS balance, nation + 0.05::DOUBLE * (row % 3) AS nation FROM e0)"


@query(f"WITH {EPOCH} SELECT row, col, round(1 - exp(-(abs(e0.balance - e1.balance) + abs(e0.nation - e1.nation))), 6) AS dissimilarity FROM e0 JOIN e1 USING (row, col)")
def two_epoch_dissimilarity(spark, sf):
    return rounded(grids.two_epoch(*epochs(spark, sf), ["balance", "nation"]), "dissimilarity")


def demand(spark):
    return spark.createDataFrame([(k, 0.1 * k, 0.07 * k) for k in range(1, 9)], "point long, balance double, nation double")


DEMAND = "pts AS (SELECT k AS point, 0.1::DOUBLE * k AS balance, 0.07::DOUBLE * k AS nation FROM range(1, 9) r(k))"


@query(f"""WITH {EPOCH}, {DEMAND}, m AS (SELECT point, (SELECT 1 - exp(-min(abs(e0.balance - pts.balance) + abs(e0.nation - pts.nation))) FROM e0) AS d0,
  (SELECT 1 - exp(-min(abs(e1.balance - pts.balance) + abs(e1.nation - pts.nation))) FROM e1) AS d1 FROM pts) SELECT point, round(d0, 6) AS d0, round(d1, 6) AS d1, round(d1 - d0, 6) AS difference FROM m""")
def impact_table(spark, sf):
    return rounded(grids.impact(*epochs(spark, sf), demand(spark), ["balance", "nation"]), "d0", "d1", "difference")


@query(f"WITH {DEMAND} SELECT a.point AS a, b.point AS b, round(1 - exp(-(abs(a.balance - b.balance) + abs(a.nation - b.nation))), 6) AS value FROM pts a JOIN pts b ON a.point < b.point")
def demand_point_table(spark, sf):
    return rounded(grids.point_table(demand(spark), ["balance", "nation"]), "value")


def similarity_sql(how: str) -> str:
    agg = "avg(x)" if how == "mean" else "quantile_cont(x, 0.5)"
    return f"""WITH e AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, k, {agg} AS x FROM e GROUP BY 1, 2)
  SELECT a.label AS a, b.label AS b, round(exp(-sum(abs(a.x - b.x))), 6) AS similarity FROM m a JOIN m b ON a.k = b.k AND a.label <= b.label GROUP BY 1, 2"""


@query(similarity_sql("mean"))
def class_mean_similarity(spark, sf):
    return rounded(grids.class_similarity(grids.class_vectors(vectors(spark, sf), "label", "v"), "label", "v"), "similarity")


@query(similarity_sql("median"))
def class_median_similarity(spark, sf):
    return rounded(grids.class_similarity(grids.class_vectors(vectors(spark, sf), "label", "v", "median"), "label", "v"), "similarity")


@query(f"""WITH {EPOCH}, s AS (SELECT * FROM e0 WHERE (row * 31 + col * 17) % 20 = 0) SELECT a.row, a.col, round(sum(exp(-(abs(a.balance - s.balance) + abs(a.nation - s.nation)))) / 0.05, 6) AS density FROM e0 a, s GROUP BY 1, 2""")
def density_sum(spark, sf):
    cells = epochs(spark, sf)[0]
    sample = cells.where((F.col("row") * 31 + F.col("col") * 17) % 20 == 0)
    return rounded(grids.density(cells, sample, ["balance", "nation"], 0.05), "density")


KNN = """n AS (SELECT a.vec_id AS id, b.label, b.vec_id AS tid, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda k: abs(CAST(a.embedding[k] AS DOUBLE) - b.embedding[k]))) AS dist FROM embeddings a, embeddings b),
k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(dist, 9), tid) <= 10)"""


def training(spark, sf):
    return vectors(spark, sf).select(F.col("id").alias("tid"), "label", "v")


@query(f"""WITH {KNN}, w AS (SELECT id, label, exp(-dist * dist / (2 * (avg(dist) OVER (PARTITION BY id) * 0.5) * (avg(dist) OVER (PARTITION BY id) * 0.5))) AS w FROM k)
  SELECT id, label, round(sum(w) / sum(sum(w)) OVER (PARTITION BY id), 5) AS p FROM w GROUP BY 1, 2""")
def knn_class_probability(spark, sf):
    return rounded(grids.class_probability(grids.nearest(vectors(spark, sf), training(spark, sf), 10), 0.5), "p", digits=5)


@query("""WITH n AS (SELECT a.vec_id AS id, a.label = b.label AS same, b.vec_id AS tid, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda k: abs(CAST(a.embedding[k] AS DOUBLE) - b.embedding[k]))) AS dist
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
  k AS (SELECT id, same, dist, row_number() OVER (PARTITION BY id ORDER BY round(dist, 9), tid) AS rank FROM n QUALIFY rank <= 100),
  s AS (SELECT least(100, count(*) - 1) AS top, count(*) AS c FROM embeddings), j AS (SELECT unnest(range(least(30, top), top + 1)) AS j FROM s), r AS (SELECT range / 10 AS r FROM range(1, 10)),
  m AS (SELECT id, j, avg(dist) AS m FROM k JOIN j ON rank <= j GROUP BY 1, 2),
  w AS (SELECT id, j, r, same, exp(-dist * dist / (2 * (m * r) * (m * r))) AS w FROM k JOIN m USING (id) JOIN r ON true WHERE rank <= j),
  p AS (SELECT id, j, r, coalesce(sum(w) FILTER (WHERE same), 0) / sum(w) AS p FROM w GROUP BY 1, 2, 3)
  SELECT CAST(j AS INTEGER) AS j, r::DOUBLE AS r, round(sum((1 - p) * (1 - p)) / j, 6) AS score FROM p GROUP BY 1, 2, j""")
def best_jr(spark, sf):
    return rounded(grids.best_jr(training(spark, sf))[2], "score")


@query(f"WITH {GRID} SELECT segment AS zone, count(balance) AS n_cells, round(sum(balance), 4) AS total, round(avg(balance), 6) AS mean FROM grid GROUP BY 1")
def zonal_counts(spark, sf):
    g = grid(spark, sf)
    out = grids.zonal_counts(g.select("row", "col", F.col("segment").alias("zone")), g.select("row", "col", F.col("balance").alias("value")))
    return rounded(rounded(out, "mean"), "total", digits=4)


@query(f"WITH {GRID} SELECT segment AS class, {', '.join(f'count(*) FILTER (WHERE nation = {k}) AS r_{k}' for k in range(25))} FROM grid GROUP BY 1")
def region_crosstab(spark, sf):
    g = grid(spark, sf)
    return grids.crosstab(g.select("row", "col", F.col("segment").alias("class")), g.select("row", "col", F.col("nation").cast("int").alias("region")), range(25))


@query(f"WITH {COMP} SELECT site, {', '.join(f'max(CAST(species = {k} AS INT)) AS sp_{k}' for k in range(1, 21))} FROM comp GROUP BY 1")
def site_by_species_pivot(spark, sf):
    return grids.site_by_species(composition(spark, sf), range(1, 21))


@query("WITH ab AS (SELECT l_suppkey AS site, l_partkey AS species, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2) SELECT site, " + ", ".join(f"sum(CASE WHEN species = {k} THEN n ELSE 0 END) AS sp_{k}" for k in range(1, 6)) + " FROM ab GROUP BY 1")
def site_by_species_abundance(spark, sf):
    return grids.site_by_species(abundance(spark, sf), range(1, 6), "n")


@query(f"WITH {COMP} SELECT site, species, 1 AS n FROM comp")
def site_by_all_species(spark, sf):
    return grids.site_by_species(composition(spark, sf)).select("site", F.explode("species").alias("species", "n"))


@query("SELECT l_suppkey AS site, l_partkey AS species, sum(l_quantity)::DOUBLE AS n FROM lineitem GROUP BY 1, 2")
def site_by_all_species_abundance(spark, sf):
    return grids.site_by_species(abundance(spark, sf), abundance="n").select("site", F.explode("species").alias("species", "n"))


@query(f"""WITH {GRID}, m AS (SELECT row, col, balance IS NOT NULL AS f, col - row_number() OVER (PARTITION BY row, balance IS NOT NULL ORDER BY col) AS g FROM grid)
  SELECT row, min(col) AS start, CASE WHEN f THEN count(*) ELSE -count(*) END AS length FROM m GROUP BY row, f, g""")
def rle_runs(spark, sf):
    return grid_io.runs(grid(spark, sf), "balance").select("row", "start", "length")


@query(f"""WITH {GRID}, c AS (SELECT row, col, balance, nation FROM grid), d AS (SELECT *, CASE WHEN nation = 3 THEN 0.0 ELSE abs(nation - 3) / 2 END::DOUBLE AS d FROM c)
  SELECT row, col, round({spline_sql('d', [0.0, 4.0, 10.0], [0.3, 0.2, 0.5])}, 6) AS nation FROM d""")
def categorical_transform(spark, sf):
    table = spark.range(25).crossJoin(spark.range(25).withColumnRenamed("id", "b")).where("id > b").select(F.col("id").cast("double").alias("class_a"), F.col("b").cast("double").alias("class_b"), (F.abs(F.col("id") - F.col("b")) / 2.0).alias("dist"))
    return rounded(grids.categorical_transform(grid(spark, sf), "nation", 3, table, [0.0, 4.0, 10.0], [0.3, 0.2, 0.5]), "nation")


@query(f"""WITH c AS (SELECT 6378137.0::DOUBLE AS a, (2 / 298.257222101 - 1 / (298.257222101 * 298.257222101))::DOUBLE AS e2, pi() / 180 AS k), e AS (SELECT *, sqrt(e2) AS e FROM c),
  q AS (SELECT *, (1 - e2) * (sin(-18 * k) / (1 - e2 * sin(-18 * k) * sin(-18 * k)) - ln((1 - e * sin(-18 * k)) / (1 + e * sin(-18 * k))) / (2 * e)) AS q1,
    (1 - e2) * (sin(-36 * k) / (1 - e2 * sin(-36 * k) * sin(-36 * k)) - ln((1 - e * sin(-36 * k)) / (1 + e * sin(-36 * k))) / (2 * e)) AS q2,
    cos(-18 * k) * cos(-18 * k) / (1 - e2 * sin(-18 * k) * sin(-18 * k)) AS m1, cos(-36 * k) * cos(-36 * k) / (1 - e2 * sin(-36 * k) * sin(-36 * k)) AS m2 FROM e),
  n AS (SELECT *, (m1 - m2) / (q2 - q1) AS n FROM q), z AS (SELECT *, m1 + n * q1 AS cc FROM n), {SITES}, g AS (SELECT site, 115.0 + x AS lon, -40.0 + y AS lat FROM sites),
  s AS (SELECT site, lon, a, n, cc, (1 - e2) * (sin(lat * k) / (1 - e2 * sin(lat * k) * sin(lat * k)) - ln((1 - e * sin(lat * k)) / (1 + e * sin(lat * k))) / (2 * e)) AS ql, n * (lon - 132.0) * k AS th FROM g, z)
  SELECT site, round(a * sqrt(cc - n * ql) / n * sin(th), 3) AS px, round(a * sqrt(cc) / n - a * sqrt(cc - n * ql) / n * cos(th), 3) AS py FROM s""")
def albers_projection(spark, sf):
    x, y = fn.albers(F.lit(115.0) + F.col("x"), F.lit(-40.0) + F.col("y"))
    return sites(spark, sf).select("site", F.round(x, 3).alias("px"), F.round(y, 3).alias("py"))


@query("SELECT o_orderkey, round(0.05 + 0.95 / (1 + pow(o_totalprice / 50000.0, 3)), 6) AS w, round(exp(-0.5 * (o_totalprice / 100000.0) * (o_totalprice / 100000.0)), 6) AS g FROM orders")
def decay_and_gaussian_weights(spark, sf):
    p = F.col("o_totalprice")
    return t(spark, sf, "orders").select("o_orderkey", F.round(fn.decay(p, 0.05, 50000.0, 3), 6).alias("w"), F.round(fn.gaussian_weight(p, 100000.0), 6).alias("g"))


@query(f"""WITH {GRID}, c AS (SELECT row, col, balance AS x, nation AS y FROM grid WHERE balance IS NOT NULL AND nation IS NOT NULL),
  s AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS d FROM c),
  e AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) - d AS u FROM s), v AS (SELECT *, sqrt(u * u + b * b) AS z FROM e),
  q AS (SELECT row, col, ((x - mx) * u + (y - my) * b) / z AS p1, ((y - my) * u - (x - mx) * b) / z AS p2 FROM c, v)
  SELECT row, col, round((p1 - min(p1) OVER ()) / (max(p1) OVER () - min(p1) OVER ()) * 255, 4) AS pc1, round((p2 - min(p2) OVER ()) / (max(p2) OVER () - min(p2) OVER ()) * 255, 4) AS pc2 FROM q""")
def pca_rgb(spark, sf):
    return rounded(grids.pca_rgb(grid(spark, sf), ["balance", "nation"]), "pc1", "pc2", digits=4)


@query()
def hierarchical_classes(spark, sf):
    v = vectors(spark, sf)
    return cluster.classify(v, cluster.subsample(v, 60, "id"), 6)[0]


@query()
def nearest_centres(spark, sf):
    v = vectors(spark, sf)
    x = np.array(cluster.subsample(v, 100, "id").toPandas().v.to_list())
    out = cluster.assign(v, cluster.k_clusters(x, 4)[1])
    return rounded(out.select("id", "class", "class_distance"), "class_distance")


@query("SELECT label, least(count(*), 20) AS n FROM embeddings GROUP BY label")
def balanced_sample(spark, sf):
    return cluster.balanced_sample(vectors(spark, sf), "label", 20, "id").groupBy("label").agg(F.count("*").alias("n"))


from betascape.plans import core  # noqa: E402, F401  registers its queries here
