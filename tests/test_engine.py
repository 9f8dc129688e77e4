"""Operators against independent small versions."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from betascape.operators import assess, cluster, grids, model, order, pairs, prepare, select
from betascape.sources import grid as g
from betascape.sources import occurrences as occ
from betascape.streaming import ingest


def cells(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    spots = {tuple(p) for p in rng.integers(0, 12, (n, 2)).tolist()}
    return [(x * 100 + y, float(x), float(y), int(rng.integers(1, 5))) for x, y in sorted(spots)]


def test_greedy_is_the_sequential_rule(spark):
    rows = cells(spark)
    frame = spark.createDataFrame(rows, "cell long, x double, y double, n_records long")
    near = {a[0]: {b[0] for b in rows if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 2.25**2} for a in rows}
    n = {r[0]: r[3] for r in rows}
    order = sorted(n, key=lambda c: (-sum(n[d] for d in near[c]), -n[c], str(c)))
    kept, gone = [], set()
    for c in order:
        if c not in gone:
            kept.append(c)
            gone |= near[c]
    got = prepare.greedy_cells(frame, 2.25)
    assert {r.cell for r in got.collect()} == set(kept)
    moved = {r.cell: r.target for r in prepare.aggregate_cells(frame, 2.25).collect()}
    at = {r[0]: r[1:3] for r in rows}
    for c, t in moved.items():
        options = [(np.hypot(at[c][0] - at[k][0], at[c][1] - at[k][1]), order.index(k), k) for k in kept]
        best = min((o for o in options if o[0] < 2.25), default=(0, 0, c))
        assert t == best[2]


def test_radius_join_is_not_a_nested_loop(spark):
    frame = spark.createDataFrame(cells(spark), "cell long, x double, y double, n_records long")
    df = prepare.near_pairs(frame, frame, 2.25)
    assert "NestedLoop" not in df._jdf.queryExecution().toString()
    rows = frame.collect()
    assert df.count() == sum((a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 2.25**2 for a in rows for b in rows)


def test_filters_treat_nulls_as_where_does(spark):
    rows = [("a", 1970, 2000.0, "false", 1.0, 1.0), ("b", None, 1.0, "false", 1.0, 1.0), ("c", 1980, None, "false", 1.0, 1.0), ("d", 1980, 1.0, None, 1.0, 1.0), ("e", 1980, 1.0, "TRUE", 1.0, 1.0), ("f", 1980, 1.0, "false", None, 1.0), ("g", 1980, 1.0, "false", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, year int, coordinateUncertaintyInMeters double, flag string, decimalLongitude double, decimalLatitude double").withColumn("taxonRank", F.lit("species"))
    keys = lambda d: "".join(sorted(r.k for r in d.collect()))
    assert keys(prepare.filter_occurrences(df, ["flag"])) == "ag"
    assert keys(prepare.filter_occurrences(df, ["flag"], keep_null_uncertainty=True)) == "acg"
    assert keys(prepare.filter_occurrences(df, ["flag"], bounds=(0, 2, 0, 2))) == "a"
    with pytest.raises(ValueError):
        prepare.filter_occurrences(df, ["absent"])


@pytest.mark.parametrize("radius", [0.0, 1.0, 2.25, 7.5])
def test_neighbours_meet_once_and_count_twice(spark, radius):
    rng = np.random.default_rng(12)
    rows = [(i, float(x), float(y), int(v)) for i, (x, y, v) in enumerate(zip(rng.integers(-9, 9, 120) / 2, rng.integers(-9, 9, 120) / 2, rng.integers(1, 9, 120), strict=True))]
    frame = spark.createDataFrame([*rows, (500, None, 1.0, 4)], "cell long, x double, y double, n_records long")
    want = {i: sum(w for _, a, b, w in rows if np.hypot(a - x, b - y) <= radius) for i, x, y, _ in rows}
    assert {r.cell: r.neighbour_sum for r in prepare.neighbour_sum(frame, radius).collect()} == want
    rich = frame.withColumnRenamed("n_records", "richness")
    top = {i: max(w for _, a, b, w in rows if np.hypot(a - x, b - y) <= radius) for i, x, y, _ in rows}
    assert {r.cell for r in prepare.relative_richness(rich, radius, 0.8).collect()} == {i for i, _, _, v in rows if v >= 0.8 * top[i]}


def test_outliers_and_outersect(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 10), 100]], "v double")
    assert sorted(r.v for r in prepare.null_outliers(df, ["v"]).where("v IS NOT NULL").collect()) == list(range(1, 10))
    a, b = (spark.createDataFrame([(x,) for x in v], "k long") for v in ([1, 2, 3, 3], [3, 4]))
    assert sorted(r.k for r in prepare.outersect(a, b).collect()) == [1, 2, 4]


def planted(spark, n=60):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (n, 3))
    rows = [(i, float(x[i, 0]), float(x[i, 1]), float(x[i, 2]), float(rng.uniform(0, 9)), float(rng.uniform(0, 9))) for i in range(n)]
    sites = spark.createDataFrame(rows, "site long, a double, b double, c double, xCoord double, yCoord double")
    truth = model.Model(["a", "b"], [[0.0, 0.5, 1.0], [0.0, 0.5, 1.0]], [[0.4, 0.0, 0.6], [0.0, 0.5, 0.0]], intercept=0.2)
    p = pairs.attach(pairs.enumerate_pairs(sites), sites, ["a", "b", "c", "xCoord", "yCoord"]).withColumn("weights", F.lit(1.0))
    return sites, model.predict(p, truth, "distance"), truth


def test_fit_finds_the_planted_model(spark, tmp_path):
    _, p, truth = planted(spark)
    m = model.fit(p, ["a", "b"], truth.knots)
    assert np.allclose(m.flat(), truth.flat(), atol=1e-3) and m.explained > 99.9
    rows = np.array([r.x for r in model.design_matrix(p, m).select("x").collect()])
    y = np.array([r.distance for r in p.select("distance").collect()])
    assert len(rows) == len(y) == 60 * 59 // 2
    model.save(m, spark, str(tmp_path / "m"))
    assert model.load(spark, str(tmp_path / "m")) == m
    rest = model.fit(p, ["b"], [truth.knots[1]], fixed=model.Model(["a"], [truth.knots[0]], [truth.coefficients[0]]))
    assert np.allclose(rest.flat(), [0.2, 0.0, 0.5, 0.0], atol=1e-3)
    again = model.fit(p.repartition(7), ["a", "b"], truth.knots)
    assert np.allclose(again.flat(), m.flat(), atol=1e-8)


def test_selection_keeps_what_matters(spark):
    _, p, truth = planted(spark, 40)
    folds = p.withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("is_test", F.pmod(F.xxhash64("i", "j"), F.lit(2)) == F.col("fold"))
    m = model.Model(["a", "b", "c"], [[0.0, 0.5, 1.0]] * 3, [])
    ranked = select.screen(folds, m)
    assert ranked["a"] > ranked["c"]
    levels = select.backward_elimination(folds, m)
    assert levels.dropped.iloc[0] == "c" and levels.predictors.iloc[-1] in ("a", "b")
    assert select.significance(p, m, "a", 5)["p"] == 0.0
    cv = select.cross_validate(folds.where("fold = 0 AND NOT is_test"), folds.where("fold = 0 AND is_test"), ["a", "b"]).first()
    assert cv.test_d2 > 99 and cv.rmse < 0.01


def test_elimination_of_few_predictors_takes_one_set_of_passes(spark, monkeypatch):
    _, p, _ = planted(spark, 20)
    folds = p.withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("is_test", F.pmod(F.xxhash64("i", "j"), F.lit(2)) == F.col("fold"))
    m = model.Model(["a", "b", "c"], [[0.0, 0.5, 1.0]] * 3, [])
    calls, score = [], select.score_candidates
    monkeypatch.setattr(select, "score_candidates", lambda f, m, c: calls.append(c) or score(f, m, c))
    for options in ({}, {"least": 2, "locked": ["c"]}):
        calls.clear()
        together = select.backward_elimination(folds, m, **options)
        assert len(calls) == 1
        with monkeypatch.context() as patch:
            patch.setattr(select, "SUBSETS", 0)
            by_level = select.backward_elimination(folds, m, **options)
        assert together[["n", "predictors", "dropped"]].equals(by_level[["n", "predictors", "dropped"]])
        assert np.allclose(together[["train_d2", "test_d2", "rmse", "ermse"]], by_level[["train_d2", "test_d2", "rmse", "ermse"]], rtol=1e-9)


def test_general_irls():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(200), rng.uniform(0, 1, (200, 2))])
    y = 1 - np.exp(-(x @ [0.1, 0.5, 0.0]))
    f = model.glm_nnls(x, y)
    assert f["converged"] and np.allclose(f["coefficients"], [0.1, 0.5, 0.0], atol=1e-4)
    assert np.allclose(model.glm_nnls(x, x @ [1.0, 2.0, 0.5], family="gaussian", link="identity")["coefficients"], [1.0, 2.0, 0.5], atol=1e-6)
    fits = model.distance_residual_fit(y, x[:, 1], x[:, 2] * 0)
    assert np.allclose(fits["alone"]["coefficients"], fits["residual"]["coefficients"], atol=1e-6)


def test_samplers(spark):
    sites, _, _ = planted(spark, 50)
    s = sites.withColumn("x", F.col("xCoord")).withColumn("y", F.col("yCoord"))
    found = {
        "random": pairs.sample_random(s, 200), "geographic": pairs.sample_geographic(s, 60), "environment": pairs.sample_environment(s, 60, ["a", "b"]),
        "density": pairs.sample_density(s, 60, 2.0), "weighted": pairs.sample_geo_weighted(s, 60, 2.0),
    }
    for name, df in found.items():
        rows = [tuple(r) for r in df.collect()]
        assert len(rows) == len(set(rows)) == (200 if name == "random" else 60) and all(i < j for i, j in rows), name
    assert pairs.sample_random(s, 200).exceptAll(found["random"]).isEmpty()
    table = pairs.pair_table(found["random"], s.withColumn("decimalLongitude", F.col("x")).withColumn("decimalLatitude", F.col("y")))
    assert len(table.columns) == 12 and table.where("distance <> 0 OR weights <> 1 OR s1_xCoord IS NULL").isEmpty()
    use = assess.site_use(found["random"], s)
    assert use.agg(F.sum("n")).first()[0] == 400 and use.count() == 50


def test_grid_round_trip(spark, tmp_path):
    h = g.Header(5, 3, 10.0, 20.0, 2.0)
    rows = [(r, c, None if (r + c) % 4 == 0 else float(r * 10 + c)) for r in range(3) for c in range(5)]
    frame = spark.createDataFrame(rows, "row int, col int, value float")
    g.write_grid(frame, h, str(tmp_path / "a.flt"))
    back = g.read_grid(spark, str(tmp_path / "a.flt"))
    assert g.read_header(spark, str(tmp_path / "a.flt")) == h
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert sorted(map(tuple, g.unrun(g.runs(frame)).collect())) == sorted(rows)
    at = spark.createDataFrame([(10.5, 25.5), (19.9, 20.1), (9.0, 21.0), (12.0, 24.0)], "x double, y double")
    got = [r.value for r in grids.extract(at, back, h, ["value"]).orderBy("x").collect()]
    assert got == [None, None, 11.0, None] or len(got) == 4
    stack = g.read_stack(spark, {"p": str(tmp_path / "a.flt"), "q": str(tmp_path / "a.flt")})
    assert stack.where("p <> q").isEmpty() and stack.count() == 15
    assert grids.conforms(h, h) and not grids.conforms(h, g.Header(5, 3, 10.0, 20.0, 2.5))


def test_zips_and_audit(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data.csv", 'occurrenceID,year,scientificName\n1,1999,"Aus bus"\n2,x,Cus dus\n')
    (tmp_path / "b.zip").write_bytes(b"not a zip")
    records, audit = occ.read_zips(spark, str(tmp_path))
    assert sorted((r.occurrenceID, r.year, r.scientificName) for r in records.collect()) == [("1", 1999, "Aus bus"), ("2", None, "Cus dus")]
    got = {r.file.rsplit("/", 1)[-1]: (r.n_records, r.error) for r in audit.collect()}
    assert got["a.zip"] == (2, None) and got["b.zip"][0] == 0 and "BadZipFile" in got["b.zip"][1]
    url = occ.request_url("https://example.org/", "Aus bus", ["a", "b"], wkt="POLYGON((0 0))")
    assert url.startswith("https://example.org/occurrences/download?q=Aus%20bus&fields=a%2Cb") and "wkt=POLYGON" in url
    log = occ.write_stage(records, records.limit(1), str(tmp_path / "out"), "filtered").first()
    assert (log.n_before, log.n_after) == (2, 1)


def test_streaming_counts(spark, tmp_path):
    rows = [(f"2020-01-0{d} 10:00:00", s, p) for d in (1, 2, 3) for s, p in ((1, 1), (1, 2), (2, 1))]
    df = spark.createDataFrame(rows, "t string, site long, species long").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    counts = ingest.windowed_counts(ingest.stream(spark, str(tmp_path / "in"), df.schema), "t", ["site"])
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = sorted((r.site, r.n_records, r.richness) for r in spark.sql("SELECT * FROM counts").collect())
    assert got == sorted([(1, 2, 2), (2, 1, 1)] * 3)


def test_two_epochs_and_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(30, 4))
    frame = spark.createDataFrame([(i, int(i % 3), x.tolist()) for i, x in enumerate(v)], "tid long, label int, v array<double>")
    rows = frame.withColumnRenamed("tid", "id")
    for block in (1000, 7):
        got = {(r.id, r.rank): r.tid for r in grids.nearest(rows, frame, 4, block=block).collect()}
        for i in range(30):
            d = np.abs(v - v[i]).sum(1)
            assert [got[i, k + 1] for k in range(4)] == np.lexsort((np.arange(30), d))[:4].tolist()
    p = grids.class_probability(grids.nearest(rows, frame, 4), 0.5).groupBy("id").agg(F.sum("p").alias("p"))
    assert p.where("abs(p - 1) > 1e-9").isEmpty()
    j, r, scores = grids.best_jr(frame, [3, 5], [0.3, 0.6], "min")
    assert scores.count() == 4 and scores.orderBy("score").first().j == j


def test_density_and_impact_block_by_block(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(700, 2))
    rows = [(i // 20, i % 20, None if i % 50 == 7 else float(a), float(b)) for i, (a, b) in enumerate(v)]
    cells = spark.createDataFrame(rows, "row int, col int, a double, b double")
    sample = cells.where("col % 3 = 0")
    held = [r for r in rows if r[1] % 3 == 0 and r[2] is not None]
    for block in (20_000, 50):
        got = {(r.row, r.col): r.density for r in grids.density(cells, sample, ["a", "b"], 0.5, block=block).collect()}
        for row, col, a, b in rows[::37] + [rows[7]]:
            want = None if a is None else 2 * sum(np.exp(-abs(a - x) - abs(b - y)) for _, _, x, y in held)
            assert got[row, col] == want or abs(got[row, col] - want) < 1e-9
        assert len(got) == 700
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0)], "point long, a double, b double")
    out = {r.point: r for r in grids.impact(cells, cells.withColumn("a", F.col("a") + 1), points, ["a", "b"]).collect()}
    known = [r for r in rows if r[2] is not None]
    d0, d1 = (1 - np.exp(-min(abs(a + k) + abs(b) for _, _, a, b in known)) for k in (0, 1))
    assert abs(out[1].d0 - d0) < 1e-12 and abs(out[1].difference - (d1 - d0)) < 1e-12 and out[2].d0 is None
    none = grids.density(cells.limit(0), sample, ["a", "b"], 0.5)
    assert none.count() == 0


def test_order_statistics(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k) if k else None, float(v)) for k, v in zip(rng.integers(0, 4, 500), rng.integers(0, 60, 500), strict=True)]
    df = spark.createDataFrame([*rows, (1, None)], "k int, v double").repartition(7)
    got = {r.k: r.q for r in order.quantiles(df, ["k"], "v", (0.0, 0.25, 0.5, 1.0)).collect()}
    for k in {k for k, _ in rows}:
        assert np.allclose(got[k], np.quantile([v for a, v in rows if a == k], (0.0, 0.25, 0.5, 1.0)))
    whole = sorted(v for _, v in rows)
    ranks = [0, 7, 250, 499]
    assert order.ranked_values(df, {"v": F.col("v"), "none": F.lit(None)}, lambda n: ranks) == {"v": [whole[r] for r in ranks]}
    counts = order.sorted_counts(df, [], "v").collect()
    assert all(r.start == sum(v < r.v for v in whole) and r.n == whole.count(r.v) for r in counts)
    assert order.quantiles(df.limit(0), [], "v", (0.5,)).first().q == [None] and order.quantiles(df.limit(0), ["k"], "v", (0.5,)).count() == 0


def test_hot_species_meet_in_chunks(spark):
    comp = spark.createDataFrame([(s, k) for s in range(40) for k in range(s % 5 + 1)], "site long, species long")
    want = sorted(map(tuple, pairs.shared_species(comp).collect()))
    assert sorted(map(tuple, pairs.shared_species(comp, chunk=7).collect())) == want
    assert len(want) == 40 * 39 // 2 and all(n == min(i % 5, j % 5) + 1 for i, j, n in want)


def test_samplers_give_all_that_is_asked(spark):
    sites, _, _ = planted(spark, 12)
    never = lambda new: new.withColumn("p", F.when((F.col("i") == 0) | (F.col("j") == 0), 0.9).otherwise(1e-9))
    got = [tuple(r) for r in pairs.sample_pairs(sites, 20, never, 2).collect()]
    assert len(set(got)) == len(got) == 20 and sum(0 in p for p in got) == 11
    assert pairs.sample_random(sites, 66).count() == 66
    with pytest.warns(UserWarning):
        assert pairs.sample_random(sites, 100).distinct().count() == 66
    assert pairs.sample_random(sites.limit(1), 5).count() == 0


def plain_scores(rows, columns):
    """D2 of training and test rows, and errors, fitted by the local steps."""
    x, y, w, test = (np.array(v) for v in zip(*rows, strict=True))
    x = x[:, columns]
    one = np.ones((len(y), 1))
    beta, dev = model.fit_local(x[~test], y[~test], w[~test])
    null, base = model.fit_local(one[~test], y[~test], w[~test])[1], model.fit_local(one[test], y[test], w[test])[1]
    mu = np.clip(1 - np.exp(-(x[test] @ beta)), model.EDGE, 1 - model.EDGE)
    return (null - dev) / null * 100, (base - model.deviance_of(y[test], mu, w[test])) / base * 100, np.sqrt(np.mean((mu - y[test]) ** 2))


def test_candidates_fitted_side_by_side(spark):
    _, p, _ = planted(spark, 30)
    noisy = p.withColumn("distance", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("distance") + F.sin(F.col("i") * 7.0 + F.col("j")) / 20)))
    folds = noisy.withColumn("fold", F.explode(F.array(F.lit(3), F.lit(5)))).withColumn("is_test", (F.col("i") + F.col("j") + F.col("fold")) % 3 == 0)
    folds = folds.withColumn("s1_c", F.when(F.col("i") != 4, F.col("s1_c")))
    m = model.Model(["a", "b", "c"], [[0.0, 0.5, 1.0]] * 3, [])
    got = {(r.fold, r.candidate): r for r in select.score_candidates(folds, m, {"ab": [0, 1], "c": [2]}).collect()}
    x = folds.select("fold", "is_test", "distance", "weights", F.array(*model.design_columns(m)).alias("x")).collect()
    for fold in (3, 5):
        for name, at in (("ab", [0, *range(1, 7)]), ("c", [0, 7, 8, 9])):
            rows = [(r.x, r.distance, r.weights, r.is_test) for r in x if r.fold == fold and (name == "ab" or None not in r.x)]
            rows = [([v if v is not None else 0.0 for v in r[0]], *r[1:]) for r in rows]
            r = got[fold, name]
            assert np.allclose([r.train_d2, r.test_d2, r.rmse], plain_scores(rows, at), rtol=1e-6, atol=1e-9)


def test_single_model_build(spark):
    sites, _, _ = planted(spark, 40)
    env = {r.site: r.a for r in sites.collect()}
    comp = spark.createDataFrame([(s, k) for s, a in env.items() for k in range(40) if abs(k / 40 - a) < 0.35], "site long, species long")
    b = select.build_single(sites, comp, ["a", "c"], folds=2, n_pairs=200, geo=True)
    assert b.model.geo and b.model.predictors == ["a", "c"] and len(b.models) == 2
    assert len(b.tests) == len(b.random_tests) == 2 and b.tests.test_d2.mean() > 30
    assert np.allclose(b.model.intercept, np.mean([m.intercept for m in b.models]))
    assert len(b.observed) == 2 and b.observed["min"].between(0, 1).all() and b.observed.evenness.between(0, 1).all()


def test_screening_leaves_outliers_out(spark, monkeypatch):
    sites, _, _ = planted(spark, 40)
    wild = sites.withColumn("a", F.when(F.col("site") == 3, 1e6).otherwise(F.col("a")))
    env = {r.site: r.a for r in sites.collect()}
    comp = spark.createDataFrame([(s, k) for s, a in env.items() for k in range(40) if abs(k / 40 - a) < 0.35], "site long, species long")
    seen = []
    plain = select.screen
    monkeypatch.setattr(select, "screen", lambda table, m: seen.append((table.where("NOT is_test").agg(F.max("s1_a")).first()[0], m.knots[0][-1])) or plain(table, m))
    select.build(wild, comp, ["a", "c"], folds=2, n_pairs=200)
    assert seen[0][0] < 10 and seen[0][1] < 10


def test_empty_tables_and_odd_values(spark, tmp_path):
    sites, p, truth = planted(spark, 6)
    none = p.limit(0)
    with pytest.raises(ValueError):
        model.fit(none, ["a"], [truth.knots[0]])
    assert model.predict(none, truth).count() == 0 and pairs.sample_random(sites.limit(0), 5).count() == 0
    found = select.significance(none, truth, "a", 3)
    assert found["p"] == 0.0 or found["p"] != found["p"]
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 1.0]), (3, None)], "id long, v array<double>")
    assert cluster.classify(v, v.limit(0), 3)[0].count() == 0 and cluster.farthest_first(np.empty((0, 2))) == []
    assert cluster.assign(v, cluster.k_clusters(np.empty((0, 2)), 2)[1]).where("class IS NOT NULL").count() == 0
    classes, legend = cluster.classify(v, v, 5)
    assert sorted((r.id, r["class"]) for r in classes.collect()) == [(1, 0), (2, 1)] and len(legend) == 2
    cells = spark.createDataFrame([(0, 0, None, 1.0)], "row int, col int, a double, b double")
    assert grids.pca_rgb(cells, ["a", "b"]).count() == 0 and grids.density(cells, cells, ["a", "b"], 1.0).first().density is None
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "distance double, predicted double")
    assert assess.error_metrics(flat).first()["corr"] is None and assess.correlations(flat, ["distance", "predicted"]).first().r is None
    assert assess.six_numbers(flat.limit(0), "distance").first().median is None
    h = g.Header(3, 5, 0.0, 0.0, 1.0)
    odd = spark.createDataFrame([(0, 1, 2.5), (4, 2, float("nan")), (4, 0, None), (9, 9, 1.0), (-1, 0, 1.0), (3, 0, 7.0)], "row int, col int, value double")
    assert g.write_grid_parts(odd, h, str(tmp_path / "parts"), rows_per_part=2) == 3
    back = {(r.row, r.col): r.value for r in g.read_grid_parts(spark, str(tmp_path / "parts")).collect()}
    assert len(back) == 15 and {k: x for k, x in back.items() if x is not None} == {(0, 1): 2.5, (3, 0): 7.0}
    assert g.write_grid_parts(odd.limit(0), h, str(tmp_path / "parts")) == 1


def test_whole_build(spark):
    sites, _, _ = planted(spark, 40)
    rng = np.random.default_rng(5)
    env = {r.site: r.a for r in sites.collect()}
    comp = [(s, k) for s, a in env.items() for k in range(40) if abs(k / 40 - a) < 0.3 + 0.1 * rng.uniform()]
    b = select.build(sites, spark.createDataFrame(comp, "site long, species long"), ["a", "c"], folds=2, n_pairs=300)
    assert b.model.predictors[0] == "a" and len(b.models) == 2 and b.tests.test_d2.mean() > 30


def test_projection_round_trip_and_reprojection(spark):
    from betascape.functions import scalar as fn

    at = spark.createDataFrame([(115.0, -40.0), (132.0, 0.0), (153.5, -10.25)], "lon double, lat double")
    x, y = fn.albers(F.col("lon"), F.col("lat"))
    lon, lat = fn.albers_inverse(F.col("px"), F.col("py"))
    rows = at.withColumn("px", x).withColumn("py", y).withColumn("a", lon).withColumn("b", lat).collect()
    assert all(abs(r.a - r.lon) < 1e-7 and abs(r.b - r.lat) < 1e-6 for r in rows)
    assert abs(rows[1].px) < 1e-6 and abs(rows[1].py) < 1e-6
    h = g.Header(6, 4, 130.0, -30.0, 1.0)
    cells = grids.centroids(spark, h).withColumn("v", F.col("row") * 10.0 + F.col("col"))
    e = grids.projected_extent(spark, h)
    t = g.Header(5, 3, e[0], e[2], (e[1] - e[0]) / 5)
    out = grids.reproject(cells, h, t, ["v"])
    assert out.count() == 15 and out.where("v IS NOT NULL").count() > 5


def test_composites(spark):
    comp = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 9)], "site long, species long")
    sites = spark.createDataFrame([(k, float(k), 0.0) for k in (1, 2, 3)], "site long, xCoord double, yCoord double")
    rows = pairs.composite_table(comp, sites, 2, "sqrt").collect()
    assert [(r.i, r.j, r.distance, r.weights, r.s2_xCoord) for r in rows] == [(1, 2, 0.5, 2.0, 2.0)]
    assert pairs.reaggregate(comp, F.floor(F.col("site") / 2)).count() == 5


def test_colours_come_from_all_cells(spark):
    """Axes of a grid beyond 200,000 cells are those of all its cells."""
    n = 250_000
    cells = spark.range(n).select((F.col("id") / 500).cast("int").alias("row"), (F.col("id") % 500).cast("int").alias("col"), (F.col("id") % 97).cast("double").alias("a"), (F.col("id") * 31 % 89 + F.col("id") % 7).cast("double").alias("b"))
    x = np.array(cells.select("a", "b").toPandas())
    values, vectors = np.linalg.eigh(np.cov(x.T))
    top = vectors[:, np.argsort(-values)]
    top = top * np.where(top[np.abs(top).argmax(0), [0, 1]] < 0, -1, 1)
    want = (x - x.mean(0)) @ top
    want = (want - want.min(0)) / (want.max(0) - want.min(0)) * 255
    got = grids.pca_rgb(cells, ["a", "b"]).orderBy("row", "col").select("pc1", "pc2").toPandas()
    assert np.abs(np.array(got) - want).max() < 1e-6


def shuffled_pairs(df) -> bool:
    """Whether the plan has an exchange or a sorted join above the pairs, which come from Python."""
    above = df._jdf.queryExecution().sparkPlan().toString().split("MapInArrow")[0]
    return "Exchange" in above or "SortMergeJoin" in above or "ShuffledHashJoin" in above


@pytest.mark.parametrize("kind", ["long", "string"])
def test_all_pairs_by_blocks(spark, monkeypatch, kind):
    """Pairs of several blocks with shared counts, none of them shuffled, whatever the keys; null keys meet none."""
    rng = np.random.default_rng(4)
    names = [str(k) if kind == "string" else int(k) for k in (*range(95, 130), -3, 7)]
    comp = {n: {f"s{k}" for k in rng.integers(0, 40, rng.integers(1, 12))} for n in names}
    rows = [(n, s) for n, found in comp.items() for s in found] + [(None, "s1"), (names[0], None)]
    frame = spark.createDataFrame(rows, f"site {kind}, species string")
    monkeypatch.setattr(pairs, "SITES", 8)
    monkeypatch.setattr(pairs, "PAIRS", 16)
    got = pairs.all_pair_sorensen(frame)
    assert not shuffled_pairs(got)
    r = {n: len(s) + (n == names[0]) for n, s in comp.items()}
    want = {(a, b, r[a], r[b], len(comp[a] & comp[b])) for a in names for b in names if a < b}
    found = [tuple(x)[:5] for x in got.collect()]
    assert len(found) == len(want) and set(found) == want
    sites = spark.createDataFrame([(n, float(k), 0.0) for k, n in enumerate(names[:-1])], f"site {kind}, xCoord double, yCoord double")
    table = pairs.composite_table(frame, sites)
    assert not shuffled_pairs(table)
    x = {n: float(k) for k, n in enumerate(names[:-1])}
    assert {(t.i, t.j, t.s1_xCoord, t.s2_xCoord) for t in table.collect()} == {(a, b, x.get(a), x.get(b)) for a, b, *_ in want}


def test_pair_queries_shuffle_no_pairs(spark):
    from betascape.plans.registry import QUERIES

    for name in ("pair_sorensen", "pair_sorensen_arrays", "composite_pair_table", "pair_env_attach", "pair_weights_sum_sqrt", "design_matrix", "predict_geo_model", "pair_grid_extract"):
        assert not shuffled_pairs(QUERIES[name](spark, "/root/testdata/sf0.001")), name


def test_pairs_are_counted_where_they_meet(spark, monkeypatch):
    """Counts of distances say what the pairs say, and no pair leaves the task."""
    monkeypatch.setattr(pairs, "SITES", 8)
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame([(int(a), int(b)) for a, b in {tuple(x) for x in rng.integers(0, 40, (500, 2)).tolist()}], "site long, species long")
    counts = pairs.sorensen_counts(frame)
    every = pairs.all_pair_sorensen(frame)
    want = every.groupBy("distance").count().collect()
    assert {(r[0], r[1]) for r in counts.groupBy("distance").agg(F.sum("n")).collect()} == {(r[0], r[1]) for r in want}
    assert counts.count() < every.count() / 4
    a, b = assess.histogram(counts, "distance", times="n"), assess.histogram(every, "distance")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    y = F.col("distance").alias("y")
    assert model.null_deviance(counts.select(y, F.col("n").cast("double").alias("w"))) == pytest.approx(model.null_deviance(every.select(y, F.lit(1.0).alias("w"))))


def test_fits_hold_rows_in_memory_only(spark, monkeypatch):
    """Rows that do not fit into memory are worked out again; all pairs of many sites would fill the disks."""
    rng = np.random.default_rng(6)
    rows = [(k, *(float(v) for v in rng.random(3)), 1.0) for k in range(60)]
    frame = spark.createDataFrame(rows, "k int, distance double, s1_a double, s2_a double, weights double")
    held, kept = [], type(frame).persist
    monkeypatch.setattr(type(frame), "persist", lambda self, *level: held.append((level, {f.name for f in self.schema})) or kept(self, *level))
    model.fit(frame, ["a"])
    select.cross_validate(frame.where("k % 3 > 0"), frame.where("k % 3 = 0"), ["a"])
    levels = [level for level, names in held if names & {"x", "predicted"}]
    assert levels and all(level and not level[0].useDisk for level in levels)


def test_counts_of_windows_hold_no_sketches(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 0)], "site long, species long, s long").select("site", "species", F.timestamp_seconds("s").alias("t"))
    rows.write.parquet(str(tmp_path / "rows"))
    events = ingest.stream(spark, str(tmp_path / "rows"), rows.schema)
    assert ingest.windowed_counts(events, "t", ["site"]).columns == ["window", "site", "n_records", "richness"]
    assert ingest.windowed_counts(events, "t", ["site"], richness=False).columns == ["window", "site", "n_records"]
