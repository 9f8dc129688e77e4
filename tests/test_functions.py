"""Hand-checked values and properties of the scalar formulas."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from betascape.functions import scalar as fn
from betascape.operators import cluster, grids, model, pairs
from betascape.sources import grid as g


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_hand_checked(spark):
    lit = F.lit
    r = one(
        spark, a=fn.ispline(lit(0.5), 0, 0, 1), b=fn.ispline(lit(0.5), 0, 1, 1), c=fn.ispline(lit(0.25), 0, 0.5, 1), none=fn.ispline(lit(None).cast("double"), 0, 0.5, 1),
        d0=fn.decay(0.0, 0.05, 2.0, 3), d1=fn.decay(2.0, 0.05, 2.0, 3), s=fn.sorensen(lit(1), lit(2), lit(2)), e=fn.sorensen(lit(0), lit(0), lit(0)),
        bc=fn.bray_curtis(lit(4.0), lit(10.0), 0.0), dev=fn.deviance_unit(lit(1.0), lit(0.5)) * 2, same=fn.deviance_unit(lit(0.3), lit(0.3)),
        p=fn.inverse_link(lit(math.log(2))), snap=fn_snap(), sp=fn.clean_species(lit("Acacia dealbata subsp. x")), sp2=fn.clean_species(lit("Acacia dealbata Link")),
        sp3=fn.clean_species(lit("Acacia Link")), path=fn.folder(lit("a/b")), m=fn.manhattan(F.array(lit(1.0), lit(2.0)), F.array(lit(3.0), lit(0.0))),
    )
    assert (r.a, r.b, r.c, r.none) == (0.75, 0.25, 0.125, None)
    assert r.d0 == 1 and r.d1 == pytest.approx(0.525) and r.s == 0.5 and r.e is None and r.bc == pytest.approx(0.2)
    assert r.dev == pytest.approx(2 * math.log(2)) and r.same == pytest.approx(0) and r.p == pytest.approx(0.5) and r.snap == pytest.approx(1.25)
    assert (r.sp, r.sp2, r.sp3, r.path, r.m) == (None, "Acacia dealbata", None, "a/b/", 4.0)


def fn_snap():
    from betascape.operators.prepare import snap

    return snap(F.lit(1.3), 0, 0.5)


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.lists(st.floats(-100, 100), min_size=3, max_size=5, unique=True), st.floats(-150, 150), st.floats(0, 20))
def test_splines_rise_from_0_to_1(knots, v, step):
    for q in fn.spline_knots(sorted(knots)):
        a, b = fn.ispline_value(v, *q), fn.ispline_value(v + step, *q)
        assert 0 <= a <= b + 1e-12 <= 1 + 1e-11


def test_knots():
    assert [model.order_rank(11, 3, i) for i in range(3)] == [0, 5, 10]
    assert [model.percentile_rank(10, p) for p in (0, 50, 100)] == [0, 5, 9]


@settings(max_examples=40, deadline=None, derandomize=True)
@given(st.integers(0, 10_000))
def test_nnls_meets_its_conditions(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(40, 6)), rng.normal(size=40)
    gram, right = x.T @ x, x.T @ y
    b = model.nnls(gram, right)
    slope = right - gram @ b
    assert (b >= 0).all() and (slope <= 1e-6).all() and (np.abs(slope[b > 1e-9]) < 1e-6).all()


def test_extrapolation_lines_meet_the_curve():
    ks, cs = [0.0, 2.0, 10.0], [0.3, 0.5, 0.4]
    for m in grids.METHODS:
        (m0, c0), (m1, c1) = grids.lines(ks, cs, m)
        assert c0 + ks[0] * m0 == pytest.approx(0) and c1 + ks[-1] * m1 == pytest.approx(1.2) and m0 >= 0 and m1 >= 0
    assert grids.lines(ks, cs, "no such") == grids.lines(ks, cs, "Conservative")
    assert grids.lines(ks, cs, "End10", "documented") != grids.lines(ks, cs, "End10")


def test_default_pair_counts():
    assert pairs.default_pair_counts(100, 20) == (495, 99)


def test_run_codec():
    for values in ([None, None, 3.0, 4.0, None], [], [1.0], [None] * 5):
        assert g.decode_runs(g.encode_runs(values)) == values
        assert g.decode_runs(g.encode_runs(values, 2), 2) == values
    assert np.frombuffer(g.encode_runs([None, None, 3.0, 4.0, None])[:4], "<i2").tolist() == [-2, 2]


def test_headers():
    h = g.Header(3, 2, -1.5, 0.25, 0.5, -9999.0)
    assert g.parse_header(g.format_header(h)) == h and g.parse_stack_header(g.format_stack_header(h, ["a", "b"])) == (h, ["a", "b"])
    with pytest.raises(ValueError):
        g.parse_header("ncols 3")


def test_clusters():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (10, 3)) for c in (0, 5, 9)])
    for method in ("single", "maximum", "average", "centroid"):
        assert cluster.cut_tree(cluster.linkage(cluster.distance_matrix(x), method, x), 3).tolist() == [0] * 10 + [1] * 10 + [2] * 10
    for centre in ("mean", "median", "medoid"):
        classes, _ = cluster.k_clusters(x, 3, centre)
        assert len({(a, b) for a, b in zip(classes.tolist(), [0] * 10 + [1] * 10 + [2] * 10, strict=True)}) == 3
    assert len(cluster.farthest_first(x, 4.0)) == 3
    d = cluster.distance_matrix(x, "euclidean") ** 0.5 * 3**0.5
    p = cluster.pco(d, 3)
    assert np.allclose(np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)), d, atol=1e-6)
    for metric in ("pearson", "spearman", "kendall", "uncentered", "abs_pearson", "abs_uncentered"):
        m = cluster.distance_matrix(x, metric)
        assert np.allclose(m, m.T) and np.allclose(np.diag(m), 0, atol=1e-9)
    cells, w = cluster.self_organising_map(x, (2, 2), 300)
    assert cells.shape == (30, 2) and w.shape == (2, 2, 3)
    assert cluster.cluster_distance(x, range(10), range(10, 20), "least") <= cluster.cluster_distance(x, range(10), range(10, 20), "largest")
