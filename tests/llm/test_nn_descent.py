"""Recall against brute force, and the cases that take no part."""

import numpy as np
from pyspark.sql import functions as F

from betascape.llm import nn_descent as nd


def test_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = nd.brute_force(ids, x, np.flatnonzero(ids % 100 == 0))
    got: dict = {}
    for r in nd.nearest(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got.keys() == want.keys() and all(len(v) == 10 and v == sorted(v) for v in got.values())
    hits = [len({i for _, i in got[q]} & {i for _, i in w}) for q, w in want.items()]
    assert np.mean(hits) >= 9
    at = {i: k for k, i in enumerate(ids.tolist())}
    assert all(np.isclose(s, np.sqrt(((x[at[q]] - x[at[i]]) ** 2).sum()), rtol=1e-12) for q, v in got.items() for s, i in v)


def test_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 8)).round(3)
    rows = [(i, x[i].tolist(), "a") for i in range(60)]
    rows += [(i, x[7].tolist(), "a") for i in range(100, 140)]  # copies
    rows += [(5, x[5].tolist(), "a"), (200, None, "a"), (300, [0.0] * 8, "a"), (400, [None] + [1.0] * 7, "a"), (500, [float("nan")] * 8, "a"), (600, [], "a"), (700, [1.0, 2.0], "a"), (None, x[0].tolist(), "a")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    used = [(i, v) for i, v, _ in dict.fromkeys((i, tuple(v), s) for i, v, s in rows[:100])]
    ids, y = np.array([i for i, _ in used]), np.array([v for _, v in used])
    want = nd.brute_force(ids, y, np.flatnonzero(ids % 10 == 0))
    got: dict = {}
    for r in nd.nearest(table, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((round(r.score, 9), r.vec_id))
    assert got == {q: [(round(d, 9), i) for d, i in w] for q, w in want.items()}
    assert nd.nearest(table.limit(0), F.lit(True)).count() == 0
    few = nd.nearest(table.where("vec_id < 3"), F.lit(True))
    assert few.count() == 6 and few.agg(F.max("rank")).first()[0] == 2
