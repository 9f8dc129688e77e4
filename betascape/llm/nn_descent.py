"""Approximate nearest neighbours: an NN-descent graph and greedy search over it.

Equal vectors are one node, so copies cost nothing.  Each node starts with the nearest of a few random
nodes.  Then, round by round, the neighbours of each node (and those that it is a neighbour of) meet in a
Spark join: within such a meeting every member learns its nearest fellows, but of pairs only those with a neighbour that
is new to the node, as all others met there before; each node keeps the nearest it has heard of.  Rounds
end when the share of new neighbours falls.

A query starts at its own node and walks the graph: in each step the nearest nodes that it has not
expanded send their neighbours; it ends when all of the nearest ``pool`` nodes are expanded.  Graph and
walk use small copies of the vectors (see ``halves``); the pool is then measured on the original ones.  The graph's degree
and the pool are parameters of the approximation; recall is measured in the tests.

Cases: vectors that are null, empty, zero or hold null or non-finite components, or whose id is
null, take no part; vectors of different lengths are never near each other; a row repeated in full counts
once; several vectors of one id are so many candidates, and queries, of that id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from betascape.llm.common import cut, ready

NONE = np.inf

#: Numbers are moved about as single precision where the column holds no more; measured in double.
KINDS = {"<f4": "float", "<f8": "double"}


def matrix(column: pa.Array, dtype: str) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1)


def clean(vectors: DataFrame, id_col: str, vec_col: str, kind: str) -> DataFrame:
    """(vec_id, v): usable rows, each once; v are the components as little-endian numbers."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if v and None not in v:
                    x = np.array(v, kind) + np.zeros(1, kind)
                    if np.isfinite(x).all() and x.any():
                        ids.append(i)
                        out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "v"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{KINDS[kind]}>").alias("v")).where("vec_id IS NOT NULL")
    return rows.mapInArrow(run, "vec_id long, v binary").distinct()


def grouped(rows: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that come sorted by a column of longs."""
    held: list[pa.RecordBatch] = []
    for batch in rows:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        starts = np.flatnonzero(np.append(False, keys[1:] != keys[:-1]))
        if len(starts):
            last = int(starts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def bounds(keys: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))


def distances(x: np.ndarray) -> np.ndarray:
    """Squared distances of rows to each other; infinite on the diagonal."""
    x = x.astype(np.float32)
    s = np.einsum("ij,ij->i", x, x)
    d = s[:, None] + s[None] - 2 * (x @ x.T)
    np.fill_diagonal(d, NONE)
    return np.maximum(d, 0)


def meet(rows: DataFrame, keep: int, kind: str) -> DataFrame:
    """(node, near, dist): for each member of each group (g, node, new, w) its nearest ``keep`` fellows, of those
    pairs where one is new.  Members of a group have vectors of one length."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(it):
            keys, nodes, new = (t.column(i).to_numpy() for i in range(3))
            raw = t.column(3).to_pylist()
            at = bounds(keys)
            out: list[list] = [[], [], []]
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                for a in range(lo, hi, 1024):  # blocks, should a group be large
                    b = min(hi, a + 1024)
                    if b - a < 2:
                        continue
                    d = distances(np.frombuffer(b"".join(raw[a:b]), kind).reshape(b - a, -1))
                    if not (on := new[a:b].astype(bool)).all():
                        d[np.ix_(~on, ~on)] = NONE
                    k = min(keep, b - a - 1)
                    near = np.argpartition(d, k - 1, 1)[:, :k]
                    out[0].append(np.repeat(nodes[a:b], k))
                    out[1].append(nodes[a:b][near].ravel())
                    out[2].append(np.take_along_axis(d, near, 1).ravel())
            if out[0]:
                cols = [np.concatenate(x) for x in out]
                fit = np.lexsort((cols[2], cols[0]))
                n, m, d = (c[fit] for c in cols)
                on = (n != m) & np.isfinite(d)
                # One row a node and batch: its lists of fellows and distances.
                n, m, d = n[on], m[on], d[on].astype(np.float32)
                if len(n):
                    ends = bounds(n)
                    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (m, d)]
                    yield pa.RecordBatch.from_arrays([pa.array(n[ends[:-1]]), *lists], ["node", "near", "dist"])

    return rows.repartition("g").sortWithinPartitions("g", "node").mapInArrow(run, "node long, near array<long>, dist array<float>")


def keep_nearest(rows: DataFrame, degree: int) -> DataFrame:
    """(node, near, dist, fresh): lists of one node merged into its nearest ``degree``; ``fresh`` tells
    which were not in the row flagged ``old``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(it):
            keys = t.column(0).to_numpy()
            near, dist = (t.column(i).combine_chunks() for i in (1, 2))
            old = np.repeat(t.column(3).to_numpy(), np.diff(near.offsets.to_numpy()))
            off = near.offsets.to_numpy() - near.offsets.to_numpy()[0]
            m, d = near.flatten().to_numpy(), dist.flatten().to_numpy()
            n = np.repeat(keys, np.diff(off))
            order = np.lexsort((~old, m, d, n))  # of equal entries the old one comes first
            n, m, d, old = n[order], m[order], d[order], old[order]
            # The same fellow may be measured at distances that differ in the last bits.
            by = np.lexsort((d, m, n))
            first = np.zeros(len(n), bool)
            first[by] = np.append(True, (n[by][1:] != n[by][:-1]) | (m[by][1:] != m[by][:-1]))
            known = np.zeros(len(n), bool)
            group = np.cumsum(first[by]) - 1
            known[by] = np.bincount(group, old[by], group[-1] + 1)[group] > 0 if len(by) else []
            n, m, d, known = n[first], m[first], d[first], known[first]
            at = bounds(n)
            place = np.arange(len(n)) - np.repeat(at[:-1], np.diff(at))
            on = place < degree
            n, m, d, known = n[on], m[on], d[on], known[on]
            at = bounds(n)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (m, d, ~known)]
            yield pa.RecordBatch.from_arrays([pa.array(n[at[:-1]]), *lists], ["node", "near", "dist", "fresh"])

    rows = rows.select("node", "near", "dist", "old").repartition("node").sortWithinPartitions("node")
    return rows.mapInArrow(run, "node long, near array<long>, dist array<float>, fresh array<boolean>")


def build_graph(half: DataFrame, kind: str, degree: int = 40, rounds: int = 30, guests: int = 6, told: int = 10, start: int = 32, deals: int = 4, least_change: float = 0.6) -> DataFrame:
    """(node, near): for nodes (node, w) the neighbours along graph edges, of both directions.

    A node invites its new neighbours and some old ones, and as many of those that it is a neighbour of
    (``guests`` of each of these kinds, but all new neighbours), chosen by a hash that changes each round.  Rounds end when
    no more than ``least_change`` of the neighbours are new: the search makes up for what further rounds would find, at less cost.
    """
    sizes = half.groupBy(F.length("w").alias("bytes")).agg(F.greatest(F.lit(1), F.floor(F.count("*") / start)).alias("groups"), F.count("*").alias("n"))
    n = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    # Several dealings into random groups: within one alone no path would leave a group.
    deal = F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("t")
    dealt = half.join(sizes, F.length("w") == F.col("bytes")).select("node", "w", "bytes", "groups", deal)
    dealt = dealt.select(F.xxhash64("bytes", "t", F.pmod(F.xxhash64("node", "t"), F.col("groups"))).alias("g"), "node", F.lit(True).alias("new"), "w")
    graph = cut(keep_nearest(meet(dealt, degree, kind).withColumn("old", F.lit(False)), degree))
    for k in range(rounds):
        edges = graph.select("node", F.explode(F.arrays_zip("near", "fresh")).alias("x")).select("node", "x.near", "x.fresh")
        turn = F.xxhash64("node", "near", F.lit(k))
        out = edges.withColumn("r", F.row_number().over(Window.partitionBy("node", "fresh").orderBy(turn, "near"))).where((F.col("r") <= guests) | F.col("fresh"))
        back = edges.withColumn("r", F.row_number().over(Window.partitionBy("near", "fresh").orderBy(turn, "node"))).where(F.col("r") <= guests)
        asked = out.select(F.col("node").alias("g"), F.col("near").alias("node"), "fresh").union(back.select(F.col("near").alias("g"), "node", "fresh"))
        asked = asked.union(graph.select(F.col("node").alias("g"), "node", F.lit(False).alias("fresh"))).groupBy("g", "node").agg(F.max("fresh").alias("new"))
        # Where nobody is new nobody need meet.
        met = asked.groupBy("g").agg(F.collect_list(F.struct("node", "new")).alias("x")).where(F.exists("x", lambda x: x["new"])).select("g", F.inline("x"))
        heard = meet(met.join(half, "node").select("g", "node", "new", "w"), told, kind).withColumn("old", F.lit(False))
        graph = cut(keep_nearest(graph.select("node", "near", "dist").withColumn("old", F.lit(True)).union(heard), degree))
        fresh = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))).alias("n")).first()["n"] or 0
        if fresh <= least_change * n * degree:
            break
    edges = graph.select("node", F.explode(F.arrays_zip("near", "dist")).alias("x")).select("node", "x.near", F.col("x.dist").alias("d"))
    back = edges.withColumn("r", F.row_number().over(Window.partitionBy("near").orderBy("d", "node"))).where(F.col("r") <= 2 * degree)
    both = edges.select("node", "near").union(back.select(F.col("near").alias("node"), F.col("node").alias("near")))
    return cut(both.groupBy("node").agg(F.array_sort(F.collect_set("near")).alias("near")))


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, kind: str, pool: int = 200, step: int = 64) -> DataFrame:
    """(q, near): for query nodes (q, w) the nearest ``pool`` nodes that greedy search meets, nearest first; ``nodes`` has the
    same small copies (node, w).

    A state is one row a query: the nodes met so far that count, their distances, and which of them
    are expanded.  Rows of nodes that a step has reached come after it under the same key.
    """
    state_schema = "q long, w binary, near array<long>, dist array<double>, done array<boolean>"

    def advance(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(it):
            keys = t.column(0).to_numpy()
            at = bounds(keys)
            vs, nears, dists, dones = (t.column(i).combine_chunks() for i in (1, 2, 3, 4))
            met, mets = t.column(5).to_pylist(), t.column(6).combine_chunks()
            out: list[list] = [[], [], [], [], []]
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                q = np.frombuffer(vs[lo].as_py(), kind).astype(float)
                near, dist, done = (x[lo].as_py() for x in (nears, dists, dones))
                known = set(near)
                # What ``expand`` asked for in this step is expanded now.
                asked = [i for i, d in enumerate(done) if not d][:step]
                for i in asked:
                    done[i] = True
                fresh = [k for k in range(lo + 1, hi) if met[k] not in known]
                if fresh:
                    x = np.frombuffer(b"".join(mets[k].as_py() for k in fresh), kind).reshape(len(fresh), -1).astype(float)
                    d = ((x - q) ** 2).sum(1).tolist()
                    rows = sorted([*zip(dist, near, done, strict=True), *((a, met[k], False) for a, k in zip(d, fresh, strict=True))])[:pool]
                    dist, near, done = map(list, zip(*rows, strict=True))
                for o, x in zip(out, (int(keys[lo]), vs[lo].as_py(), near, dist, done), strict=True):
                    o.append(x)
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], ["q", "w", "near", "dist", "done"])

    begin = queries.select("q", "w", F.array("q").alias("near"), F.array(F.lit(0.0)).alias("dist"), F.array(F.lit(False)).alias("done"))
    state = cut(begin)
    while True:
        asked = F.slice(F.filter("near", lambda x, i: ~F.get(F.col("done"), i)), 1, step)
        wanted = state.select("q", F.explode(asked).alias("node"))
        if wanted.isEmpty():
            return state.select("q", "near")
        reached = wanted.join(graph, "node").select("q", F.explode("near").alias("node")).distinct()
        # A node dropped from the pool may be met again; it is farther than all of the pool then, or back in it.
        reached = reached.join(nodes, "node").select("q", F.lit(None).cast("binary").alias("w"), F.col("node").alias("met"), F.col("w").alias("v"))
        empty = [F.lit(None).cast(t).alias(n) for n, t in (("near", "array<long>"), ("dist", "array<double>"), ("done", "array<boolean>"))]
        rows = state.select("*", F.lit(None).cast("long").alias("met"), F.lit(None).cast("binary").alias("v")).union(reached.select("q", "w", *empty, "met", "v"))
        rows = rows.repartition("q").sortWithinPartitions("q", F.asc_nulls_first("met"))
        state = cut(rows.mapInArrow(advance, state_schema))


def measured(found: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """(q, node, score): the distances of nodes (q, near) to their query on the original vectors (node, v)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(it):
            keys, met = t.column(0).to_numpy(), t.column(1).to_numpy()
            raw, at = t.column(2).to_pylist(), bounds(keys)
            score = np.empty(len(keys))
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                x = np.frombuffer(b"".join(raw[lo:hi]), kind).reshape(hi - lo, -1).astype(float)
                own = int(np.flatnonzero(met[lo:hi] == keys[lo])[0])  # a query is the first of its own pool
                score[lo:hi] = np.sqrt(((x - x[own]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(met), pa.array(score)], ["q", "node", "score"])

    rows = found.select("q", F.explode("near").alias("node")).join(nodes, "node").select("q", "node", "v")
    return rows.repartition("q").sortWithinPartitions("q").mapInArrow(run, "q long, node long, score double")


def named_nodes(rows: DataFrame) -> DataFrame:
    """(node, v) for rows (vec_id, v): a number for each vector, its hash; of several vectors with one hash the later ones,
    in their order, get another."""
    one = rows.select("v").distinct().withColumn("h", F.xxhash64("v"))
    r = F.row_number().over(Window.partitionBy("h").orderBy("v"))
    return one.withColumn("r", r).select(F.when(F.col("r") == 1, F.col("h")).otherwise(F.xxhash64("v", "r")).alias("node"), "v")


def halves(nodes: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """(node, w) and the kind of numbers in w: smaller copies of the vectors, for the graph and the walk.

    Numbers of 8 bits span the components of all vectors if these are of about one size; else they are divided by the
    median size and held in half precision, or in single precision where some are far longer or shorter.
    """

    def sizes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            raw = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([float(np.abs(np.frombuffer(r, kind).astype(float)).max()) for r in raw], pa.float64())], ["size"])

    found = nodes.select("v").mapInArrow(sizes, "size double").agg(F.min("size").alias("a"), F.percentile_approx("size", 0.5).alias("m"), F.max("size").alias("b")).first()
    middle = found["m"] or 1.0
    alike = lambda times: found["m"] and found["b"] < times * middle and found["a"] * times > middle
    small, scale, top = ("i1", found["b"] / 127, 127) if alike(4) else ("<f2", middle, 3e4) if alike(100) else ("<f4", middle, 1e15)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = [np.clip(np.frombuffer(r, kind).astype(float) / scale, -top, top) for r in b.column(1).to_pylist()]
            x = [(np.round(v) if small == "i1" else v).astype(small).tobytes() for v in x]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], ["node", "w"])

    return cut(nodes.select("node", "v").mapInArrow(run, "node long, w binary")), small


def nearest(vectors: DataFrame, is_query, k: int = 10, degree: int = 40, pool: int = 200, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest rows found for each row
    whose vec_id meets ``is_query`` (a Column over vec_id); ties go to the smaller vec_id."""
    ready(vectors.sparkSession)
    kind = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = cut(clean(vectors, id_col, vec_col, kind))
    nodes = cut(named_nodes(rows))
    small, small_kind = halves(nodes, kind)
    graph = build_graph(small, small_kind, degree)
    named = rows.join(nodes, "v").select("vec_id", "node")
    asking = named.where(is_query).distinct()
    queries = asking.select(F.col("node").alias("q")).distinct().join(small.withColumnRenamed("node", "q"), "q")
    found = measured(search(queries, small, graph, small_kind, max(pool, 4 * k)), nodes, kind)
    # Of each node the k + 1 least ids are enough for any query, one of them may be its own.
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    members = first.groupBy("node").agg(F.collect_list("vec_id").alias("ids"))
    pairs = found.join(members, "node").select("q", F.explode("ids").alias("vec_id"), "score")
    best = pairs.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k + 1).alias("best"))
    asked = asking.select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")).join(best, "q")
    mine = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asked.select("query_id", F.posexplode(mine).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def brute_force(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, k: int = 10) -> dict[int, list[tuple[float, int]]]:
    """The exact answer, for measuring recall."""
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = NONE
        near = np.lexsort((ids, d))[:k]
        out[int(ids[q])] = [(float(d[i]), int(ids[i])) for i in near if np.isfinite(d[i])]
    return out
