"""SimHash near-duplicates by pivot distance tables.

Fingerprints of 4-word shingles link at 4 or fewer differing bits.  Distinct fingerprints only are
compared.  Hamming distance to a fixed pivot changes by at most the distance of two fingerprints,
so a pair whose distances to any pivot differ by more than the threshold is discarded unseen, and
what survives all pivots is verified bit by bit.  Over 64 near-random bits all distances to a
pivot lie close to 32, so pivots alone would leave a fixed share of all pairs; therefore a pair is
looked at only where it agrees on enough of ``blocks`` bit blocks, which every linked pair does
(with 4 differing bits at least blocks - 4 of them agree), and the tables filter within.

Groups over ``chunk`` fingerprints are split into chunks, and each pair of chunks is a task's group of
its own: memory is bounded, and no group is met by one task.  Of each group a spanning forest
leaves, never all pairs.

Cases: a null or empty text has fingerprint zero; repeated rows each get a row; an empty table
gives an empty result; other columns are ignored; a null id gets a row, but gives no component
its name (a component of null ids alone has a null name).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from betascape.llm.common import batches, cut, ready, text_bytes
from betascape.llm.components import components


def fingerprint(text: bytes, width: int = 4) -> int:
    """64-bit SimHash of the word shingles of a text (UTF-8); A-Z count as lower case."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.uint32)
    return sum(1 << int(i) for i in np.flatnonzero(2 * total > n))


def digest_of(text_col: str = "text") -> Column:
    """What tells rows of one id apart: a hash of the text; null is empty."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, digest: bool = False) -> DataFrame:
    """(doc_id, fp), and digest on demand: fp is the fingerprint as a signed long."""
    more = ["digest"] if digest else []

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, *digests in batches(rows, "doc_id", "text", *more):
            fps = np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps), *map(pa.array, digests)], ["doc_id", "fp", *more])

    ready(docs.sparkSession)
    cols = [F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"), *[digest_of(text_col).alias(c) for c in more]]
    return docs.select(*cols).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *more)))


def pivots(n: int) -> np.ndarray:
    """Reference fingerprints: the same random ones at every run."""
    return np.random.default_rng(64).integers(0, 2**64, n, dtype=np.uint64)


def masks(blocks: int, bits: int) -> list[int]:
    """Bit masks such that fingerprints with at most ``bits`` differing bits agree on one of them."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(part, blocks - bits)]


def linked(fp: np.ndarray, end: np.ndarray, bits: int, references: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of places at most ``bits`` apart; place i may pair with those up to end[i]."""
    tables = [np.bitwise_count(fp ^ p).astype(np.int8) for p in references]
    at, d = np.arange(len(fp)), 1
    while len(at := at[at + d < end[at]]):
        i = at
        for t in tables:
            i = i[np.abs(t[i] - t[i + d]) <= bits]
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= bits]
        if len(i):
            yield i, i + d
        d += 1


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least place that each of n places is linked with, over any number of links."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(root, np.maximum(a, b), low)
            while ((up := root[root]) != root).any():
                root = up
    return root


def links(fps: DataFrame, bits: int = 4, blocks: int = 6, n_pivots: int = 8, chunk: int = 2048) -> DataFrame:
    """Edges (u, v) between distinct fingerprints whose components are those of all linked pairs."""
    keys = [F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(m - (m >> 63 << 64))).alias("k")) for t, m in enumerate(masks(blocks, bits))]
    cells = fps.select("fp", F.inline(F.array(*keys)))
    size = cells.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    n = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.col("c")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("c") - 1))
    # With c chunks each fingerprint goes to the c pairs of chunks that its own is in.
    dealt = cells.join(size, ["t", "k"]).withColumn("c", n).withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("t", "k", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")
    references = pivots(n_pivots)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 5
        for batch in rows:
            cols = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, h in enumerate(held)]
            new = np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)
            last = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            held = [c[last:] for c in cols]
            yield from edges([c[:last] for c in cols], new[: max(0, last - 1)])
        new = np.any([c[1:] != c[:-1] for c in held[:4]], axis=0)
        yield from edges(held, new)

    def edges(cols: list[np.ndarray], new: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp = cols[4].view(np.uint64)
        if len(fp) < 2:
            return
        stops = np.append(np.flatnonzero(new) + 1, len(fp))
        end = np.repeat(stops, np.diff(stops, prepend=0))
        root = forest(len(fp), linked(fp, end, bits, references))
        on = np.flatnonzero(root != np.arange(len(fp)))
        if len(on):
            yield pa.RecordBatch.from_arrays([pa.array(cols[4][on]), pa.array(cols[4][root[on]])], ["u", "v"])

    return dealt.repartition("t", "k", "p", "q").sortWithinPartitions("t", "k", "p", "q").mapInArrow(run, "u long, v long")


def joined(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): components of the nodes (none, doc_id, digest, fp) of ``fps``, named by their least node.

    Joins are between checkpoints, so that a fingerprint with very many links can be split.
    """
    edges = cut(edges)
    for end in "uv":
        edges = cut(edges.join(fps.select(F.col("fp").alias(end), F.col("node").alias(f"n{end}")), end))
    return components(edges, "nu", "nv")


def representatives(docs: DataFrame, bits: int = 4, blocks: int = 6, n_pivots: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): the least row of each component by doc_id, nulls last, and then by the text's digest."""
    rows = fingerprints(docs, id_col, text_col, digest=True)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("least")
    fps = cut(rows.groupBy("fp").agg(least).select("fp", F.struct("least.*", "fp").alias("node")))
    others = joined(fps, links(fps.select("fp"), bits, blocks, n_pivots)).select(F.col("node.fp").alias("fp"))
    return fps.join(others, "fp", "left_anti").select("node.doc_id", "node.digest")


def near_duplicates(docs: DataFrame, bits: int = 4, blocks: int = 6, n_pivots: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id of those
    reachable over links) and n_exact (documents with the same fingerprint)."""
    rows = cut(fingerprints(docs, id_col, text_col))
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_exact"))
    fps = cut(fps.select("fp", "n_exact", F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("doc_id"), "fp").alias("node")))
    found = joined(fps, links(fps.select("fp"), bits, blocks, n_pivots)).select(F.col("node.fp").alias("fp"), "root")
    # As a checkpoint, so that the rows of a very frequent fingerprint can be split.
    named = cut(fps.join(found, "fp", "left").select("fp", F.coalesce("root", "node").getField("doc_id").alias("component_id"), "n_exact"))
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_exact")
