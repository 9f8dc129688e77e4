"""SimHash components and links against brute force."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from betascape.llm import components, simhash_dedup


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_against_brute_force(documents, odd):
    docs = documents.select("doc_id", "text").union(odd.select(F.col("doc_id") + 1000, "text"))
    rows = docs.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    groups: dict = {}
    roots = plain_components(fps)
    for r, k in zip(rows, roots, strict=True):
        groups.setdefault(k, []).append(r.doc_id)
    least = {k: min([x for x in v if x is not None], default=None) for k, v in groups.items()}
    want = sorted(((r.doc_id, f"{f:016x}", least[k]) for r, f, k in zip(rows, fps, roots, strict=True)), key=str)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(docs).collect()), key=str)
    assert got == want


def test_links_lose_none(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = {int(x) for x in base}
    for x in base.tolist():
        for _ in range(12):
            for b in rng.choice(64, rng.integers(1, 7), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (x >> 63 << 64) for x in fps]
    for chunk in (2048, 3):
        edges = simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), chunk=chunk)
        root = {r.node: r.root for r in components.components(edges).collect()}
        got = [root.get(x, x) for x in signed]
        want = plain_components(fps)
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (500, 400), (400, 500), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {200 + i: 100 for i in range(50)} | {500: 400}


def test_empty(spark):
    assert simhash_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
