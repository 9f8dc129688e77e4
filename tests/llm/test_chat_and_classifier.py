"""Perspectives against a plain version; held-out accuracy and the linear-time identity."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from betascape.llm import chat_perspectives as chat
from betascape.llm import factorisation_quality as fq

ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|> é😀"), (1, 2, "bob", None), (1, 2, "ann", "again"), (1, 2, "ann", "again"),
    (1, 70, "bob", "late"), (2, 0, "system", "alone"), (3, 5, None, "who"), (None, 0, "ann", "no id"), (4, None, "ann", "x"), (4, None, "bob", ""),
]


def plain(rows, part_turns=None):
    turns = [(c, t, r or "unknown", (x or "").replace("<|im_", "<| im_")) for c, t, r, x in rows]
    out = {}
    for c in {t[0] for t in turns}:
        own = sorted((t[1:] for t in turns if t[0] == c), key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2]))
        part = lambda m: 0 if part_turns is None else None if m[0] is None else m[0] // part_turns
        for who in {r for _, r, _ in own} - {"system"}:
            for p in {part(m) for m in own}:
                text, mask, n = "", [], 0
                for _, r, x in [m for m in own if part(m) == p]:
                    n += 1
                    text += f"<|im_start|>{'assistant' if r == who else r if r == 'system' else 'user name=' + r}\n"
                    if r == who:
                        mask.append(f"{len(text)}:{len(text) + len(x)}")
                    text += x + "<|im_end|>\n"
                out[c, who, p] = (text, ",".join(mask), n)
    return out


def test_perspectives(spark):
    long = [(9, i, ("ann", "bob", "cy")[i % 3], f"message {i}") for i in range(1000)]
    table = spark.createDataFrame(ROWS + long, "conv_id long, turn long, role string, text string").withColumn("speaker", F.lit("clash"))
    for part_turns in (None, 64):
        rows = chat.perspectives(table, part_turns=part_turns).collect()
        got = {(r.conv_id, r.speaker, r.part): (r.text, r["mask"], r.n_messages) for r in rows}
        assert len(got) == len(rows) and got == plain(ROWS + long, part_turns)
        assert all(r.n_train_chars == sum(int(b) - int(a) for a, b in (m.split(":") for m in r["mask"].split(",") if m)) for r in rows)
    assert "Python" not in chat.perspectives(table)._jdf.queryExecution().toString()
    assert chat.perspectives(table.limit(0)).count() == 0


def test_the_bound_of_training_rows_holds(spark):
    """One labelled id with many documents sends one row."""
    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).alias("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, quality int")
    seen = []
    plain_fit = fq.fit
    try:
        fq.fit = lambda rows, labels: seen.append(len(rows)) or plain_fit(rows, labels)
        m = fq.train(docs, labels, max_rows=10)
    finally:
        fq.fit = plain_fit
    assert seen[0] <= 3 and fq.score(docs, m).count() == 3000


def test_the_query_is_the_plain_score(spark):
    """Held out by crc32, scores by all pairs one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "n_chars")
    docs = docs.union(spark.createDataFrame([(None, None, None), (2, "", 0)], docs.schema))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    m = fq.train(docs, labels)
    got = sorted(((r.doc_id, r.held_out, r.score, r.predicted) for r in fq.score(docs, m).collect()), key=str)
    want = []
    for r in docs.collect():
        index, value = fq.features((r.text or "").encode(), r.n_chars)
        v = m.factors[index] * value[:, None]
        gram = v @ v.T
        z = m.bias + m.linear[index] @ value + np.triu(gram, 1).sum()
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        want.append((r.doc_id, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2, p, int(p >= 0.7)))
    want.sort(key=str)
    assert [g[:2] for g in sorted(got, key=lambda x: (str(x[0]), x[2]))] == [w[:2] for w in sorted(want, key=lambda x: (str(x[0]), x[2]))]
    for g, w in zip(sorted(got, key=lambda x: (str(x[0]), x[2])), sorted(want, key=lambda x: (str(x[0]), x[2])), strict=True):
        assert abs(g[2] - w[2]) < 1e-9 and (g[3] == w[3] or abs(w[2] - 0.7) < 1e-9)


def test_linear_time_is_the_pairwise_sum():
    rng = np.random.default_rng(2)
    m = fq.Machine(0.3, rng.normal(size=fq.SIZE), rng.normal(size=(fq.SIZE, 5)))
    index, value = fq.features(b"some words and some more words | 12", 30)
    pairs = sum(m.factors[a] @ m.factors[b] * x * y for i, (a, x) in enumerate(zip(index, value)) for b, y in list(zip(index, value))[i + 1 :])
    assert np.isclose(m.logits(index, value, np.zeros(1, int))[0], 0.3 + m.linear[index] @ value + pairs)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    m = fq.train(docs, labels, max_rows=3000)
    found = fq.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), m).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in found) / len(found)
    assert len(found) > 300 and right > 0.97
    good = [r.score for r in found if r.quality]
    bad = [r.score for r in found if not r.quality]
    assert sum(a > b for a in good for b in bad) > 0.97 * len(good) * len(bad)


def test_odd_rows(spark, odd):
    m = fq.fit([], np.empty(0))
    rows = fq.score(odd.withColumn("n_chars", F.lit(None).cast("long")).withColumn("score", F.lit("clash")), m).collect()
    assert len(rows) == odd.count() and all(r.score == 0.5 for r in rows)
    none = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert fq.score(none, fq.train(none, labels)).count() == 0
