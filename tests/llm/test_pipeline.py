"""Each stage of the pipeline against a plain version over a small table."""

import re

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from betascape.llm import contextual_pii, quality_rules
from tests.llm.test_contextual_pii import plain as plain_spans
from tests.llm.test_quality_rules import plain as plain_measures
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_tokens import plain_ids

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs.toPandas()]
    for _, stage in cp.STAGES:
        docs = cp.cut(stage(spark, docs, SMALL))
        out.append(docs.toPandas())
    return out


def failed(text):
    n, chars, symbols, dup, rep = plain_measures(text)
    lines = len([x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")])
    return n < 50 or 100 * rep > 50 * n or 10 * symbols > 3 * n or (lines > 3 and 100 * dup > 60 * lines) or chars < 2 * n or chars > 25 * n


def test_stages_are_the_five():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "contextual_pii", "online_packing"]
    assert cp.ORACLE_SQL is None and quality_rules.RULES


def test_quality(steps):
    assert set(steps[1].doc_id) == {i for i, x in zip(steps[0].doc_id, steps[0].text, strict=True) if not failed(x)}
    assert list(steps[1].columns) == list(cp.COLUMNS)


def test_near_dedup(steps):
    rows = steps[1].sort_values("doc_id").reset_index(drop=True)
    roots = plain_components([plain_fingerprint(x) for x in rows.text])
    assert set(steps[2].doc_id) == {rows.doc_id[r] for r in set(roots)}


def shingles(words):
    return [" ".join(words[i : i + 5]) for i in range(len(words) - 4)]


def test_substring_dedup(steps):
    before = {i: x.lower().split() for i, x in zip(steps[2].doc_id, steps[2].text, strict=True)}
    after = {i: x.lower().split() for i, x in zip(steps[3].doc_id, steps[3].text, strict=True)}
    assert before.keys() == after.keys() and (steps[3].n_chars == steps[3].text.str.len()).all()
    seen: dict = {}
    for i in sorted(before):
        s = shingles(before[i])
        known = [x in seen for x in s]
        run = longest = 0
        for k in known:
            run = run + 1 if k else 0
            longest = max(longest, run)
        cut = len(before[i]) - len(after[i])
        if longest < 25:
            assert cut == 0
        if cut:
            assert cut >= 50 and sum(known) >= 0.6 * (cut - 4)
        for x in s:
            seen.setdefault(x, i)
    for i in before:  # whole passages of over 60 words that one earlier document has are gone
        for j in before:
            if j < i:
                theirs, run = set(shingles(before[j])), 0
                for x in shingles(after[i]):
                    run = run + 1 if x in theirs else 0
                    assert run < 60


def test_pii(steps, spark):
    docs = spark.createDataFrame(steps[3])
    spans = {r.doc_id: r.spans for r in contextual_pii.find(docs).collect()}
    texts = dict(zip(steps[3].doc_id, steps[3].text, strict=True))
    for i, got in zip(steps[4].doc_id, steps[4].text, strict=True):
        own = [s.split(":") for s in spans[i].split(",") if s]
        assert [":".join(s) for s in own if s[0] != "context"] == plain_spans(texts[i])
        out, at = [], 0
        for k, s, e in sorted(((k, int(s), int(e)) for k, s, e in own), key=lambda x: (x[1], x[2])):
            if s >= at:
                out += [texts[i][at:s], f"<{k.upper()}>"]
            at = max(at, e)
        assert got == "".join([*out, texts[i][at:]])
        assert not re.search(r"@mail\d\.example\.com", got)


def test_packing(steps):
    want = {i: len(plain_ids(x)) for i, x in zip(steps[4].doc_id, steps[4].text, strict=True)}
    got = steps[5].groupby("doc_id").length.sum().to_dict()
    assert got == want


def test_run_is_the_stages(spark, steps):
    rows = cp.run(spark, SMALL)
    assert rows.agg(F.sum("length")).first()[0] == steps[5].length.sum()


def test_odd_documents(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "x", "y", 0), (2, "word " * 60, "x", None, 3), (2, "word " * 60, "x", None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        now = rows
        for _, stage in cp.STAGES:
            now = cp.cut(stage(spark, now, SMALL))
        assert now.count() >= 0
        for _, stage in cp.STAGES[1:-1]:  # without the filter before them
            assert stage(spark, rows, SMALL).count() == (2 if stage is cp.near_dedup and rows is docs else rows.count())


def test_missing_and_clashing_columns(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "a", "b"), (2, text + " more", None, "c")], "doc_id long, text string, spans string, digest string")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() >= 1 and (name == "online_packing" or out.columns == list(cp.COLUMNS))


def test_near_dedup_decides_per_row(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (5, text(4)), (5, text(5)), (1, text(4)), (None, text(5)), (None, text(1))]
    docs = spark.createDataFrame([(i, x, "x", "y", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in cp.near_dedup(spark, docs, SMALL).collect()), key=str)
    assert got == sorted([(None, text(1)), (None, text(2)), (None, text(3)), (1, text(4)), (5, text(5))], key=str)
