"""The ledger against a plain version."""

import re

from betascape.llm import quality_rules as q

SPACE = r"[\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen: dict = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_measures(documents, odd):
    for docs in (documents, odd):
        got = sorted((str(r.doc_id), *[r[m] for m in q.MEASURES]) for r in q.ledger(docs).collect())
        assert got == sorted((str(r.doc_id), *plain(r.text)) for r in docs.collect())


def test_policies_and_ablation_read_the_ledger(documents, odd):
    rows = q.ledger(documents.select("doc_id", "text").union(odd.select("doc_id", "text"))).cache()
    assert q.policy_mask("corpus") == q.policy_mask("corpus", 2) != q.policy_mask("corpus", 1)
    for name, version in [(n, v) for n, versions in q.POLICIES.items() for v in versions]:
        kept = {r.kept: r["count"] for r in q.apply_policy(rows, name, version).groupBy("kept").count().collect()}
        m = q.policy_mask(name, version)
        bits = [r.failed_bits & m for r in rows.collect()]
        assert kept.get(True, 0) == sum(b == 0 for b in bits)
        for r in q.ablation(rows, name, version).collect():
            k = q.mask((r.rule,))
            assert (r.n_failed, r.n_only, r.n_kept_without) == (sum(b & k > 0 for b in bits), sum(b == k for b in bits), sum(b & ~k == 0 for b in bits))


def test_no_python_in_the_plan(documents):
    plan = q.ledger(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    none = q.ledger(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0 and all(r.n_failed == 0 for r in q.ablation(none, "corpus").collect())
