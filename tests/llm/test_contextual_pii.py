"""Base spans against a plain version, and what contexts add."""

import hashlib
import re
import time

import numpy as np
from pyspark.sql import functions as F

from betascape.llm import contextual_pii as c

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, m):
    d = re.sub(r"[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def plain(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m[0])]


ODD = [
    "a@b.c_d@e.f x@y..z @b.c a@b a.b+c%d@e-f.g.h,", "1.2.3.4.5.6.7.8.9 256.1.1.1 0255.000.1.01 1.2.3 .1.2.3.4.",
    "4929 3483-8514 6306 49293483851463061234567 4929348385146306x 0000000000000", "+1 (017) 555-7713 +1 +12 345 +123456789012345678 ++1 2 3 4 5 6 7 8 9 0 -",
    "\u0001a@b.cd\u0001 漢字😀 a@b.cd 😀1.2.3.4", "1" * 40000 + " " + "1 " * 500 + "a" * 40000 + "@", "a." * 3000 + "@b.c " + "1.2.3.4 " * 300, None, "", "+" * 2000 + "1" * 12,
]


def test_base_is_the_plain_one(spark, documents, odd):
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], "x"), (None, ODD[0], "y")], "doc_id long, text string, spans string")
    for docs in (documents, odd, table):
        got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in c.find(docs).collect())
        want = []
        for r in docs.collect():
            s = plain(r.text)
            n = [sum(x.startswith(k + ":") for x in s) for k in PATTERNS]
            want.append((str(r.doc_id), *n, hashlib.sha256(",".join(s).encode()).hexdigest()))
        assert got == sorted(want)


def taught(spark):
    rows = [(i, f"words before mail to ann{i}@host{i}.example.com and more words in version 2.{i}0000 here") for i in range(12)]
    return spark.createDataFrame([*rows, (100, "please mail to ann12345-at-host and then version 7.12345 of it"), (101, "nothing 123456 here"), (None, None)], "doc_id long, text string")


def test_contexts_discover_and_leave_others(spark):
    got = {r.doc_id: r.spans for r in c.find(taught(spark)).collect()}
    text = "please mail to ann12345-at-host and then version 7.12345 of it"
    lo = text.index("ann12345")
    assert got[100] == f"context:{lo}:{lo + len('ann12345-at-host')}"
    assert got[101] == "" and got[None] == "" and all(got[i].count(":") == 2 for i in range(12))


def test_two_hops(spark):
    """Ids that only contexts of promoted ids hold are found in the second round, and not in one."""
    mail = [(i, f"please write mail to ann{i}@host{i}.example.com and wait") for i in range(40)]
    both = [(100 + i, f"please write mail to user{i}7700 and wait. it was sent via user{i}7700 on paper") for i in range(8)]
    last = [(200, "the thing was sent via user99-8812 on paper"), (201, "a clean one sent with 123456 on paper")]
    docs = spark.createDataFrame([*mail, *both, *last], "doc_id long, text string")
    one, more = ({r.doc_id: r.spans for r in c.find(docs, rounds=k).collect()} for k in (1, 3))
    lo = last[0][1].index("user99")
    assert one[200] == "" and more[200] == f"context:{lo}:{lo + 11}" and more[201] == "" == one[201]
    assert all(one[100 + i].count("context") == 1 and more[100 + i].count("context") == 2 for i in range(8))


def test_groups_of_digits_are_one_candidate(spark):
    cards = [x for x in (f"4929 3483 8514 {n}" for n in range(6300, 6400)) if good("card", x)][:9]
    rows = [(i, f"pay with card {x} now or never {i}") for i, x in enumerate(cards)]
    text = "pay with card 4929 3483 8514 6307 now"
    docs = spark.createDataFrame([*rows, (50, text), (51, "see mail to bob@localhost now")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in c.find(docs).collect()}
    assert got[50] == "context:14:33" and got[51] == "" and got[0] == "card:14:33"
    assert {r.doc_id: r.text for r in c.redact(docs).collect()}[50] == "pay with card <CONTEXT> now"


def plain_learn(places, rounds, min_support, min_confidence=0.8):
    edges = {}
    for token, known, contexts in places:
        for x in contexts:
            edges[token, x] = edges.get((token, x), False) or known
    seed = {}
    for (t, _), k in edges.items():
        seed[t] = max(seed.get(t, 0.0), float(k))
    s, conf = dict(seed), {}
    for _ in range(rounds):
        by = {}
        for t, x in edges:
            by.setdefault(x, []).append(s[t])
        conf = {x: sum(v) / (len(v) + 1) for x, v in by.items() if sum(y >= min_confidence for y in v) >= min_support}
        doubt = {}
        for t, x in edges:
            if x in conf:
                doubt[t] = doubt.get(t, 1.0) * max(1 - conf[x], 1e-9)
        s = {t: max(seed[t], 1 - doubt.get(t, 1.0)) for t in seed}
    return conf


def test_learning_is_the_plain_one(spark):
    rng = np.random.default_rng(11)
    places = [(f"t{t}", bool(rng.random() < (0.8 if t < 30 else 0.1)), [f"c{x}" for x in rng.integers(0, 12, rng.integers(0, 4))]) for t in rng.integers(0, 60, 400).tolist()]
    frame = spark.createDataFrame(places, "token string, known boolean, contexts array<string>")
    c.ready(spark)
    for rounds, support in ((1, 3), (3, 3), (4, 8)):
        got = {r.context: r.confidence for r in c.learn(frame, rounds, support).collect()}
        want = plain_learn(places, rounds, support)
        assert got.keys() == want.keys() and want and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_running_sums_over_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, 50, n).tolist() for n in (0, 1, 127, 128, 129, 300, 20000, 40000)]
    x = spark.createDataFrame([(r,) for r in rows], "x array<int>")
    got = x.select(c.running(F.col("x"), lambda a, b: a + b).alias("s"), c.running(F.col("x"), F.greatest).alias("m")).collect()
    for r, g in zip(rows, got, strict=True):
        assert g.s == np.cumsum(r, dtype=int).tolist() and g.m == np.maximum.accumulate(np.array(r, int)).tolist()


def test_long_texts_take_time_in_proportion(spark):
    took = {}
    for n in (1000, 20000, 40000):
        text = " x ".join(f"{i}5551.7" for i in range(n)) + " " + " ".join(f"a{i}@b.example.com" for i in range(n // 10))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        got = c.find(docs).collect()[0]
        assert got.n_email == n // 10 and len(c.redact(docs).collect()[0].text) == len(text) - sum(len(f"a{i}@b.example.com") - 7 for i in range(n // 10))
        took[n] = time.time() - began
    assert took[40000] < 3 * took[20000] + 2 and took[40000] < 40


def test_redaction(spark):
    got = {r.doc_id: r.text for r in c.redact(taught(spark)).collect()}
    assert got[100] == "please mail to <CONTEXT> and then version 7.12345 of it"
    assert got[3] == "words before mail to <EMAIL> and more words in version 2.30000 here" and got[None] is None


def test_empty_and_native(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert c.find(none).count() == 0 and c.redact(none).count() == 0
    plan = c.find(taught(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
