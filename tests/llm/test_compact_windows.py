"""Windows, marks and passages against brute force, and planted passages."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from betascape.llm import compact_windows as cw


@pytest.mark.parametrize("n,width,top", [(0, 3, 9), (2, 3, 9), (60, 5, 1 << 30), (80, 7, 30), (46, 46, 1 << 30), (50, 3, 2), (200, 46, 1 << 30), (200, 46, 5)])
def test_windows_hold_all_stretches(n, width, top):
    rng = np.random.default_rng(n + width)
    for _ in range(5):
        s = rng.integers(1, top, n).astype(np.uint64)
        if top > 100 and n > 20:
            s[5:15] = s[5]  # a run
        g = (cw.mix(s) >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
        c, left, right = cw.windows(s, g, width)
        assert (left < width).all() and (right < width).all() and (left + right + 1 >= width).all()
        for x, a, b in zip(c, left, right, strict=True):
            assert (g[x - a : x + b + 1] >= g[x]).all()
        for i in range(n - width + 1):
            if len(set(s[i : i + width].tolist())) == 1:
                continue  # within a run: its first or last stretch is the same
            least = g[i : i + width].min()
            assert any(x - a <= i and i + width - 1 <= x + b and i <= x <= i + width - 1 and g[x] == least for x, a, b in zip(c, left, right, strict=True))


def test_windows_do_not_depend_on_portions(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, n)).encode() for n in (0, 3, 700, 5, 60, 300)]
    s, start, n = cw.tokens(texts, cw.Hashes())
    assert len(s) == n.sum() + 4 and (s[-4:] == 0).all()
    for t, at, k in zip(texts, start, n, strict=True):
        own = cw.tokens([t], cw.Hashes())[0]
        assert (own[: max(0, k - 4)] == s[at : at + max(0, k - 4)]).all() and (s[at + max(0, k - 4) : at + k] == 0).all()
    g = np.where(s > 0, np.maximum(s >> np.uint64(32), 1), 0).astype(np.uint32)
    whole = cw.windows(s, g, 46)
    monkeypatch.setattr(cw, "TOKENS", 100)
    for a, b in zip(whole, cw.windows(s, g, 46), strict=True):
        assert (a == b).all()


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 5000, n).tolist()]


def shingled(text):
    w = text.lower().split()
    return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]


def alike(a, b, width, longest):
    """Token places of b in passages of width..longest tokens that are alike passages of a; both begin and end with shared ones."""
    bit = {t: 1 << i for i, t in enumerate(dict.fromkeys(a + b))}
    out = set()

    def passages(s):
        for i in range(len(s)):
            mask = 0
            for j in range(i, min(len(s), i + longest)):
                assert not mask & bit[s[j]]  # no shingle twice: counts are sets here
                mask |= bit[s[j]]
                if j - i + 1 >= width:
                    yield i, j, mask, bit[s[i]] | bit[s[j]]

    theirs = list(passages(a))
    for i, j, x, ends in passages(b):
        if not set(range(i, j + 1)) <= out and any(5 * (x & y).bit_count() >= 4 * (x | y).bit_count() and not ends & ~y and not e & ~x for _, _, y, e in theirs):
            out |= set(range(i, j + 1))
    return out


def marks(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.doc, set()).update(range(r.first, r["last"] + 1))
    return out


def test_marks_against_brute_force(spark):
    """Edited copies, cut at random, in different surroundings: nothing alike is lost, nothing else marked."""
    rng = np.random.default_rng(2)
    base = words(rng, 70)
    texts = {}
    for d in range(14):
        w = base[:]
        for at in rng.integers(0, 70, rng.integers(0, 3)):
            w[at : at + 1] = [[f"e{rng.integers(1 << 40)}"], [], [w[at], f"i{rng.integers(1 << 40)}"]][rng.integers(3)] if at < len(w) else []
        w = w[rng.integers(0, 12) : len(w) - rng.integers(0, 12)]
        texts[d] = " ".join([f"a{d}x{i}" for i in range(rng.integers(0, 9))] + w + [f"z{d}x{i}" for i in range(rng.integers(0, 9))])
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = marks(cw.passages(docs, n_hashes=16))
    for b in texts:
        want = set().union(*(alike(shingled(texts[a]), shingled(texts[b]), 46, 91) for a in range(b)), set())
        assert got.get(b, set()) == want
    chunks = marks(cw.passages(docs, n_hashes=16, chunk=3))
    assert chunks == got


def test_many_classes_are_those_of_all_pairs(spark):
    """The way of large groups covers what all pairs cover."""
    rng = np.random.default_rng(8)
    base = words(rng, 75)
    rows = []
    for d in range(60):
        w = base[:]
        w[rng.integers(0, 75)] = f"e{d}"
        w[rng.integers(0, 75)] = f"f{d % 7}"
        rows.append((d, " ".join([*words(rng, 20), *w, *words(rng, 20)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_cover = marks(cw.passages(docs, n_hashes=8))
    x = {d: shingled(t) for d, t in rows}
    for b in (1, 5, 20, 40, 59):
        want = set().union(*(alike(x[a], x[b], 46, 91) for a in range(b)))
        # Gaps that no shared token fills may differ.
        seen = Counter(t for a in range(b) for t in x[a])
        assert {i for i in want if seen[x[b][i]]} <= by_cover.get(b, set()) <= want


def test_edited_copies_meet_all_earlier_ones(spark):
    rng = np.random.default_rng(21)
    base = words(rng, 60)

    def edited(at):
        return [f"e{rng.integers(1 << 40)}" if i == at else x for i, x in enumerate(base)]

    # The original, at a middle id, is near all copies; copies of different places are not near each other.
    texts = {d: edited((10, 20, 30, 40, 50)[d % 5]) for d in range(36)}
    texts[18] = base
    docs = {d: " ".join(words(rng, 30) + w + words(rng, 30)) for d, w in texts.items()}
    frame = spark.createDataFrame([*docs.items()], "doc_id long, text string")
    rows = {r.doc_id: r for r in cw.near_duplicate_passages(frame, n_hashes=12).collect()}
    assert all(rows[d].n_dup_words >= 50 for d in texts if d >= 18)


def test_windows_of_one_hash_that_only_some_partners_overlap(spark):
    """Reaches (20, 20), (39, 1), (1, 39), ... around one token: partners are neither first nor neighbours."""
    left, right = [f"l{i}" for i in range(45)], [f"r{i}" for i in range(45)]
    texts = []
    for d, (a, b) in enumerate([(22, 22), (44, 6), (6, 44), (44, 6), (6, 44), (44, 6)]):
        texts.append((d, " ".join([f"x{d}y{i}" for i in range(30)] + left[45 - a :] + ["c"] + right[:b] + [f"z{d}y{i}" for i in range(30)])))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = marks(cw.passages(docs))
    assert {k for k, v in got.items() if len(v) >= 46} == {3, 4, 5}


def test_repeats_within_a_document(spark):
    rng = np.random.default_rng(4)
    part, other = words(rng, 60), words(rng, 70)
    line = words(rng, 10)
    rows = [(1, " ".join(part + other + part)), (2, " ".join(line * 30)), (3, "of " * 300 + " ".join(other[:20])), (4, "in " * 100 + "of " * 90), (5, "of " * 70)]
    got = marks(cw.passages(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1] == set(range(130, 186))
    assert set(range(110, 250)) <= got[2] and not set(range(40)) & got[2]  # a first copy of 50 words stays
    assert 3 not in got or not set(range(46)) & got[3]
    assert set(range(100, 186)) <= got[4] and got[5] == set(range(66))


def test_planted_passages(spark):
    rng = np.random.default_rng(9)
    common, passage, line = words(rng, 60), words(rng, 90), words(rng, 20)
    texts = {}
    for i in range(40):
        w = words(rng, 200)
        if i % 3 == 0:
            w[50:50] = line  # a common line that is too short to count
        if i % 4 == 0:
            w[100:100] = common
        texts[i] = " ".join(w)
    texts[50] = " ".join(words(rng, 100) + passage + words(rng, 30))
    texts[51] = " ".join(words(rng, 10) + passage[:45] + ["edit"] + passage[46:] + words(rng, 80))
    texts |= {52: texts[51], 60: "", 61: "short text"}
    rows = [*texts.items(), (None, texts[52]), (70, None), (50, texts[50]), (50, texts[52])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("spans", "doc", "tag", "__0", "match_ids", "first"):
        docs = docs.withColumn(c, F.lit("clash"))
    out = cw.near_duplicate_passages(docs).collect()
    assert len(out) == docs.count()
    found = {r.doc_id: r for r in out if r.doc_id not in (None, 50)}
    assert {k for k, r in found.items() if r.n_dup_words} == {i for i in range(4, 40, 4)} | {51, 52}
    for i in range(4, 40, 4):
        a, b = map(int, found[i].spans.split(":"))
        assert abs(a - 100) <= 2 and abs(b - 160) <= 2 and 0 in found[i].match_ids
    # Two texts have the id 50: the lesser in the order of texts comes first.
    assert found[52].n_dup_words >= 180 and sorted(r.n_dup_words > 80 for r in out if r.doc_id == 50) in ([False, False, True], [False, True, True])
    assert [r.n_dup_words >= 180 for r in out if r.doc_id is None] == [True]
    kept = cw.remove(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    after = {r.doc_id: r for r in kept.collect() if r.doc_id not in (None, 50)}
    assert after[70].text is None and after[0].text == texts[0] and after[52].text == "" and after[8].spans == "clash"
    assert len(after[8].text.split()) in range(196, 205)
    for none in (docs.limit(0), docs.where("doc_id > 59")):
        assert cw.remove(none).count() == none.count() == cw.near_duplicate_passages(none).where("n_dup_words = 0").count()


def test_cutting_words():
    assert cw.without("a  b\nc é d ".encode(), [1, 3]).decode() == "a  é d " and cw.without(b"a b", [0, 2]) == b"" and cw.without(b"a b c", [0, 1, 2, 3]) == b"b "


def test_rows_over_many_batches(spark):
    """Groups that cross batches give the same marks."""
    rng = np.random.default_rng(6)
    passage = words(rng, 80)
    rows = [(d, " ".join(words(rng, 20) + passage + words(rng, 20))) for d in range(30)] + [(d, " ".join(passage)) for d in range(30, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cw.ready(spark)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        got = []
        for size in ("3", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got.append(marks(cw.passages(docs)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got[0] == got[1] and len(got[0]) == 49
    assert all(set(range(20, 96)) <= got[0][d] for d in range(1, 30)) and all(got[0][d] == set(range(76)) for d in range(30, 50))


def test_large_groups_lose_no_link(spark, monkeypatch):
    """Each of many edited copies names every earlier class that it is near, though one alone would cover its passage."""
    monkeypatch.setattr(cw, "MEETINGS", 500, raising=False)
    rng = np.random.default_rng(30)
    base = words(rng, 70)
    rows = []
    for d in range(75):
        w = base[:]
        w[20 + d % 30] = f"e{d}"  # edits of one place are a class, those of neighbouring places are near
        rows.append((d, " ".join([*words(rng, 20), *w, *words(rng, 20)])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: set(r.match_ids) for r in cw.near_duplicate_passages(frame, n_hashes=16).collect()}
    for d in range(30, 75):
        assert got[d] >= {p for p in (d % 30 - 2, d % 30 - 1, d % 30) if p >= 0}


def test_sharing_against_all_pairs(monkeypatch):
    rng = np.random.default_rng(31)
    z = np.stack([np.where(rng.random(91) < 0.6, rng.permutation(np.arange(1, 400))[:91], 0) for _ in range(70)])
    z[40:] = np.where(rng.random((30, 91)) < 0.8, z[7], z[40:] + 1000 * (z[40:] > 0))
    want = {(j, i, n) for j in range(70) for i in range(j) if (n := len({*z[j]} & {*z[i]} - {0})) >= 20}
    for meetings in (1, 900, 1 << 22):
        monkeypatch.setattr(cw, "MEETINGS", meetings)
        assert {x for part in cw.sharing(z, 20) for x in zip(*(y.tolist() for y in part), strict=True)} == want and want


def test_united_marks_hold_the_same_tokens(spark):
    rng = np.random.default_rng(32)
    base = words(rng, 70)
    rows = [(d, " ".join([*words(rng, 9), *base[: 20 + d % 30], f"e{d}", *base[21 + d % 30 :], *words(rng, 9)])) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every, few = cw.passages(docs), cw.passages(docs, links=False)
    assert marks(every) == marks(few) and few.count() < every.count()


def test_classes_are_the_components_of_all_links(spark, monkeypatch):
    """Few marks hold the same tokens and connect the same documents as all links do."""
    rng = np.random.default_rng(33)
    rows, plain = [], words(rng, 40)
    for g in range(4):
        base = words(rng, 75)
        for d in range(40):
            w = base[:]
            for at in rng.integers(0, 75, rng.integers(0, 4)):
                w[at] = f"e{rng.integers(1 << 40)}"
            w = w[rng.integers(0, 12) : 75 - rng.integers(0, 12)]
            rows.append((int(rng.integers(0, 150)), " ".join([*words(rng, 9), *w, *words(rng, 9), *(w if d % 9 == 0 else plain)])))
    rows += [(900, "short text"), (901, None), (None, rows[3][1]), (7, rows[60][1]), (7, " ".join(words(rng, 80)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every = cw.near_duplicate_passages(docs).collect()
    found = cw.passages(docs).collect()
    root = {}

    def least(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for r in found:
        a, b = sorted((least((r.doc, r.tag)), least((r.match, r.mtag))))
        root[b] = a
    key = [(r.doc, r.tag) for r in docs.select(*[c.alias(n) for c, n in zip(cw.keyed(docs, "doc_id", "text"), ("doc", "tag"), strict=True)]).collect()]
    want = Counter((d, least(k)[0]) for (d, _), k in zip(rows, key, strict=True))
    for marks_, meetings in ((1 << 18, 1 << 19), (50, 300)):
        monkeypatch.setattr(cw, "MARKS", marks_)
        monkeypatch.setattr(cw, "MEETINGS", meetings)
        got = cw.near_duplicate_classes(docs).collect()
        assert Counter((r.doc_id, r.class_id) for r in got) == want
        assert Counter((r.doc_id, r.n_dup_words, r.spans) for r in got) == Counter((r.doc_id, r.n_dup_words, r.spans) for r in every)
    assert len({c for _, c in want}) < len(rows) / 4


def test_rows_of_links_follow_the_documents(spark):
    """Copies with edits of their own are classes of their own: twice as many make about twice the marks, not four times."""
    rng = np.random.default_rng(34)
    base, n = words(rng, 70), []
    for size in (60, 120):
        rows = [(d, " ".join([*words(rng, 9), *[f"e{d // 2}" if i == 10 + d // 2 % 50 else w for i, w in enumerate(base)], *words(rng, 9)])) for d in range(size)]
        n.append(cw.passages(spark.createDataFrame(rows, "doc_id long, text string"), n_hashes=1, links=False).count())
    assert n[1] < 3 * n[0]


def test_crowded_hashes_mark_alike_in_few_rows(spark):
    """Through parts and buckets the same tokens are marked and the same documents connected as in one task, also where a document
    repeats its own passage, and rows follow the windows, not windows times classes."""
    rng = np.random.default_rng(35)
    base, rows = words(rng, 70), []
    for d in range(72):
        w = [f"e{d // 3}" if i == 12 + d // 3 % 46 else x for i, x in enumerate(base)]
        again = [*words(rng, 9), *w] if d % 8 == 0 else []
        rows.append((d, " ".join([*words(rng, 9), *w, *again, *words(rng, 9)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def connected(found):
        root = {}

        def least(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for r in found:
            a, b = sorted((least(r.doc), least(r.match)))
            root[b] = a
        return {x: least(x) for x in range(72)}

    one = cw.passages(docs, n_hashes=1)
    found = cw.passages(docs, n_hashes=1, links=False, chunk=8).cache()
    assert marks(found) == marks(one) and connected(found.collect()) == connected(one.collect())
    assert found.count() < one.count() / 2


def test_forest_of_marks():
    x = [np.array(c) for c in ([9, 9, 7, 3, 8], [0] * 5, [0, 50, 3, 5, 5], [10, 60, 9, 9, 9], [2, 5, 2, 3, 6], [0] * 5)]
    got = {tuple(r) for r in np.stack(cw.forest(x), 1).tolist()}
    # 5 is connected with 9 alone and has no passage of its own, so one of its marks stays beside those of the first, 2.
    assert got == {(9, 0, 0, 10, 2, 0), (9, 0, 50, 60, 2, 0), (9, 0, 50, 60, 5, 0), (7, 0, 3, 9, 2, 0), (3, 0, 5, 9, 3, 0), (8, 0, 5, 9, 6, 0)}
    again = {tuple(r) for r in np.stack(cw.forest([np.array(c) for c in zip(*sorted(got), strict=True)]), 1).tolist()}
    assert again == got
