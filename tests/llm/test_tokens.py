"""Tokenising and packing against the libraries themselves and plain versions."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from betascape.llm import best_fit_packing, bpe, online_packing, word_ids

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_bpe_is_the_librarys(request, table):
    docs = request.getfixturevalue(table)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    got = sorted(map(tuple, bpe.encode_documents(docs, RANKS, P.PATTERN).collect()), key=str)
    want = []
    for r in docs.collect():
        text = r.text or ""
        ids = own.encode_ordinary(text)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids))
    assert got == sorted(want, key=str)


def test_bpe_round_trip(documents):
    rows = bpe.encode_documents(documents, RANKS, P.PATTERN)
    back = {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode_ids(rows, RANKS).collect()}
    assert back == {r.doc_id: r.text for r in documents.collect()}


def test_long_pretokens_take_the_same_merges():
    e = bpe.encoder(RANKS)
    rng = np.random.default_rng(3)
    for n in (2, 5, 63, 64, 65, 200, 256):
        piece = bytes(rng.choice(list(b"thereanding"), n).tolist())
        assert e.matrix([piece], 256)[0] == e.long(piece)


def plain_ids(text):
    t = Tokenizer.from_file(WORDS)
    return t.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_online_packing_covers_every_id_once(request, table):
    docs = request.getfixturevalue(table).repartition(3)
    want = sorted((str(r.doc_id), plain_ids(r.text)) for r in docs.collect())
    pieces = online_packing.pack(docs, WORDS).collect()
    ids = dict(want)
    by_doc: dict = {}
    for p in pieces:
        x = ids[str(p.doc_id)]
        assert p.doc_tokens == len(x) and 0 < p.length
        assert p.ids_crc32 == zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes())
        by_doc.setdefault(str(p.doc_id), []).append((p.start, p.length))
    copies = {k: sum(1 for d, _ in want if d == k) for k in ids}
    for k, parts in by_doc.items():
        assert sum(n for _, n in parts) == copies[k] * len(ids[k])
        assert len({s for s, _ in parts}) * copies[k] == len(parts)
    assert by_doc.keys() == ids.keys()
    windows: dict = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in windows.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048
    fill = [sum(n for _, n in w) for w in windows.values()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in fill)
    assert padding <= 0.02 * sum(fill)


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "hello <|endoftext|> world", "<|startoftext|>", "x<|startoftext|><|endoftext|>é <|ENDOFTEXT|> <|end oftext|>", "É<|endoftext|>漢"])
def test_spelled_marks_are_the_librarys(text):
    words = word_ids.word_ids(WORDS)
    for _ in range(3):
        assert np.frombuffer(words.documents([text.encode()])[0], "<u4").tolist() == plain_ids(text)[:-1]


def test_open_windows_stay_together():
    """What the sum of squares placed is moved alone only to fill up windows."""
    rng = np.random.default_rng(7)
    docs = [(i, np.full(n, i, "<u4").tobytes()) for i, n in enumerate(rng.integers(1, 900, 1000).tolist())]
    levels, together = online_packing.Levels(2048), {}
    for i, ids in docs:
        together.setdefault(levels.place(len(ids) // 4)[0], []).append(i)
    window: dict = {}
    pieces = list(online_packing.pack_partition(iter(docs), 2048))
    for doc, _, n, _, _, w, _ in pieces:
        window.setdefault(doc, {})[w] = n
    total = sum(len(x) // 4 for _, x in docs)
    moved = 0
    for members in together.values():
        at: dict = {}
        for d in members:
            for w, n in window[d].items():
                at[w] = at.get(w, 0) + n
        moved += sum(at.values()) - max(at.values())
    assert sum(p[2] for p in pieces) == total and moved < 0.04 * total


def test_levels_choose_the_least_sum_of_squares():
    rng = np.random.default_rng(5)
    c = 40
    levels, count = online_packing.Levels(c), np.zeros(c + 1, int)
    fill: dict = {}
    for size in rng.integers(1, c, 3000).tolist():
        best = None
        for h in range(c - size + 1):
            if h and not count[h]:
                continue
            after = count.copy()
            after[h] -= bool(h)
            after[h + size] += h + size < c
            cost = int((after[1:c] ** 2).sum())
            if best is None or cost < best[0] or cost == best[0] and h == 0:
                best = (cost, h)
        window, offset = levels.place(size)
        assert fill.get(window, 0) == offset
        fill[window] = offset + size
        count[offset] -= bool(offset)
        count[offset + size] += offset + size < c
        assert int((count[1:c] ** 2).sum()) == best[0]


def test_room_tree_is_best_fit():
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 65, 400).tolist()
    rooms: list[int] = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(64 - s)
    got = best_fit_packing.best_fit(sizes, 64)
    assert sorted(k for w in got for k in w) == list(range(400))
    assert sorted(64 - sum(sizes[k] for k in w) for w in got) == sorted(rooms)


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_best_fit_round_trip(request, tmp_path, spark, table):
    docs = request.getfixturevalue(table)
    best_fit_packing.write_matrices(best_fit_packing.pack(docs, WORDS, block_ids=20000), str(tmp_path / "m"))
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    ids = best_fit_packing.read_matrix([bytes(r.ids) for r in rows], 2048)
    positions = best_fit_packing.read_matrix([bytes(r.positions) for r in rows], 2048, "<u2")
    found: dict = {}
    for r, line, place in zip(rows, ids, positions, strict=True):
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            found.setdefault(str(d), []).append((s, line[a:b].tolist()))
            assert place[a:b].tolist() == list(range(b - a))
    for r in docs.dropDuplicates(["doc_id", "text"]).collect():
        parts = dict(found[str(r.doc_id)])
        assert [x for s in sorted(parts) for x in parts[s]] == plain_ids(r.text)


def test_best_fit_padding(spark):
    """The registered form over whole tables: little padding, and blocks that cost little more."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    share = []
    for block in (1 << 21, 1 << 17):
        rows = best_fit_packing.pack(docs, WORDS, block_ids=block).select("n_tokens").collect()
        share.append(1 - sum(r.n_tokens for r in rows) / (2048 * len(rows)))
    assert share[0] < 0.005 and share[1] < 0.02


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(none, RANKS, P.PATTERN).count() == 0
    assert online_packing.pack(none, WORDS).count() == 0
    assert best_fit_packing.pack(none, WORDS).count() == 0
