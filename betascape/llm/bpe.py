"""Byte-level BPE over length-bucketed, padded numpy matrices.

Pretokens that a worker has not met are laid out in matrices, one per length bucket, padded with
-1.  In each round every row looks its pairs up in an open-addressing hash table, merges its
leftmost pair of least rank and is compacted; rows without a pair leave the matrix.  Pretokens
over ``LONG`` bytes take a heap with the same merge order, so no text length is quadratic.

Cases: a null text is empty (no ids, digests of the empty string); repeated rows each get a row;
an empty table gives an empty result; other columns are ignored; a null id stays null.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from betascape.llm.common import batches, ready

LONG = 256
#: Pretokens that a worker remembers; it starts afresh when they are more.
MEMO = 600_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> id of the joined token, in open addressing over numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.shift = np.uint64(64 - max(4, (4 * max(1, len(pairs))).bit_length()))
        self.last = np.int64((1 << (64 - int(self.shift))) - 1)
        self.keys = np.full(int(self.last) + 1, -1, np.int64)
        self.values = np.full(int(self.last) + 1, np.iinfo(np.int32).max, np.int32)
        left = np.fromiter(pairs.keys(), np.int64, len(pairs))
        value = np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self.home(left)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = left[free]  # of several that want a place, the last gets it
            won = self.keys[at] == left
            self.values[at[won]] = value[won]
            left, value, at = left[~won], value[~won], (at[~won] + 1) & self.last

    def home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the joined pairs; the largest int32 where there is none (or a side is padding)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        none = np.iinfo(np.int32).max
        out = np.full(keys.shape, none, np.int32)
        todo = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        flat, flat_out = keys.ravel(), out.reshape(-1)
        at = self.home(flat[todo])
        while len(todo):
            held = self.keys[at]
            hit = held == flat[todo]
            flat_out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (held != -1)
            todo, at = todo[on], (at[on] + 1) & self.last
        return out


class Encoder:
    """Ids of pretokens by ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.table = PairTable(ranks)
        self.first = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.token = {v: k for k, v in ranks.items()}

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in pieces]
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = [whole]
            elif len(p) > LONG:
                out[i] = self.long(p)
            elif p:
                buckets.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            step = max(1, (1 << 20) // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self.matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.where(np.arange(width) < size[:, None], self.first[raw], -1).astype(np.int32)
        done: list[list[int]] = [[]] * len(pieces)
        row = np.arange(len(pieces))
        none = np.iinfo(np.int32).max
        rank = self.table.find(ids[:, :-1], ids[:, 1:])
        while len(row):
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            stop = best == none
            if stop.any():
                for r, line, n in zip(row[stop].tolist(), ids[stop].tolist(), size[stop].tolist(), strict=True):
                    done[r] = line[:n]
                row, ids, rank, size, at, best = (x[~stop] for x in (row, ids, rank, size, at, best))
                if not len(row):
                    break
            wide = max(2, int(size.max()))
            ids, rank = ids[:, :wide], rank[:, : wide - 1]
            k = np.arange(len(row))
            # Compaction: all to the right of the merged pair moves one place left.
            columns = np.arange(wide)
            source = np.minimum(columns + (columns > at[:, None]), wide - 1)
            ids = np.take_along_axis(ids, source, 1)
            ids[k, at] = best
            size = size - 1
            ids[k, size] = -1
            pairs = np.arange(wide - 1)
            rank = np.take_along_axis(rank, np.minimum(pairs + (pairs >= at[:, None]), wide - 2), 1)
            rank[k, wide - 2] = none
            left, right = np.maximum(at - 1, 0), np.minimum(at + 1, wide - 1)
            fresh = self.table.find(ids[k, left], best)
            rank[k[at > 0], left[at > 0]] = fresh[at > 0]
            after = self.table.find(best, np.where(at + 1 < wide, ids[k, right], -1))
            inside = at <= wide - 2
            rank[k[inside], at[inside]] = after[inside]
        return done

    def long(self, piece: bytes) -> list[int]:
        ids: list[int] = self.first[np.frombuffer(piece, np.uint8)].tolist()
        n, pairs = len(ids), self.table.pairs
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := pairs.get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := pairs.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _loaded:
        _loaded[path] = Encoder(load_ranks(path))
    return _loaded[path]


class Memo(dict):
    """pretoken -> [its ids as decimal text, the bytes they decode to].

    A pretoken not met before gets an entry that ``fill`` completes, for all new ones at once.
    """

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder
        self.fresh: dict[str, list] = {}
        self.once: set[str] = set()

    def __missing__(self, piece: str) -> list:
        entry = self.fresh.get(piece)
        if entry is None:
            entry = self.fresh[piece] = ["", b""]
        return entry

    def fill(self) -> None:
        """Complete the new entries, and keep those whose pretokens an earlier batch had too."""
        if len(self) > MEMO or len(self.once) > 2 * MEMO:
            self.clear()
            self.once.clear()
        for (piece, entry), ids in zip(self.fresh.items(), self.encoder.encode([p.encode() for p in self.fresh]), strict=True):
            entry[0] = "".join([f"{i}," for i in ids])
            entry[1] = self.encoder.decode(ids)
            if piece in self.once:
                self[piece] = entry
            elif len(piece) <= LONG:
                self.once.add(piece)
        self.fresh = {}


_memos: dict[str, Memo] = {}


def memo(path: str) -> Memo:
    """One per worker process and file."""
    if path not in _memos:
        _memos[path] = Memo(encoder(path))
    return _memos[path]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per document: id, n_tokens, digests of the ids and of the decoded bytes, and the ids themselves
    (``with_ids``)."""
    ready(docs.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        known = memo(ranks_path)
        find = known.__getitem__
        for ids, texts in batches(rows, "doc_id", "text"):
            n, a, b, out = [], [], [], []
            for lo in range(0, len(texts), 128):
                held = [list(map(find, split(t))) for t in texts[lo : lo + 128]]
                known.fill()
                for entries in held:
                    decimal = "".join([e[0] for e in entries])
                    n.append(decimal.count(","))
                    a.append(hashlib.sha256(decimal[:-1].encode()).hexdigest())
                    b.append(hashlib.sha256(b"".join([e[1] for e in entries])).hexdigest())
                    if with_ids:
                        out.append([int(x) for x in decimal[:-1].split(",")] if decimal else [])
            cols = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array(out, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_ids(rows: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes that rows of ids stand for; a null list is empty."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks_path)
        for keys, ids in batches(rows, "doc_id", "ids"):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([e.decode(x or []) for x in ids], pa.binary())], ["doc_id", "bytes"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, bytes binary")
