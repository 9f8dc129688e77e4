"""Best-fit-decreasing packing of token ids into fixed windows, and binary output of the windows.

Each task packs its input partition block by block (``block_ids`` ids at most, so memory is
bounded).  A document is split into pieces of at most one window, losslessly; the pieces of a
block, longest first, go each into the open window with the least room that still holds them,
found by a segment tree over room sizes.  A row is one window: its ids, padded; the cumulative
lengths of its segments; and positions that start again at 0 in each segment.  A block's last
windows are not filled by the next block; the padding that this costs is measured in the tests.

Cases: a null or empty text is the end id alone; repeated rows are packed each for itself; an
empty table gives no windows; other columns are ignored; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from betascape.llm.common import batches, ready, text_bytes
from betascape.llm.word_ids import word_ids

SCHEMA = (
    "sequence_id long, n_tokens int, doc_ids array<long>, starts array<int>, doc_tokens array<int>, "
    "cu_seqlens array<int>, ids binary, positions binary"
)


class RoomTree:
    """Open windows by room left, 0 to capacity, in a segment tree that counts windows."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The window with the least room of at least size, and that room; it leaves the tree."""
        i = size + self.leaves
        if not self.count[i]:
            while True:  # up to the first right sibling that holds a window, then down to its left
                while i & 1:
                    i >>= 1
                    if i <= 1:
                        return None
                if self.count[i + 1]:
                    i += 1
                    break
                i >>= 1
                if i <= 1:
                    return None
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.windows[room].pop(), room


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows as lists of item numbers, by best fit decreasing; ties in order of the items."""
    tree, windows = RoomTree(capacity), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = tree.take(sizes[k])
        if found is None:
            windows.append([k])
            at, room = len(windows) - 1, capacity
        else:
            at, room = found
            windows[at].append(k)
        if room > sizes[k]:
            tree.add(room - sizes[k], at)
    return windows


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, pad_id: int = 0, block_ids: int = 1 << 21,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per window.  ``ids`` and ``positions`` are rows of little-endian matrices, of unsigned 32-bit
    and 16-bit numbers (see ``read_matrix``)."""
    if not 0 < capacity <= 1 << 16:
        raise ValueError("capacity is 1 to 65536, for positions of 16 bits")
    ready(docs.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(tokenizer_path), end_id.to_bytes(4, "little")
        state = [TaskContext.get().partitionId() << 40]
        pieces: list[tuple] = []
        total = 0
        for keys, texts in batches(rows, "doc_id", "text"):
            for lo in range(0, len(keys), 64):
                for k, ids in zip(keys[lo : lo + 64], words.documents(texts[lo : lo + 64]), strict=True):
                    ids, step = ids + end, 4 * capacity
                    pieces += [(k, s // 4, ids[s : s + step], len(ids) // 4) for s in range(0, len(ids), step)]
                    total += len(ids) // 4
                    if total >= block_ids:
                        yield from block(pieces, state)
                        pieces, total = [], 0
        if pieces:
            yield from block(pieces, state)

    def block(pieces: list[tuple], state: list[int]) -> Iterator[pa.RecordBatch]:
        count = np.arange(capacity, dtype="<u2").tobytes()
        pad = pad_id.to_bytes(4, "little") * capacity
        out: list[tuple] = []
        for window in best_fit([len(p[2]) // 4 for p in pieces], capacity):
            held = [pieces[k] for k in window]
            ids = b"".join(p[2] for p in held)
            n = len(ids) // 4
            ids += pad[: 4 * (capacity - n)]
            positions = b"".join(count[: len(p[2]) // 2] for p in held) + count[: 2 * (capacity - n)]
            ends = np.cumsum([0, *(len(p[2]) // 4 for p in held)]).tolist()
            out.append((
                state[0], n, [p[0] for p in held], [p[1] for p in held], [p[3] for p in held], ends,
                ids, positions,
            ))
            state[0] += 1
            if len(out) >= 250:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        kinds = [pa.int64(), pa.int32(), longs, ints, ints, ints, pa.binary(), pa.binary()]
        cols = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(run, SCHEMA)


def write_matrices(windows: DataFrame, path: str) -> None:
    """Write the windows of ``pack`` as Parquet, each task its own files, to a path that all executors share.

    What is there is replaced; no windows give a table without rows; a lost task writes again.
    """
    windows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_matrix(rows: list[bytes], capacity: int, dtype: str = "<u4") -> np.ndarray:
    """Rows of ``ids`` ("<u4") or ``positions`` ("<u2") as one matrix of that many columns; of no rows, one without rows.
    A row of another length is an error."""
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), capacity)
