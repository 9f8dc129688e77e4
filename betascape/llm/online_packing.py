"""Sum-of-squares online packing of token documents into windows.

Each task packs the documents of its input partition in their order.  A document longer than a
window fills whole windows; what remains is placed at once into the fill level whose choice gives
the least sum of squared counts of partially filled windows, kept in a level array.  What a window
holds stays together: at the end of a partition the windows that are still open are put into each other whole, best
fit first, and only then those that hold least are cut, to fill up the others; the last rest
goes into windows whose sizes are powers of two.  So there is no padding at all, and what is cut
or moved alone is small (see ``filled_up``).  No row is shuffled, and a task that runs again gives the
same windows.

Cases: a null or empty text is the end id alone; repeated rows are packed each for itself; an empty
table gives no pieces; other columns are ignored; a null id stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from betascape.llm.best_fit_packing import best_fit
from betascape.llm.common import batches, ready, text_bytes
from betascape.llm.word_ids import word_ids

#: A piece: document, start, length, crc of its ids, ids of the document, window, offset there.
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Levels:
    """How many open windows there are at each fill level, and which."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.next = 0

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, size: int) -> tuple[int, int]:
        """Window and offset for an item of 1 to capacity - 1 ids."""
        n, c = self.count, self.capacity
        # Change of the sum of squares when a window goes from level h to h + size; full ones leave.
        top = c - size
        change = -2 * n[1 : top + 1] + 1
        change[:-1] += 2 * n[1 + size : c] + 1
        change[n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        h = int(change.argmin()) + 1
        if change[h - 1] < 2 * n[size] + 1:  # at a tie a new window opens
            window = self.open[h].pop()
            n[h] -= 1
        else:
            h, window = 0, self.new()
        if h + size < c:
            self.open[h + size].append(window)
            n[h + size] += 1
        return window, h


def pack_partition(documents: Iterator[tuple[int | None, bytes]], capacity: int) -> Iterator[tuple]:
    """Pieces (doc_id, start, length, crc32, doc_tokens, window, offset) of documents of packed ids.

    Of an open window only the ids of its pieces are held: at most capacity ids for each of at
    most a few windows a level.
    """
    levels = Levels(capacity)
    held: dict[int, list[tuple]] = {}
    for doc, ids in documents:
        total = len(ids) // 4
        whole = total - total % capacity
        for start in range(0, whole, capacity):
            yield doc, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), total, levels.new(), 0
        if size := total - whole:
            window, offset = levels.place(size)
            held.setdefault(window, []).append((doc, whole, ids[4 * whole :], total, offset))
            if offset + size == capacity:
                for d, start, part, n, at in held.pop(window):
                    yield d, start, len(part) // 4, zlib.crc32(part), n, window, at
    yield from filled_up([held[w] for w in sorted(held)], capacity, levels.new)


def filled_up(open_: list[list[tuple]], capacity: int, new: Callable[[], int]) -> Iterator[tuple]:
    """Pieces of the windows that were open at the end, each a list of (doc, start, ids, doc_tokens, offset).

    Windows merge whole, best fit decreasing.  Of the merged ones the fullest stay as they are and get
    the pieces of the least full, cut where they must be, until all but the last are full.
    """
    size = lambda parts: sum(len(p[2]) for p in parts) // 4
    merged = [[p for k in w for p in open_[k]] for w in best_fit([size(x) for x in open_], capacity)]
    merged.sort(key=lambda parts: -size(parts))
    fill = [size(x) for x in merged]
    i, j = 0, len(merged) - 1
    while i < j:
        if not fill[j]:
            j -= 1
        elif fill[i] == capacity:
            i += 1
        else:
            doc, start, ids, n, at = merged[j].pop()
            take = min(capacity - fill[i], len(ids) // 4)
            merged[i].append((doc, start, ids[: 4 * take], n, at))
            if 4 * take < len(ids):
                merged[j].append((doc, start + take, ids[4 * take :], n, at))
            fill[i] += take
            fill[j] -= take
    for parts in merged:
        left = size(parts)
        window, room, at = -1, 0, 0
        for doc, start, ids, n, _ in parts:
            while ids:
                if at == room:
                    room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
                    window, at = new(), 0
                take = min(room - at, len(ids) // 4)
                yield doc, start, take, zlib.crc32(ids[: 4 * take]), n, window, at
                ids, start, at, left = ids[4 * take :], start + take, at + take, left - take


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; ``sequence_id`` is unique over all tasks."""
    ready(docs.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(tokenizer_path), end_id.to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 40

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for keys, texts in batches(rows, "doc_id", "text"):
                for lo in range(0, len(keys), 64):
                    for k, ids in zip(keys[lo : lo + 64], words.documents(texts[lo : lo + 64]), strict=True):
                        yield k, ids + end

        out: list[tuple] = []
        for piece in pack_partition(documents(), capacity):
            out.append(piece)
            if len(out) >= 5000:
                yield batch(out, base)
                out = []
        if out:
            yield batch(out, base)

    def batch(out: list[tuple], base: int) -> pa.RecordBatch:
        cols = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
        cols[5] = pa.array([w + base for w in cols[5].to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(run, SCHEMA)
