"""Substring near-dedup by compact windows.

Texts are lower-cased (A-Z) and cut into words at ASCII white space; tokens are the hashes of
5-word shingles.  For each of ``n_hashes`` hash functions the Cartesian tree over the token hashes
gives the compact windows (l, c, r): every subsequence within l..r that holds c has the hash of c as
its minimum.  Only windows as long as the shortest passage matter, and of these only the part that
such a passage around c can reach, so both reaches end at its length (``clamped``).

Windows with the same minimum hash are joined in these steps, which lose no pair of different contents:

* Windows of one content are one: the first stands for all, and the later ones repeat it whole.
* The others send for the tokens of their windows (each text is met once for all its windows).  A
  token that only one window of a hash holds cannot be shared, so it counts as a blank; windows
  that are equal but for blanks form a class.  A passage in a thousand different surroundings
  is one class, not a thousand contents.
* Classes are joined pairwise: their windows, put on each other at the centres, must share enough
  tokens to hold two passages of the similarity asked for, and then the real tokens are compared.
  All pairs of classes that share enough are compared, however many there are; without ``links`` all but those that can
  mark no further token and connect no further documents.

A passage counts if it has at least ``min_words`` words and shares with an earlier one so many shingles
that their Jaccard similarity, each occurrence counted, is ``similarity`` or more.  Passages longer
than a window reaches are found as stretches of it.  With a similarity of 0.8, two passages have
the same minimum under none of 4 functions with a probability of 0.0016 at most, and copies never.

Hashes with more than ``chunk`` contents go class by class through tables (see ``crowded``), with the same result: no
task meets all of their windows.  Where even their classes are more than that, these are dealt out as pairs of chunks.

Cases: null, empty and short texts have no passages.  Rows are ordered by id and then by text, rows
with a null id after all others by a hash of their text; rows that repeat both id and text are one,
and all get its passages.  A passage that an earlier place of the same document has counts, unless the two
overlap.  Empty tables give empty results; other columns are ignored or kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from xxhash import xxh64_intdigest

from betascape.llm.common import cut, ready, text_bytes
from betascape.llm.components import components

SHINGLE = 5
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: A window: kind 0, its hash, content, document, place and how far its last token repeats.  A mark: kind 1, first and last
#: token (in ``name``), document, place (for the tag), the document that has them earlier (``other``) and its tag (the low bits of ``h``).
ROW = "kind int, h long, name long, doc long, place long, other long"
MARK = "doc long, tag long, first long, last long, match long, mtag long"
#: A window with its tokens; a link of a window to an earlier one: how far it reaches left and right, and where that one's ends.
WINDOW = "h long, doc long, place long, tokens binary"
LINK = "h long, doc long, place long, other long, spot long, a long, b long, q long"
#: Marks (kind 0), and windows that pass (kind 1: h, part, c, doc, place and their tokens).
FIRST = f"kind int, {MARK}, tokens binary"
FIRST_NAMES = [c.split()[0] for c in FIRST.split(", ")]
#: Bits of a place: tag 18, centre 29, function 4, reach left 6, reach right 6.
TAG, CENTRE, FUNCTION, LEFT = 45, 16, 12, 6
TAGS = (1 << 18) - 1
#: Bytes of text whose tokens are handled at once, and tokens of which the windows are sought at once.
TEXTS, TOKENS = 1 << 20, 1 << 20
#: Meetings of classes that are counted at once.
MEETINGS = 1 << 19
#: Ids of tokens in a row that is sent.
IDS = 1 << 12
#: Marks that are held before they are united.
MARKS = 1 << 18
#: Words that a task remembers the hashes of.
MEMO = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[3]
    x = (x ^ (x >> np.uint64(29))) * ODD[4]
    return x ^ (x >> np.uint64(32))


class Hashes(dict):
    """word (UTF-8) -> its hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxh64_intdigest(word, 5)
        return h


def tokens(texts: list[bytes], known: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the texts, one place a word; first places of the texts; numbers of words.

    The token of a place is the hash of the 5 words from there on, and 0 where the text has fewer; four zeros follow the last text.
    """
    flat: list[int] = []
    n = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.lower().split()
        n[i] = len(words)
        flat.extend(map(known.__getitem__, words))
    w = np.zeros(len(flat) + 2 * SHINGLE, np.uint64)
    w[: len(flat)] = flat
    size = len(flat) + SHINGLE - 1
    total = w[:size] * ODD[0]
    for i in range(1, SHINGLE):
        total = mix(total) + w[i : size + i] * ODD[i]
    s = mix(total)
    s[s == 0] = 1
    end = np.cumsum(n)
    step = np.zeros(size + 1, np.int64)
    on = n >= SHINGLE
    np.add.at(step, (end - n)[on], 1)
    np.add.at(step, (end - SHINGLE + 1)[on], -1)
    s[np.cumsum(step[:-1]) == 0] = 0
    return s, end - n, n


def minima(x: np.ndarray, width: int) -> dict[int, np.ndarray]:
    """Least of x over each stretch whose length is a power of two up to that width."""
    out, k = {1: x}, 1
    while 2 * k <= width:
        out[2 * k] = np.minimum(out[k][:-k], out[k][k:])
        k *= 2
    return out


def windows(s: np.ndarray, g: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres of the compact windows of at least that width, and how far each reaches left and right, width - 1 at most.

    s: tokens, 0 where there is none.  g: their hashes, 0 there too.  Of equal hashes the leftmost is the
    centre.  Where a token follows itself, only the first and the last of the run are centres, and the window of the last
    reaches left over the run: together they hold what the windows of all would hold.
    """
    parts = []
    for lo in range(0, len(g), TOKENS):
        hi, pad = min(len(g), lo + TOKENS), 2 * width
        x = np.zeros(hi - lo + 2 * pad, g.dtype)
        a, b = max(0, lo - pad), min(len(g), hi + pad)
        x[a - lo + pad : b - lo + pad] = g[a:b]
        tables = minima(x, width)
        half = max(tables)
        least = np.minimum(tables[half][: len(x) - width + 1], tables[half][width - half : len(x) - half + 1])
        # The greatest of the stretches that hold a place is its own hash: it is the least of one.
        top = minima(~least, width)
        top = ~np.minimum(top[half][: len(least) - width + 1], top[half][width - half : len(least) - half + 1])
        c = np.flatnonzero((top == x[width - 1 : width - 1 + len(top)]) & (x[width - 1 : width - 1 + len(top)] > 0)) + width - 1
        c = c[(c >= pad) & (c < pad + hi - lo)]
        at, v = c - pad + lo, x[c]
        before, after = np.where(at > 0, s[at - 1], 0) == s[at], np.where(at + 1 < len(s), s[np.minimum(at + 1, len(s) - 1)], 0) == s[at]
        c, at, v, before = (y[~(before & after)] for y in (c, at, v, before))
        left, right = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        k = half
        while k:
            m = tables[k][c - left - k]
            left += k * (((m > v) | (before & (m == v))) & (left + k < width))
            right += k * ((tables[k][c + right + 1] >= v) & (right + k < width))
            k //= 2
        on = left + right + 1 >= width
        parts.append((at[on], left[on], right[on]))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3


def names(s: np.ndarray) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """A function of centres and reaches that names the contents of windows over the tokens s, by a rolling hash."""
    up, down = (np.cumprod(np.append(np.uint64(1), np.full(len(s), b, np.uint64))) for b in (ODD[1], np.uint64(pow(int(ODD[1]), -1, 1 << 64))))
    total = np.append(np.uint64(0), np.cumsum(s * up[:-1], dtype=np.uint64))

    def name(c: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        lo, end = c - left, c + right + 1
        return mix(mix((total[end] - total[lo]) * down[lo]) ^ (left << 32 | right).astype(np.uint64)).view(np.int64)

    return name


def portions(rows: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The rows in portions of bounded text, or of one text."""
    for batch in rows:
        lo, size, texts = 0, 0, batch.column(batch.schema.get_field_index(text)).to_pylist()
        for i, t in enumerate(texts):
            if i > lo and size + len(t) > TEXTS:
                yield batch.slice(lo, i - lo), texts[lo:i]
                lo, size = i, 0
            size += len(t)
        if texts:
            yield batch.slice(lo), texts[lo:]


def numbers(batch: pa.RecordBatch, *columns: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """(doc, tag): what a row is known by.  Ids as they are (those from 2^62 on may meet null ids, which are
    known by a hash of the text); the tag tells texts of one id apart."""
    digest = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    doc = F.coalesce(F.col(id_col).cast("long"), F.shiftrightunsigned(digest, 2).bitwiseOR(F.lit(1 << 62)))
    return doc, F.shiftrightunsigned(digest, 46)


def window_rows(docs: DataFrame, width: int, n_hashes: int) -> DataFrame:
    """Windows, and marks for those that repeat one of the same portion of rows (see ``ROW``)."""
    seeds = mix(np.arange(1, n_hashes + 1, dtype=np.uint64) * ODD[1])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch, texts in portions(rows, "text"):
            docs, tags = numbers(batch, "doc", "tag")
            s, start, n = tokens(texts, known)
            name, change, out = names(s), np.flatnonzero(s[1:] != s[:-1]), []
            for f, seed in enumerate(seeds):
                g = mix(s ^ seed)
                short = np.where(s > 0, np.maximum(g >> np.uint64(32), 1), 0).astype(np.uint32)
                c, left, right = windows(s, short, width)
                d = np.searchsorted(start + n, c, "right")
                end = c + right
                more = np.where(right == width - 1, np.append(change, len(s) - 1)[np.searchsorted(change, end)] - end, 0)
                place = tags[d] << TAG | (c - start[d]) << CENTRE | f << FUNCTION | left << LEFT | right
                out.append(np.stack([g[c].view(np.int64), name(c, left, right), docs[d], place, more]))
            x = np.concatenate(out, 1)
            x = x[:, np.lexsort(x[[3, 2, 1, 0]])]
            first = firsts(x)[1]
            again, marks = repeats(x, np.flatnonzero(first < np.arange(x.shape[1])), first)
            kept = np.ones(x.shape[1], bool)
            kept[again] = False
            yield record(0, *x[:, kept])
            yield record(1, *marks)

    return docs.mapInArrow(run, ROW)


def record(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], [c.split()[0] for c in ROW.split(", ")])


def firsts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted windows (h, name, ...) the first of each one's hash and the first of its content."""
    k = np.arange(x.shape[1])
    group = np.append(True, x[0, 1:] != x[0, :-1])[: len(k)]
    content = group | np.append(True, x[1, 1:] != x[1, :-1])[: len(k)]
    return np.maximum.accumulate(np.where(group, k, 0)), np.maximum.accumulate(np.where(content, k, 0))


def repeats(x: np.ndarray, later: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Which of the later windows repeat the first of their content elsewhere, and marks for those of the first function.

    What two texts have in common the windows of one function hold whole, so the others need no marks.
    """
    _, _, doc, place, _ = x
    i = first[later]
    centre = place >> CENTRE & (1 << 29) - 1
    begin, end = centre - (place >> LEFT & 63), centre + (place & 63)
    apart = (doc[later] != doc[i]) | (place[later] >> TAG != place[i] >> TAG) | (begin[later] > end[i])
    again = later[apart]
    j = again[place[again] >> FUNCTION & 15 == 0]
    return again, (doc[j] << 18 | place[first[j]] >> TAG, begin[j] << 32 | end[j] + x[4, j], doc[j], place[j], doc[first[j]])


def link_contents(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows that come sorted by (h, name, doc, place): marks for repeated contents, and the first window of
    each content if its hash has several.  Marks pass.  Between batches at most one window is held."""
    x, named = np.empty((5, 0), np.int64), False  # named: whether the first row was yielded before
    for batch in rows:
        kind, *columns = numbers(batch, *[c.split()[0] for c in ROW.split(", ")])
        yield record(1, *[c[kind == 1] for c in columns])
        old = x.shape[1]
        x = np.concatenate([x, np.stack([c[kind == 0] for c in columns])], 1)
        if x.shape[1] == old:
            continue
        group, first = firsts(x)
        k = np.arange(x.shape[1])
        yield record(1, *repeats(x, k[(k >= old) & (first < k)], first)[1])
        others = k[(k >= old) & (first == k) & (group < k)]
        heads = np.unique(group[others])
        yield record(0, *x[:, np.concatenate([heads[(heads > 0) | (not named)], others])])
        last = group[-1]
        named = bool(first[-1] != last) or bool(last == 0 and named)
        x = x[:, first[-1:]]


def gather(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(h, doc, place, tokens): for each window its tokens, the low 32 bits of each (none is 0)."""
    asked = rows.select("doc", F.shiftrightunsigned("place", TAG).alias("tag"), F.struct("h", "place").alias("w"))
    both = asked.groupBy("doc", "tag").agg(F.collect_list("w").alias("w")).join(texts, ["doc", "tag"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codec = Hashes(), pa.Codec("zstd")
        for batch, texts in portions(rows, "text"):
            sizes = batch.column(batch.schema.get_field_index("size")).to_pylist()
            s, start, n = tokens([codec.decompress(t, z, asbytes=True) for t, z in zip(texts, sizes, strict=True)], known)
            w = batch.column(batch.schema.get_field_index("w"))
            row = np.repeat(np.arange(batch.num_rows), w.value_lengths().to_numpy(zero_copy_only=False))
            h, place = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in w.flatten().flatten())
            doc = numbers(batch, "doc")[0][row]
            centre = (place >> CENTRE & (1 << 29) - 1) + start[row]
            lo, length = centre - (place >> LEFT & 63), (place >> LEFT & 63) + (place & 63) + 1
            for a in range(0, len(h), 10_000):
                j = slice(a, a + 10_000)
                end = np.cumsum(length[j])
                at = np.arange(end[-1]) - np.repeat(end - length[j], length[j]) + np.repeat(lo[j], length[j])
                yield windows_batch(h[j], doc[j], place[j], np.maximum(s[at].astype("<u4"), 1), end)

    return both.mapInArrow(run, WINDOW)


def windows_batch(h: np.ndarray, doc: np.ndarray, place: np.ndarray, flat: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    offsets = pa.py_buffer(np.append(0, end * 4).astype(np.int32).tobytes())
    held = pa.BinaryArray.from_buffers(pa.binary(), len(h), [None, offsets, pa.py_buffer(flat.astype("<u4").tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array(place), held], [c.split()[0] for c in WINDOW.split(", ")])


def dealt(rows: DataFrame, sizes: DataFrame, chunk: int) -> DataFrame:
    """(h, part, ...): the windows, those of hashes with over ``chunk`` of them once for each pair of chunks that theirs is in."""
    c = F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("doc", "place", F.lit(7)), F.col("c")).cast("int")
    other = F.explode(F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("c") - 1), lambda k: k != F.col("own"))))
    x = rows.join(sizes, "h", "left").withColumn("c", c).withColumn("own", own).withColumn("other", other)
    part = F.least("own", "other").cast("long") * F.col("c") + F.greatest("own", "other")
    return x.select("h", part.alias("part"), "doc", "place", "tokens")


def packed(docs: DataFrame) -> DataFrame:
    """(doc, tag, text, size): the texts compressed, of rows that repeat both id and text one."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in rows:
            texts = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())], ["doc", "tag", "text", "size"])

    return docs.select("doc", "tag", "text").mapInArrow(run, "doc long, tag long, text binary, size long").dropDuplicates(["doc", "tag"])


def matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    """h, doc, place of windows, and their tokens as rows with the centre in the middle, 0 where there is none."""
    h, doc, place = numbers(batch, "h", "doc", "place")
    left = place >> LEFT & 63
    length = left + (place & 63) + 1
    flat = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("tokens")).to_pylist()), "<u4")
    x = np.zeros((len(doc), 2 * width - 1), np.uint32)
    row = np.repeat(np.arange(len(doc)), length)
    x[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(width - 1 - left, length)] = flat
    return h, doc, place, x


def ranked(x: np.ndarray, width: int) -> np.ndarray:
    """Tokens (rows of windows, the centre in the middle, 0: none) as numbers that tell the first, second, ... occurrence
    in a window apart, counted from the centre to the right and then to the left."""
    order = np.concatenate([np.arange(width - 1, 2 * width - 1), np.arange(width - 2, -1, -1)])
    y = x[:, order].astype(np.uint64)
    by = np.argsort(y, axis=1, kind="stable")
    z = np.take_along_axis(y, by, 1)
    k = np.arange(z.shape[1])
    new = np.ones(z.shape, bool)
    new[:, 1:] = z[:, 1:] != z[:, :-1]
    nth = k - np.maximum.accumulate(np.where(new, k, 0), axis=1)
    out = np.zeros_like(x, dtype=np.uint64)
    ranks = np.empty_like(nth)
    np.put_along_axis(ranks, by, nth, 1)
    out[:, order] = np.where(y > 0, y << np.uint64(8) | ranks.astype(np.uint64), 0)
    return out


def spans(mine: np.ndarray, theirs: np.ndarray, width: int, similarity: float) -> tuple[np.ndarray, ...]:
    """For pairs of windows, whose shared places are given: whether passages around the centre are alike,
    and how far they reach left and right in the one and in the other."""
    n, mid = len(mine), width - 1

    def ends(m: np.ndarray) -> np.ndarray:
        """Distances from the centre of its 0, 1, 2, ... matches; beyond, a large number."""
        out = np.where(m, np.arange(1, width, dtype=np.int16), np.int16(1 << 12))
        out.sort(axis=1)
        return np.concatenate([np.zeros((n, 1), np.int16), out], 1)

    ly, lx, ry, rx = ends(mine[:, :mid][:, ::-1]), ends(theirs[:, :mid][:, ::-1]), ends(mine[:, mid + 1 :]), ends(theirs[:, mid + 1 :])
    # Shared / (all - shared) >= similarity, as a sum over both sides of the centre.
    r = np.arange(width)
    sl, sr = ((r * (1 + similarity) - similarity * (a + b)).astype(np.float32) for a, b in ((ly, lx), (ry, rx)))
    good = sl[:, :, None] >= (similarity - 1 - 1e-3 - sr)[:, None, :]
    for a, b in ((ly, ry), (lx, rx)):
        good &= a[:, :, None] >= (width - 1 - b)[:, None, :]
    found = good.any((1, 2))
    at = np.arange(n)
    i, j = width - 1 - good.any(2)[:, ::-1].argmax(1), width - 1 - good.any(1)[:, ::-1].argmax(1)
    return found, *(x[at, k].astype(np.int64) for x, k in ((ly, i), (ry, j), (lx, i), (rx, j)))


def extent(on: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the places of each row reach left and right of the centre."""
    left, right = on[:, : width - 1], on[:, width:][:, ::-1]
    return tuple(np.where(y.any(1), width - 1 - y.argmax(1), 0) for y in (left, right))


def compare(x: np.ndarray, group: np.ndarray, width: int, similarity: float, node: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(window, earlier window, reach left, right, the earlier one's reach left, right) of alike passages.

    x: tokens of windows, sorted by their groups, each in order of the documents.  Only the first window of a class
    is named as the earlier one.  With ``node`` (the document of each window) pairs of classes are left out that can mark no
    further token and connect no further documents.
    """
    least = int(np.ceil(2 * width * similarity / (1 + similarity) - 1e-9))
    ids = ranked(x, width)
    row, column = np.nonzero(ids)
    if not len(row):
        return
    key = mix(ids[row, column] ^ mix(group[row].astype(np.uint64) * ODD[0]))
    while True:  # until each token that is left is shared
        _, number, count = np.unique(key, return_inverse=True, return_counts=True)
        on = count[number] > 1
        shared = np.bincount(row[on], minlength=len(x))
        keep = on & (shared[row] >= least)
        if keep.all():
            break
        row, column, key = row[keep], column[keep], key[keep]
        if not len(row):
            return
    numbers_ = np.zeros(x.shape, np.int64)
    numbers_[row, column] = number + 1
    alive = np.flatnonzero(shared >= least)
    z = numbers_[alive]
    weights = mix(np.arange(1, z.shape[1] + 1, dtype=np.uint64) * ODD[2])
    _, first, kind = np.unique((mix(z.astype(np.uint64)) * weights * (z > 0)).sum(1, dtype=np.uint64), return_index=True, return_inverse=True)
    order = np.argsort(first)  # classes in the order of their first windows
    first, kind = first[order], np.argsort(order)[kind]
    classes, of = z[first], group[alive[first]]
    members = np.argsort(kind, kind="stable")
    begin = np.searchsorted(kind[members], np.arange(len(first) + 1))

    # Of each class how far links mark all of its windows, how far its tokens reach, and the classes that it is connected with.
    reached = np.full((2, len(first)), -1)
    outer = np.stack(extent(classes > 0, width))
    label = np.arange(len(first))
    owners = np.empty(0, np.uint64) if node is None else np.unique(mix(kind.astype(np.uint64)) ^ node[alive])

    def settled(later: np.ndarray, earlier: np.ndarray, reach: np.ndarray) -> np.ndarray:
        return (reached[:, later] >= reach).all(0) & (label[later] == label[earlier])

    def settle(later: np.ndarray, earlier: np.ndarray, reach: tuple[np.ndarray, ...]) -> None:
        nonlocal label
        label = roots(later, earlier, label)
        # A link marks all windows of a class that has none in the earlier window's document.
        own = mix(later.astype(np.uint64)) ^ node[alive[first[earlier]]]
        whole = owners[np.minimum(np.searchsorted(owners, own), len(owners) - 1)] != own
        for side in (0, 1):
            np.maximum.at(reached[side], later[whole], reach[side][whole])

    def expand(later: np.ndarray, earlier: np.ndarray, reach: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """All windows of the later class but the earlier one itself."""
        n = begin[later + 1] - begin[later]
        pair = np.repeat(np.arange(len(later)), n)
        at = members[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[later], n)]
        on = at != first[earlier][pair]
        pair, at = pair[on], at[on]
        return alive[at], alive[first[earlier[pair]]], *(r[pair] for r in reach)

    def matches(a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine = (a == b) & (a > 0)
        theirs = mine.copy()
        # Where all that is shared stands at the same places, there is no more to look for.
        odd = np.flatnonzero(mine.sum(1) != shared)
        if len(odd):
            n = np.arange(len(odd), dtype=np.int64)[:, None] << 40
            x, y = a[odd] | n, b[odd] | n
            both = np.concatenate([x.ravel(), y.ravel()])
            by = np.argsort(both, kind="stable")
            same = np.zeros(len(both), bool)
            twin = both[by][1:] == both[by][:-1]
            same[by[1:][twin]] = True
            same[by[:-1][twin]] = True
            mine[odd], theirs[odd] = same[: x.size].reshape(x.shape) & (a[odd] > 0), same[x.size :].reshape(y.shape) & (b[odd] > 0)
        return mine, theirs

    def verify(later: np.ndarray, earlier: np.ndarray, shared: np.ndarray) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
        order = np.arange(len(later))
        if node is not None:  # the first pair of each class, then the second, ...: the first ones settle most
            by = np.argsort(later, kind="stable")
            start = np.searchsorted(later[by], later[by])
            order = by[np.argsort(order - start, kind="stable")]
        for lo in range(0, len(later), 2000):
            at = order[lo : lo + 2000]
            if node is not None:
                at = at[~settled(later[at], earlier[at], outer[:, later[at]])]
            mine, theirs = matches(classes[later[at]], classes[earlier[at]], shared[at])
            if node is not None:
                open_ = ~settled(later[at], earlier[at], np.stack(extent(mine, width)))
                at, mine, theirs = at[open_], mine[open_], theirs[open_]
            if not len(at):
                continue
            found, *reach = spans(mine, theirs, width, similarity)
            at, reach = at[found], tuple(r[found] for r in reach)
            if node is not None:
                settle(later[at], earlier[at], reach)
            yield at, reach

    def pairs(later: np.ndarray, earlier: np.ndarray, shared: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for on, reach in verify(later, earlier, shared):
            yield expand(later[on], earlier[on], reach)

    # Windows of one class.
    alone = np.flatnonzero(np.diff(begin) > 1)
    yield from pairs(alone, alone, (classes[alone] > 0).sum(1))
    edges = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    sizes = np.diff(np.append(edges, len(of)))
    # Small groups: all pairs of classes that share enough.
    later, earlier = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for m in np.unique(sizes[(sizes > 1) & (sizes <= 24)]):
        j, i = np.tril_indices(int(m), -1)
        at = edges[sizes == m][:, None]
        later.append((at + j).ravel())
        earlier.append((at + i).ravel())
    later, earlier = np.concatenate(later), np.concatenate(earlier)
    for lo in range(0, len(later), 5000):
        a, b = later[lo : lo + 5000], earlier[lo : lo + 5000]
        both = np.concatenate([classes[a], classes[b]], 1)
        both.sort(axis=1)
        enough = (shared := ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] > 0)).sum(1)) >= least
        yield from pairs(a[enough], b[enough], shared[enough])
    for at, m in zip(edges[sizes > 24], sizes[sizes > 24], strict=True):
        for later, earlier, shared in sharing(classes[at : at + m], least):
            yield from pairs(later + at, earlier + at, shared)


def sharing(z: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(later, earlier, shared) of all pairs of one large group of classes that share enough tokens, some at a time.

    A class holds a token once.  Each of its tokens meets the classes that have it, so the work follows the shared tokens.
    """
    m = len(z)
    row, column = np.nonzero(z)
    _, token, count = np.unique(z[row, column], return_inverse=True, return_counts=True)
    owner = row[np.argsort(token, kind="stable")]
    start, size = np.cumsum(count) - count, count
    edges = np.searchsorted(row, np.arange(m + 1))
    lo = 1
    while lo < m:
        # As many classes as have a bounded number of meetings and of cells, or one.
        met = np.cumsum(size[token[edges[lo] :]])
        hi = int(np.searchsorted(edges, edges[lo] + np.searchsorted(met, MEETINGS), "right")) - 1
        hi = max(lo + 1, min(hi, lo + MEETINGS // m, m))
        own = token[edges[lo] : edges[hi]]
        n = size[own]
        ends = np.cumsum(n)
        other = owner[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - start[own], n)]
        shared = np.bincount(np.repeat(row[edges[lo] : edges[hi]] - lo, n) * m + other, minlength=(hi - lo) * m).reshape(hi - lo, m)
        later, earlier = np.nonzero(shared >= least)
        on = earlier < later + lo
        later, earlier = later[on], earlier[on]
        yield later + lo, earlier, shared[later, earlier]
        lo = hi


def mark_batch(doc: np.ndarray, place: np.ndarray, other: np.ndarray, spot: np.ndarray, a: np.ndarray, b: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Marks of windows that reach a to the left and b to the right like an earlier one whose passage ends q after its centre."""
    tag, centre, earlier = place >> TAG, place >> CENTRE & (1 << 29) - 1, spot >> CENTRE & (1 << 29) - 1
    # What overlaps in one document is no repeat.
    on = (doc != other) | (tag != spot >> TAG) | (centre - a > earlier + q)
    if on.any():
        yield pa.RecordBatch.from_arrays([pa.array(y[on]) for y in (doc, tag, centre - a, centre + b, other, spot >> TAG)], [c.split()[0] for c in MARK.split(", ")])


def roots(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after nodes a and b are joined pairwise: of each component the least node."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        label = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def forest(x: list[np.ndarray]) -> list[np.ndarray]:
    """As few marks as hold the same tokens and leave the same documents connected: overlapping ones are one, and match the first
    document that theirs is connected with; a document that only others match, and that isn't this first, keeps one of these."""
    doc, tag, first, last, match, mtag = x
    n, ids, tags = len(doc), np.concatenate([doc, match]), np.concatenate([tag, mtag])
    order = np.lexsort((tags, ids))
    new = np.append(True, (ids[order][1:] != ids[order][:-1]) | (tags[order][1:] != tags[order][:-1]))
    number = np.empty(2 * n, np.int64)
    number[order] = np.cumsum(new) - 1
    at = order[new]  # a place of each node
    a, b = number[:n], number[n:]
    root = roots(a, b, np.arange(len(at)))
    by = np.lexsort((last, first, a))
    end = np.maximum.accumulate(a[by] << 32 | last[by])
    heads = np.flatnonzero(np.append(True, (a[by] << 32 | first[by])[1:] > end[:-1]))
    marked = np.zeros(len(at), bool)
    marked[a] = True
    lone, k = np.unique(b, return_index=True)
    k = k[~marked[lone] & (root[lone] != lone)]
    to = at[np.append(root[a[by][heads]], b[k])]
    keep = np.append(by[heads], k)
    return [doc[keep], tag[keep], first[keep], np.append(np.maximum.reduceat(last[by], heads), last[k]), ids[to], tags[to]]


def united(marks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As few marks as hold the same tokens and leave the same documents connected (see ``forest``)."""
    names = [c.split()[0] for c in MARK.split(", ")]
    held, size, most = [], 0, MARKS
    for batch in marks:
        held.append(numbers(batch, *names))
        size += batch.num_rows
        if size > most:
            held = [forest([np.concatenate(c) for c in zip(*held, strict=True)])]
            size = len(held[0][0])
            most = max(MARKS, 2 * size)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in forest([np.concatenate(c) for c in zip(*held, strict=True)])], names)


def edges(batch: pa.RecordBatch, *keys: str) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """Where the two keys change, and what they are in the first and in the last row."""
    a, b = numbers(batch, *keys)
    return np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, [(int(a[k]), int(b[k])) for k in (0, -1)]


def whole(rows: Iterator[pa.RecordBatch], a: str, b: str, least: int, aside: Callable[[], Iterator[pa.RecordBatch]] = lambda: iter(())) -> Iterator[pa.RecordBatch]:
    """Rows that come sorted by two keys, in batches of that many or more that hold all rows of their keys.  After each batch that comes
    ``aside`` is asked for more to pass."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    size, last = 0, None
    for batch in rows:
        yield from aside()
        if not batch.num_rows:
            continue
        new, keys = edges(batch, a, b)
        held.append(batch)
        size += batch.num_rows
        if size >= least and (len(new) or last is not None and keys[0] != last):
            both = joined()
            at = int(edges(both, a, b)[0][-1])
            yield both.slice(0, at)
            held, size = [both.slice(at)], both.num_rows - at
        last = keys[1]
    if held:
        yield joined()


def grouped(rows: Iterator[pa.RecordBatch], a: str, b: str, least: int) -> Iterator[pa.RecordBatch]:
    """Likewise, each pair of keys for itself."""
    for batch in whole(rows, a, b, least):
        at = [0, *edges(batch, a, b)[0].tolist(), batch.num_rows]
        for lo, hi in zip(at, at[1:], strict=False):
            yield batch.slice(lo, hi - lo)


def compare_windows(rows: Iterator[pa.RecordBatch], width: int, similarity: float, classes: bool = False, links: bool = True) -> Iterator[pa.RecordBatch]:
    """Marks of windows (h, part, doc, place, tokens) that come sorted by (h, part, doc, place), or with ``classes``
    links (see ``LINK``).  Without ``links`` marks are united.  The windows of one (h, part) are held in memory."""

    def marks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        part = numbers(batch, "part")[0]
        h, doc, place, x = matrix(batch, width)
        group = np.cumsum(np.append(False, (h[1:] != h[:-1]) | (part[1:] != part[:-1])))
        every = links or classes
        node = None if every else mix(doc.astype(np.uint64) ^ mix((place >> TAG).astype(np.uint64)))
        found = (m for pairs in compare(x, group, width, similarity, node) for m in named(h, doc, place, *pairs))
        yield from found if every else united(found)

    def named(h: np.ndarray, doc: np.ndarray, place: np.ndarray, j: np.ndarray, i: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        if classes:  # both windows stand for others: which are marked comes later
            yield pa.RecordBatch.from_arrays([pa.array(y) for y in (h[j], doc[j], place[j], doc[i], place[i], a, b, q)], [c.split()[0] for c in LINK.split(", ")])
            return
        yield from mark_batch(doc[j], place[j], doc[i], place[i], a, b, q)

    for batch in whole(rows, "h", "part", 4000):
        yield from marks(batch)


def few_first(rows: Iterator[pa.RecordBatch], width: int, similarity: float, links: bool) -> Iterator[pa.RecordBatch]:
    """Of windows (h, part, doc, place, tokens, c): marks of those of hashes with few contents (c is 1); the others pass (see ``FIRST``)."""
    passing: list[pa.RecordBatch] = []

    def few() -> Iterator[pa.RecordBatch]:
        for batch in rows:
            on = numbers(batch, "c")[0] > 1
            if on.any():
                passing.append(batch.filter(pa.array(on)))
            yield batch.filter(pa.array(~on))

    def drained() -> Iterator[pa.RecordBatch]:
        while passing:
            x = passing.pop()
            cols = [x.column(x.schema.get_field_index(c)) for c in ("h", "part", "c", "doc", "place", "tokens")]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(x.num_rows, np.int32)), *cols[:2], cols[2].cast(pa.int64()), *cols[3:5], pa.nulls(x.num_rows, pa.int64()), cols[5]], FIRST_NAMES)

    for batch in whole(few(), "h", "part", 4000, drained):
        if batch.schema.names == FIRST_NAMES:
            yield batch
            continue
        for m in compare_windows(iter([batch]), width, similarity, links=links):
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m.num_rows, np.int32)), *m.columns, pa.nulls(m.num_rows, pa.binary())], FIRST_NAMES)


def listed_ids(v: np.ndarray) -> bytes:
    """Ids of tokens (see ``ranked``) in five bytes each."""
    return (v >> np.uint64(8)).astype("<u4").tobytes() + (v & np.uint64(255)).astype(np.uint8).tobytes()


def ids_of(held: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4", len(x) // 5).astype(np.uint64) << np.uint64(8) | np.frombuffer(x, np.uint8, len(x) // 5, len(x) // 5 * 4) for x in held]


def tally(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(h, bucket, part, many, ids): the tokens of each part of a hash's windows, dealt into as many buckets as there are parts; ``many``
    are those that several windows of the part have.  A row has at most ``IDS`` of them."""
    for batch in grouped(rows, "h", "part", 4000):
        h, part, c = (int(x[0]) for x in numbers(batch, "h", "part", "c"))
        ids = ranked(matrix(batch, width)[3], width)
        v, n = np.unique(ids[ids > 0], return_counts=True)
        key = (mix(v) % np.uint64(c)).astype(np.int64) << 1 | (n > 1)
        order = np.argsort(key, kind="stable")
        key, v = key[order], v[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(v)]
        at = np.unique(np.concatenate([np.arange(lo, hi, IDS) for lo, hi in zip(at, np.append(at[1:], len(v)), strict=True)] or [at]))
        for lo in range(0, len(at), 500):
            k = at[lo : lo + 500]
            held = [listed_ids(v[i:j]) for i, j in zip(k, np.append(at, len(v))[lo + 1 : lo + 501], strict=True)]
            cols = [np.full(len(k), h), key[k] >> 1, np.full(len(k), part), key[k] & 1]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(held, pa.binary())], ["h", "bucket", "part", "many", "ids"])


def answer(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, h, part, doc, place, tokens): to each part those of its tokens that one of its windows and one of another part have."""
    for batch in grouped(rows, "h", "bucket", 64):
        h, part, many = numbers(batch, "h", "part", "many")
        each = ids_of(batch.column(batch.schema.get_field_index("ids")).to_pylist())
        ends = np.cumsum([len(v) for v in each])
        _, number = np.unique(np.concatenate(each), return_inverse=True)
        shared = np.bincount(number, np.repeat(1 + many, np.diff(np.append(0, ends))))[number] > 1
        rows_ = [(int(p), listed_ids(v[on])) for p, m, v, on in zip(part, many, each, np.split(shared, ends[:-1]), strict=True) if not m and on.any()]
        none, zero = pa.nulls(len(rows_), pa.int64()), np.zeros(len(rows_), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(zero), pa.array(np.full(len(rows_), h[0])), pa.array([p for p, _ in rows_], pa.int64()), none, none, pa.array([x for _, x in rows_], pa.binary())], ["kind", "h", "part", "doc", "place", "tokens"])


def blanked(rows: Iterator[pa.RecordBatch], width: int, least: int) -> Iterator[pa.RecordBatch]:
    """(h, key, doc, place, tokens): the class of each window that shares enough tokens; the first of a part's class
    has its tokens, 0 where it alone has them."""
    for batch in grouped(rows, "h", "part", 4000):
        kind = numbers(batch, "kind")[0]
        asked = ids_of(batch.filter(pa.array(kind == 0)).column(batch.schema.get_field_index("tokens")).to_pylist())
        windows = batch.filter(pa.array(kind == 1))
        h, doc, place, x = matrix(windows, width)
        ids = ranked(x, width)
        v, number, n = np.unique(ids, return_inverse=True, return_counts=True)
        shared = (n > 1) | np.isin(v, np.concatenate([np.empty(0, np.uint64), *asked]))
        z = np.where((shared & (v > 0))[number].reshape(ids.shape), ids, np.uint64(0))
        on = np.flatnonzero((z > 0).sum(1) >= least)
        if not len(on):
            continue
        z, h, doc, place = z[on], h[on], doc[on], place[on]
        weights = mix(np.arange(1, z.shape[1] + 1, dtype=np.uint64) * ODD[2])
        key = (mix(z) * weights * (z > 0)).sum(1, dtype=np.uint64).view(np.int64)
        held: list[bytes | None] = [None] * len(on)
        for i in np.unique(key, return_index=True)[1]:
            left, right = int(place[i]) >> LEFT & 63, int(place[i]) & 63
            held[i] = (z[i, width - 1 - left : width + right] >> np.uint64(8)).astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays([*map(pa.array, (h, key, doc, place)), pa.array(held, pa.binary())], ["h", "key", "doc", "place", "tokens"])


def crowded(rows: DataFrame, width: int, similarity: float, chunk: int, links: bool = True) -> DataFrame:
    """Marks of the windows (h, part, c, doc, place, tokens) of hashes that very many contents have, found class by class.

    The windows of a hash are dealt into parts of about ``chunk``.  Each part sends its tokens, packed and each once, to buckets
    and hears which of them other parts have as well; those that one window alone holds are blanked, and windows that are equal but
    for blanks become a class, of which the first goes on.  A passage in very many surroundings is one class then, and
    the work follows the number of windows.  Without ``links`` a window is marked by the links of its class that reach
    farthest and by those from its own document, and the others mark the first of the class alone: the same tokens
    are marked and the same documents connected, and rows don't grow as windows times links.
    """
    least = int(np.ceil(2 * width * similarity / (1 + similarity) - 1e-9))
    ids = rows.mapInArrow(lambda it: tally(it, width), "h long, bucket long, part long, many long, ids binary").repartition("h", "bucket")
    known = ids.sortWithinPartitions("h", "bucket").mapInArrow(answer, "kind int, h long, part long, doc long, place long, tokens binary")
    both = known.union(rows.select(F.lit(1).alias("kind"), "h", "part", "doc", "place", "tokens")).repartition("h", "part").sortWithinPartitions("h", "part", "kind", "doc", "place")
    kept = cut(both.mapInArrow(lambda it: blanked(it, width, least), "h long, key long, doc long, place long, tokens binary"))
    first = F.min(F.when(F.col("tokens").isNotNull(), F.struct("doc", "place", "tokens"))).alias("first")
    classes = cut(kept.groupBy("h", "key").agg(first, F.count("*").alias("n")))

    def own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            h, doc, place, x = matrix(batch, width)
            found, a, b, _, q = spans(x > 0, x > 0, width, similarity)
            if found.any():
                yield pa.RecordBatch.from_arrays([pa.array(y[found]) for y in (h, doc, place, doc, place, a, b, q)], [c.split()[0] for c in LINK.split(", ")])

    heads = classes.select("h", "first.doc", "first.place", "first.tokens", "n")
    alone = heads.where("n > 1").mapInArrow(own, LINK)
    heads = heads.drop("n")
    pairs = dealt(heads, F.broadcast(heads.groupBy("h").agg(F.count("*").alias("n"))), chunk).repartition("h", "part").sortWithinPartitions("h", "part", "doc", "place")
    found = alone.union(pairs.mapInArrow(lambda it: compare_windows(it, width, similarity, True), LINK))
    # A link of a class's first window marks all of the class.
    named = classes.select("h", "key", "first.doc", "first.place")
    found = cut(found.join(named, ["h", "doc", "place"]))
    members, reach = kept.select("h", "key", "doc", "place"), ["other", "spot", "a", "b", "q"]
    if links:
        every = members.join(found.select("h", "key", *reach), ["h", "key"])
    else:
        tag = F.shiftrightunsigned("spot", TAG)
        of = found.select("h", "key", tag.alias("tag"), *reach)
        by = [Window.partitionBy("h", "key", "other", "tag").orderBy(F.desc(c), "spot") for c in "ab"]
        far = of.withColumns({f"n{c}": F.row_number().over(w) for c, w in zip("ab", by, strict=True)}).where("na = 1 or nb = 1")
        by = [Window.partitionBy("h", "key").orderBy(F.col(f"n{c}") > 1, F.desc(c), "other", "spot") for c in "ab"]
        # Of the two documents that reach farthest to a side one at least isn't a window's own.
        far = far.withColumns({f"m{c}": F.row_number().over(w) for c, w in zip("ab", by, strict=True)}).where("ma <= 2 or mb <= 2").select("h", "key", *reach)
        same = of.select("h", "key", F.col("other").alias("doc"), "tag", *reach)
        same = members.withColumn("tag", F.shiftrightunsigned("place", TAG)).join(same, ["h", "key", "doc", "tag"]).drop("tag")
        columns = ["doc", "place", *reach]
        every = members.join(far, ["h", "key"]).select(columns).union(same.select(columns)).union(found.select(columns))
    every = every.where((F.col("doc") != F.col("other")) | (F.col("place") != F.col("spot")))

    def marks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (m for batch in it for m in mark_batch(*numbers(batch, "doc", "place", *reach)))
        yield from some if links else united(some)

    return every.mapInArrow(marks, MARK)


def passages(
    docs: DataFrame, min_words: int = 50, n_hashes: int = 4, similarity: float = 0.8, chunk: int = 1 << 14, id_col: str = "doc_id", text_col: str = "text",
    links: bool = True,
) -> DataFrame:
    """(doc, tag, first, last, match): tokens first..last of a document (as ``keyed`` names it) that document ``match`` has
    earlier; a token is the 5 words from its place on, ``mtag`` tells texts of one match apart.  Without ``links`` not every match is
    named, but all tokens are, and the documents that links connect are connected by the matches that are."""
    width = min_words - SHINGLE + 1
    if not 1 < width <= 64 or not 1 <= n_hashes <= 16:
        raise ValueError("min_words is 6 to 68, n_hashes 1 to 16")
    ready(docs.sparkSession)
    doc, tag = keyed(docs, id_col, text_col)
    rows = docs.select(doc.alias("doc"), tag.alias("tag"), text_bytes(text_col).alias("text"))
    by_hash = window_rows(rows, width, n_hashes).repartition("h").sortWithinPartitions("h", "name", "doc", "place")
    linked = cut(by_hash.mapInArrow(link_contents, ROW))
    again = linked.where("kind = 1").select(
        "doc", F.shiftrightunsigned("place", TAG).alias("tag"), F.shiftright("name", 32).alias("first"), F.col("name").bitwiseAND(F.lit((1 << 32) - 1)).alias("last"), F.col("other").alias("match"), F.col("h").bitwiseAND(F.lit(TAGS)).alias("mtag"),
    )
    several = linked.where("kind = 0").select("h", "doc", "place")
    hot = cut(several.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > chunk))
    crowd = not hot.isEmpty()
    near = gather(several, packed(rows))
    if not crowd:
        few = near.withColumn("part", F.lit(0).cast("long")).repartition("h", "part").sortWithinPartitions("h", "part", "doc", "place")
        return again.union(few.mapInArrow(lambda it: compare_windows(it, width, similarity, links=links), MARK))
    # At most one key for ``chunk`` windows, which all tasks get: the windows are dealt out once for both ways.
    c = F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int")
    part = F.pmod(F.xxhash64("doc", "place", F.lit(7)), F.col("c"))
    near = near.join(F.broadcast(hot), "h", "left").withColumn("c", c).withColumn("part", part).drop("n")
    near = near.repartition("h", "part").sortWithinPartitions("h", "part", "doc", "place")
    first = cut(near.mapInArrow(lambda it: few_first(it, width, similarity, links), FIRST))
    names = dict(zip(["h", "part", "c", "doc", "place"], FIRST_NAMES[1:6], strict=True))
    rest = first.where("kind = 1").select(*[F.col(v).alias(k) for k, v in names.items()], "tokens")
    return again.union(first.where("kind = 0").select(FIRST_NAMES[1:-1])).union(crowded(rest, width, similarity, chunk, links))


def merged(found: DataFrame) -> DataFrame:
    """(doc, tag, spans, matches) of ``passages``: disjoint spans of words as one list start, end, start, end, ..., and (doc, tag) of matches."""
    match = F.struct(F.col("match").alias("doc"), F.col("mtag").alias("tag"))
    by_doc = found.groupBy("doc", "tag").agg(F.collect_list(F.struct("first", "last")).alias("s"), F.sort_array(F.collect_set(match)).alias("m"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for marks in batch.column(batch.schema.get_field_index("s")):
                first, last = (x.to_numpy(zero_copy_only=False) for x in marks.values.flatten())
                order = np.argsort(first, kind="stable")
                start, end = first[order], np.maximum.accumulate(last[order] + SHINGLE)
                new = np.flatnonzero(start[1:] > end[:-1]) + 1
                out.append(np.stack([start[np.append(0, new)], end[np.append(new - 1, len(end) - 1)]], 1).ravel())
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("doc", "tag")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.list_(pa.int64())), batch.column(batch.schema.get_field_index("m"))], ["doc", "tag", "spans", "matches"])

    return by_doc.mapInArrow(run, "doc long, tag long, spans array<long>, matches array<struct<doc:bigint,tag:bigint>>")


def report(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """A row per document with what ``merged`` has of it: __id, spans, match_ids (and class_id, if it has that); or if ``keep`` its
    columns as __0, __1, ... and spans."""
    doc, tag = keyed(docs, id_col, text_col)
    columns = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns)] if keep else [F.col(id_col).alias("__id")]
    rows = docs.select(*columns, doc.alias("doc"), tag.alias("tag"))
    out = [c for c in rows.columns if c.startswith("__")] + ["spans"]
    if not keep:
        out += [F.array_distinct(F.transform("matches", lambda m: m["doc"])).alias("match_ids")]
        out += [F.coalesce("class_id", "doc").alias("class_id")] if "class_id" in spans.columns else []
    return rows.join(spans, ["doc", "tag"], "left").select(out)


def without(text: bytes, spans: list[int]) -> bytes:
    """A text without the words of the spans (start, end, start, end, ...) and the white space after them."""
    places = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    places.append(len(text))
    out, at = [], 0
    for s, e in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : places[min(s, len(places) - 1)]])
        at = places[min(e, len(places) - 1)]
    return b"".join([*out, text[at:]])


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns and rows, without passages that come earlier.  Rows that repeat both id and
    text stay alike."""
    rows = report(docs, merged(passages(docs, id_col=id_col, text_col=text_col, links=False, **options)), id_col, text_col, keep=True)
    k = docs.columns.index(text_col)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            *columns, spans = batch.columns
            texts = zip(columns[k].to_pylist(), spans.to_pylist(), strict=True)
            columns[k] = pa.array([t if not s or t is None else without(t.encode(), s).decode() for t, s in texts], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, [f"__{i}" for i in range(len(columns))])

    schema = StructType([StructField(f"__{i}", f.dataType) for i, f in enumerate(docs.schema)])
    return rows.mapInArrow(run, schema).toDF(*docs.columns)


def near_duplicate_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_dup_words, spans ("start:end" in words, comma-joined) and match_ids (documents that have them
    earlier; of a document with a null id, its key).  All links are named, whose number grows with the square of a group."""
    return listed(report(docs, merged(passages(docs, id_col=id_col, text_col=text_col, **options)), id_col, text_col))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The same words and spans, and class_id: the least id (or key) of the documents that links connect with this one, itself
    included.  Of its links match_ids names some that connect the same documents, so that the rows grow with the documents."""
    found = cut(merged(passages(docs, id_col=id_col, text_col=text_col, links=False, **options)))
    node = F.struct("doc", "tag")
    classes = components(found.select(node.alias("u"), F.explode("matches").alias("v"))).select("node.doc", "node.tag", F.col("root.doc").alias("class_id"))
    # A document that has the passages first has no spans; where it isn't the least of its class, it has a class.
    both = found.join(classes, ["doc", "tag"], "full")
    return listed(report(docs, both, id_col, text_col))


def listed(rows: DataFrame) -> DataFrame:
    """Rows of ``report`` with the spans as text."""
    at = F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1)
    pairs = F.when(F.size("spans") > 0, F.transform(at, lambda i: F.struct(F.get("spans", 2 * i).alias("s"), F.get("spans", 2 * i + 1).alias("e"))))
    none = F.array().cast("array<long>")
    more = [c for c in rows.columns if c == "class_id"]
    rows = rows.select(F.col("__id").alias("doc_id"), F.coalesce(pairs, F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("p"), F.coalesce("match_ids", none).alias("match_ids"), *more)
    words = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    text = F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"))), ",")
    return rows.select("doc_id", words.alias("n_dup_words"), text.alias("spans"), "match_ids", *more)
