"""Quality scores by a factorisation machine.

Inputs are hashed words (counts scaled to unit length), structure statistics of the text in bins,
and the document's recorded length in bins as metadata; pairs of inputs interact through vectors of
low rank, summed in linear time as half of (square of the sum - sum of squares).  Language, source,
id and labels are never inputs.

The model is fitted on at most ``max_rows`` labelled rows, those of the ids with the least hash
among those whose crc32 of the id as text is not 2 mod 4, one row an id; all documents are scored.

Cases: a null or empty text has structure inputs only, and a score; labels that are null are
ignored, of several for one id the least counts; of several documents of one id the one with the least
text teaches; a table without ``n_chars`` is scored as one of nulls; with one class only in the sample the score is
that class's share; without labels it is 0.5; repeated rows each get a row; an empty table gives an empty result; other
columns are ignored; a null id counts as not held out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from betascape.llm.common import batches, ready, text_bytes

WORDS = 1 << 15
BINS = 16
STRUCTURE = 11
SIZE = WORDS + STRUCTURE * BINS
SYMBOLS = b"#*$%&|<>"


def features(text: bytes, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Input numbers and their values."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    hashed = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (WORDS - 1)
    index, count = np.unique(hashed, return_counts=True)
    value = count / max(1.0, float(np.sqrt((count.astype(float) ** 2).sum())))
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = text.translate(None, b" \t\n\r\x0b\x0c")
    upper = sum(map(text.count, (b"E", b"T", b"A", b"N", b"I", b"O", b"R", b"S")))
    shares = (
        (len(text) - len(text.translate(None, SYMBOLS))) / n,
        (len(text) - len(text.translate(None, b"!?"))) / n,
        (len(text) - len(text.translate(None, b"0123456789"))) / n,
        8 * upper / size,
        1 - len(index) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        len(lines) / n,
        (len(text) - len(text.translate(None, b".,"))) / n,
    )
    bins = [min(BINS - 1, int(s * BINS)) for s in shares]
    bins.append(min(BINS - 1, len(letters) // n))
    bins.append(min(BINS - 1, len(words).bit_length()))
    bins.append(0 if n_chars is None else min(BINS - 1, 1 + max(0, n_chars).bit_length() // 2))
    at = WORDS + np.arange(STRUCTURE) * BINS + np.array(bins)
    return np.concatenate([index, at]), np.concatenate([value, np.full(STRUCTURE, 0.5)])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For rows laid end to end, each of at least one input."""
        v = self.factors[index] * value[:, None]
        total = np.add.reduceat(v, starts)
        squares = np.add.reduceat(v * v, starts)
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + 0.5 * (total**2 - squares).sum(1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 8, epochs: int = 8, rate: float = 0.1, decay: float = 1e-4) -> Machine:
    """Logistic loss, adaptive gradient steps over batches of 128 rows; the same at every run."""
    rng = np.random.default_rng(10)
    share = float(labels.mean()) if len(labels) else 0.5
    m = Machine(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, rank)))
    if not len(labels) or not 0 < share < 1:
        m.factors[:] = 0
        m.bias = 0.0 if not len(labels) else 30 * (2 * share - 1)
        return m
    m.bias = float(np.log(share / (1 - share)))
    seen = [1e-8, np.full(SIZE, 1e-8), np.full((SIZE, rank), 1e-8)]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 128):
            part = order[lo : lo + 128]
            index = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            sizes = np.array([len(rows[i][0]) for i in part])
            starts = np.cumsum(sizes) - sizes
            error = (sigmoid(m.logits(index, value, starts)) - labels[part]) / len(part)
            each = np.repeat(error, sizes)
            v = m.factors[index] * value[:, None]
            total = np.repeat(np.add.reduceat(v, starts), sizes, 0)
            used, place = np.unique(index, return_inverse=True)
            g = np.bincount(place, each * value, len(used)) + decay * m.linear[used]
            step = (each * value)[:, None] * (total - v)
            gv = np.stack([np.bincount(place, step[:, f], len(used)) for f in range(rank)], 1) + decay * m.factors[used]
            gb = float(error.sum())
            seen[0] += gb * gb
            seen[1][used] += g * g
            seen[2][used] += gv * gv
            m.bias -= rate * gb / seen[0] ** 0.5
            m.linear[used] -= rate * g / np.sqrt(seen[1][used])
            m.factors[used] -= rate * gv / np.sqrt(seen[2][used])
    return m


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def inputs(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, n_chars (null where the table has none)."""
    n_chars = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), n_chars.cast("long").alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, label_col: str = "quality") -> Machine:
    """Fit on the labelled rows that the module names; only their inputs go to the driver."""
    ready(docs.sparkSession)
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna()
    chosen = chosen.groupBy("doc_id").agg(F.min("y").alias("y")).where(~held_out())
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # One document an id, so that the bound holds for rows; copies meet before the shuffle.
    rows = inputs(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text", "n_chars")).alias("x")).select("doc_id", "y", "x.*")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ys, texts, chars in batches(rows, "doc_id", "y", "text", "n_chars"):
            f = [features(t, n) for t, n in zip(texts, chars, strict=True)]
            cols = [pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array([x.astype(np.int32).tobytes() for x, _ in f]), pa.array([x.tobytes() for _, x in f])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "y", "i", "x"])

    found = sorted(rows.mapInArrow(run, "doc_id long, y int, i binary, x binary").collect())
    used = [(np.frombuffer(r.i, np.int32), np.frombuffer(r.x, np.float64)) for r in found]
    return fit(used, np.array([float(r.y > 0) for r in found]))


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for ids, texts, chars in batches(rows, "doc_id", "text", "n_chars"):
            out = []
            for t, n in zip(texts, chars, strict=True):
                index, value = features(t, n)
                out.append(m.logits(index, value, np.zeros(1, np.int64)))
            p = sigmoid(np.concatenate(out))
            cols = [pa.array(ids, pa.int64()), pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "predicted"])

    found = inputs(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
