"""Float grids on disk: a text header beside little-endian 32-bit rows from the top; and run encodings.

A grid is one file, or a folder of part files, each of so many rows and named by its first one, which tasks write and
read side by side on any store that all executors reach.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Header:
    ncols: int
    nrows: int
    xll: float
    yll: float
    cellsize: float
    nodata: float = -9999.0

    @property
    def ymax(self) -> float:
        return self.yll + self.nrows * self.cellsize


def parse_header(text: str) -> Header:
    """The first six values by their order, whatever their names."""
    v = [line.split()[1] for line in text.splitlines() if len(line.split()) >= 2][:6]
    if len(v) < 6:
        raise ValueError("a grid header needs six values")
    return Header(int(v[0]), int(v[1]), *map(float, v[2:6]))


def format_header(h: Header, binary: bool = True) -> str:
    names = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "NODATA_value")
    lines = [f"{n:<14}{v:g}" if isinstance(v, float) and v == int(v) else f"{n:<14}{v!r}" for n, v in zip(names, (h.ncols, h.nrows, h.xll, h.yll, h.cellsize, h.nodata), strict=True)]
    return "\n".join([*lines, *(["byteorder     LSBFIRST"] if binary else [])]) + "\n"


def format_stack_header(h: Header, layers: list[str]) -> str:
    """Header of a stack: that of its grids, the number of layers, and their names."""
    return format_header(h, False) + f"{'nlayers':<14}{len(layers)}\n" + "".join(f"{n}\n" for n in layers)


def parse_stack_header(text: str) -> tuple[Header, list[str]]:
    lines = text.splitlines()
    n = int(lines[6].split()[1])
    return parse_header(text), lines[7 : 7 + n]


def read_header(spark: SparkSession, path: str) -> Header:
    """The header beside a grid, read through Spark so that any store does."""
    return parse_header("\n".join(r.value for r in spark.read.text(path.removesuffix(".flt") + ".hdr", wholetext=True).collect()))


CELL = "row int, col int, value float"


def cells_of(raw: bytes, first: int, h: Header) -> pa.RecordBatch:
    """Cells of whole rows, of which the first has that number; NODATA and NaN are null."""
    v = np.frombuffer(raw, "<f4")
    n = len(v) // h.ncols
    row, col = np.repeat(np.arange(first, first + n, dtype=np.int32), h.ncols), np.tile(np.arange(h.ncols, dtype=np.int32), n)
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(v, mask=(v == np.float32(h.nodata)) | np.isnan(v))], ["row", "col", "value"])


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of one grid file; NODATA is null.

    The file is read as fixed-length records, one a grid row, so a large grid is split over tasks.
    """
    h = read_header(spark, path)
    records = spark.sparkContext.binaryRecords(path, 4 * h.ncols).zipWithIndex().toDF("raw binary, row long")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = b.column(1).to_numpy()
            breaks = np.flatnonzero(np.diff(rows) != 1) + 1
            raw = b.column(0).to_pylist()
            for lo, hi in zip([0, *breaks], [*breaks, len(raw)], strict=True):
                if hi > lo:
                    yield cells_of(b"".join(raw[lo:hi]), int(rows[lo]), h)

    return records.mapInArrow(run, CELL)


def read_grid_parts(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of a grid that ``write_grid_parts`` wrote; each part file is a task's."""
    h = parse_header("\n".join(r.value for r in spark.read.text(f"{path}/header.txt", wholetext=True).collect()))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "rows-*.flt").load(path).select("path", "content")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield cells_of(raw, int(name.rsplit("rows-", 1)[1].split(".")[0]), h)

    return files.mapInArrow(run, CELL)


def write_grid_parts(cells: DataFrame, h: Header, path: str, value: str = "value", rows_per_part: int = 256) -> int:
    """Write a grid as part files of so many rows, each by the task that holds it, and a header; the number of files.

    ``path`` is a folder on a store that executors reach (a URI, or a path that they share).  Cells that are missing, null
    or NaN are NODATA, those outside of the grid are left out, of several for one place any one stays; a task that
    runs again writes the same files.
    """
    spark = cells.sparkSession
    store, folder = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    store.create_dir(folder, recursive=True)
    inside = (F.col("row") >= 0) & (F.col("row") < h.nrows) & (F.col("col") >= 0) & (F.col("col") < h.ncols)
    held = cells.where(inside).select(F.floor(F.col("row") / rows_per_part).cast("int").alias("part"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("float").alias("v"))
    parts = -(-h.nrows // rows_per_part)
    # A part without cells is written too.
    marks = spark.range(parts).select(F.col("id").cast("int").alias("part"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), F.lit(None).cast("float").alias("v"))
    dealt = held.where("v IS NOT NULL").union(marks).repartition("part").sortWithinPartitions("part")

    def write(part: int, lines: np.ndarray) -> None:
        target = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")[0]
        with target.open_output_stream(f"{folder}/rows-{part * rows_per_part:010d}.flt") as out:
            out.write(lines.tobytes())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lines, done = None, None, 0
        for b in it:
            part, row, col, v = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            for p in np.unique(part):
                if p != now:
                    if now is not None:
                        write(now, lines)
                        done += 1
                    now, n = int(p), min(rows_per_part, h.nrows - int(p) * rows_per_part)
                    lines = np.full((n, h.ncols), h.nodata, "<f4")
                on = (part == p) & ~np.isnan(v)
                lines[row[on].astype(int) - now * rows_per_part, col[on].astype(int)] = v[on]
        if now is not None:
            write(now, lines)
            done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    n = dealt.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    with store.open_output_stream(f"{folder}/header.txt") as out:
        out.write(format_header(h).encode())
    return int(n)


def read_stack(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Layers side by side, joined on (row, col)."""
    out = None
    for name, path in paths.items():
        one = read_grid(spark, path).withColumnRenamed("value", name)
        out = one if out is None else out.join(one, ["row", "col"], "full_outer")
    return out


def write_grid(cells: DataFrame, h: Header, path: str, value: str = "value") -> None:
    """Write one .flt and .hdr for tools that want a single file, on the driver's own disk.

    Part files are written beside it by tasks where a shared folder is given to ``write_grid_parts``; here rows stream to
    the driver a partition at a time, in order, which is the way for grids of a size to hand on.
    """
    held = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("float").alias("v")).where("v IS NOT NULL")
    packed = held.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "v"))).alias("c")).select("row", "c.col", "c.v")
    at, empty = 0, np.full(h.ncols, h.nodata, "<f4").tobytes()
    with open(path, "wb") as f:
        for r in packed.repartitionByRange("row").sortWithinPartitions("row").toLocalIterator():
            f.write(empty * (r.row - at))
            line = np.full(h.ncols, h.nodata, "<f4")
            line[r.col] = r.v
            f.write(line.tobytes())
            at = r.row + 1
        f.write(empty * (h.nrows - at))
    with open(path.removesuffix(".flt") + ".hdr", "w") as f:
        f.write(format_header(h))


def runs(cells: DataFrame, value: str | Sequence[str] = "value", largest: int = 32_000, zeros: Sequence[str] = ()) -> DataFrame:
    """(row, start, length, payload): runs of cells with and without values along each row; ``length`` is
    negative, and the payload empty, where there are none; runs are cut at ``largest`` cells.

    ``value`` may name several layers of a stack: the first tells where there are values, and the payload has the
    layers' values cell by cell.  Layers in ``zeros`` have no grid and count as 0.  Integer layers
    are written as floats.
    """
    layers = [value] if isinstance(value, str) else list(value)
    layer = lambda c: F.lit(0.0).cast("float") if c in zeros else F.col(c).cast("float")
    payload: Column = layer(layers[0]) if len(layers) == 1 else F.array(*map(layer, layers))
    if len(layers) == 1 and layers[0] not in zeros:
        payload = F.when(F.col(layers[0]).isNotNull(), F.col(layers[0]).cast("float") if dict(cells.dtypes)[layers[0]] in ("int", "bigint", "smallint") else F.col(layers[0]))
    w = Window.partitionBy("row").orderBy("col")
    filled = layer(layers[0]).isNotNull()
    marked = cells.select("row", "col", payload.alias("v"), filled.alias("f"))
    new = (F.lag("f").over(w).isNull() | (F.lag("f").over(w) != F.col("f")) | (F.lag("col").over(w) != F.col("col") - 1)).cast("int")
    marked = marked.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    at = F.row_number().over(Window.partitionBy("row", "run").orderBy("col")) - 1
    parts = marked.withColumn("piece", F.floor(at / largest))
    out = parts.groupBy("row", "run", "piece").agg(F.min("col").alias("start"), F.first("f").alias("f"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("f"), F.struct("col", "v")))).alias("p"))
    values = F.transform("p", lambda x: x["v"])
    return out.select("row", "start", F.when(F.col("f"), F.col("n")).otherwise(-F.col("n")).alias("length"), (F.flatten(values) if len(layers) > 1 else values).alias("payload"))


def unrun(rows: DataFrame, layers: int = 1) -> DataFrame:
    """Cells of runs: (row, col, value), or with several layers value as an array (null where there is none)."""
    some = F.col("payload") if layers == 1 else F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda k: F.slice("payload", k * layers + 1, layers))
    kind = "float" if layers == 1 else "array<float>"
    at = F.posexplode(F.when(F.col("length") > 0, some).otherwise(F.transform(F.sequence(F.lit(1), F.abs("length")), lambda _: F.lit(None).cast(kind))))
    return rows.select("row", "start", at.alias("pos", "value")).select("row", (F.col("start") + F.col("pos")).cast("int").alias("col"), "value")


def encode_runs(values: list[float | None], largest: int = 32_000) -> bytes:
    """One line in the compact binary form: 16-bit run lengths, positive ones followed by 32-bit values."""
    out, k = [], 0
    while k < len(values):
        e = k
        while e < len(values) and e - k < largest and (values[e] is None) == (values[k] is None):
            e += 1
        n = e - k
        out.append(np.array(-n if values[k] is None else n, "<i2").tobytes())
        if values[k] is not None:
            out.append(np.array(values[k:e], "<f4").tobytes())
        k = e
    return b"".join([*out, np.array(-32_000, "<i2").tobytes()]) if largest < 32_000 else b"".join(out)


def decode_runs(raw: bytes, largest: int = 32_000) -> list[float | None]:
    out, k = [], 0
    while k < len(raw):
        n = int(np.frombuffer(raw, "<i2", 1, k)[0])
        k += 2
        if largest < 32_000 and n == -32_000:
            break
        if n > 0:
            out += np.frombuffer(raw, "<f4", n, k).tolist()
            k += 4 * n
        else:
            out += [None] * -n
    return out
