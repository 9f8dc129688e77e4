"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts have it, for Java's regular expressions.
SPACE = r"[\x20\x09-\x0D]"
#: Elements of an array that are summed one after another.
BLOCK = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the generated tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Let workers find this package, keep Arrow batches of long texts small, and set a checkpoint folder
    if the session names none, which only a session on one machine may leave out."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    context.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    if context.getCheckpointDir() is None:
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, which outlives executors."""
    ready(df.sparkSession)
    return df.checkpoint()


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text; null is empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def batches(rows: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """Python lists of the named columns, batch by batch."""
    for batch in rows:
        if batch.num_rows:
            yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)


def let(value: Column, body) -> Column:
    """``body(value)`` with value evaluated once, which plain substitution does not promise."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """Sums (or what ``op`` does) of each integer and those before it.

    One growing array would be copied for each element; blocks are summed each for itself and then raised by those before.
    """

    def plain(v: Column) -> Column:
        def add(a: Column, x: Column) -> Column:
            return let(op(a["at"], x), lambda y: F.struct(y.alias("at"), F.concat(a["out"], F.array(y)).alias("out")))

        return F.aggregate(v, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), add)["out"]

    def blocked(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: plain(F.slice(v, b * BLOCK + 1, BLOCK)))

        def raised(parts: Column) -> Column:
            tops = running(F.transform(parts, lambda p: F.element_at(p, -1)), op, levels - 1)
            return let(tops, lambda t: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda y: op(F.get(t, i - 1), y))))))

        return let(parts, raised)

    if levels == 1:
        return plain(values)
    return let(values, lambda v: F.when(F.size(v) > BLOCK, blocked(v)).otherwise(plain(v)))
