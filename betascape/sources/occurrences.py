"""Occurrence downloads: request strings, zipped CSV with an audit, resumable lists, tables with logs."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("occurrenceID", "scientificName", "specificEpithet", "taxonRank", "eventDate")]
    + [T.StructField("year", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in ("decimalLatitude", "decimalLongitude", "coordinateUncertaintyInMeters")]
)


def request_url(base: str, taxon: str, fields: list[str], wkt: str | None = None, flags: list[str] | None = None, email: str | None = None, reason: int = 7) -> str:
    """The query string of a download; it is built, never sent."""
    parts = [f"q={quote(taxon)}", f"fields={quote(','.join(fields))}", f"reasonTypeId={reason}"]
    parts += [f"wkt={quote(wkt)}"] if wkt else []
    parts += [f"qa={quote(','.join(flags))}"] if flags else []
    parts += [f"email={quote(email)}"] if email else []
    return f"{base.rstrip('/')}/occurrences/download?" + "&".join(parts)


def remaining(wanted: DataFrame, done: DataFrame, key: str = "taxon") -> DataFrame:
    """Entries still to be fetched."""
    return wanted.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")


def read_csv(spark: SparkSession, path: str, schema: T.StructType = FIELDS) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False)


def read_zips(spark: SparkSession, path: str, schema: T.StructType = FIELDS) -> tuple[DataFrame, DataFrame]:
    """(records, audit) of the first CSV in each zip; a file that can't be read is an audit row with its error.

    Columns are taken by name; absent ones are null.  Numbers that don't parse are null.
    """
    names = [f.name for f in schema]
    text = T.StructType([T.StructField("file", T.StringType()), T.StructField("error", T.StringType()), *[T.StructField(n, T.StringType()) for n in names]])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path_, raw in zip(pdf.path, pdf.content, strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        first = next(n for n in sorted(z.namelist()) if n.lower().endswith(".csv"))
                        with z.open(first) as f:
                            reader = csv.DictReader(io.TextIOWrapper(f, "utf-8", newline=""))
                            rows = []
                            for r in reader:
                                rows.append([path_, None, *[(r.get(n) or None) for n in names]])
                                if len(rows) == 5000:
                                    yield pd.DataFrame(rows, columns=text.names)
                                    rows = []
                            yield pd.DataFrame(rows, columns=text.names)
                except (OSError, StopIteration, zipfile.BadZipFile, UnicodeDecodeError, csv.Error) as e:
                    yield pd.DataFrame([[path_, f"{type(e).__name__}: {e}", *[None] * len(names)]], columns=text.names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    rows = files.mapInPandas(run, text)
    records = rows.where("error IS NULL").select("file", *[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in schema])
    audit = rows.groupBy("file").agg(F.count_if(F.col("error").isNull()).alias("n_records"), F.max("error").alias("error"))
    all_files = files.select(F.col("path").alias("file"))
    return records, all_files.join(audit, "file", "left").select("file", F.coalesce("n_records", F.lit(0)).alias("n_records"), "error")


def merge_audit(df: DataFrame, source: str) -> DataFrame:
    """Records per source."""
    return df.groupBy(source).agg(F.count("*").alias("n_records"))


def write_stage(before: DataFrame, after: DataFrame, path: str, name: str) -> DataFrame:
    """Write a stage's table as Parquet with a log row (stage, n_before, n_after) beside it."""
    after.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
    spark = after.sparkSession
    log = spark.createDataFrame([(name, before.count(), spark.read.parquet(f"{path.rstrip('/')}/{name}").count())], "stage string, n_before long, n_after long")
    log.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}_log")
    return log


def table_facts(df: DataFrame, column: str) -> DataFrame:
    """Rows, columns and the range of one column."""
    c = F.col(column).cast("double")
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.min(c).alias("min"), F.max(c).alias("max"))


def column_kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, is_number, has_fraction) of columns, from their values: whether all that are there are numbers, and whether any
    has a fraction; of a column without values both are false."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("text")) for c in columns])).alias("x")).select("x.*")
    number = F.expr("try_cast(text AS double)")
    some = rows.where("text IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"), F.bool_and(number.isNotNull()).alias("is_number"), F.coalesce(F.bool_or(number != F.floor(number)), F.lit(False)).alias("has_fraction"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "name string")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return names.join(some, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), no("is_number"), no("has_fraction"))
