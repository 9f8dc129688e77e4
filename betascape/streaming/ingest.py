"""Streaming ingest of occurrence files: the record filter and running richness, late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str = "1 day", late: str = "2 days", richness: bool = True) -> DataFrame:
    """Records and (approximately) distinct species per window and key; windows close after the watermark.

    An open window's state holds a sketch of its species, unless ``richness`` is not asked for.
    """
    species = [F.approx_count_distinct("species").alias("richness")] if richness else []
    return events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n_records"), *species)


def running_composition(events: DataFrame, time: str, late: str = "2 days") -> DataFrame:
    """Each (site, species) once, the state of old ones dropped after the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(["site", "species"]).select("site", "species")
