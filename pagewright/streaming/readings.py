"""The cache of image readings: raw answers by image, added batch after batch and compacted to the last one of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.sources.versions import Versions

SCHEMA = "image_hash string, raw string, batch long"


def cache(spark: SparkSession, at: str) -> Versions:
    return Versions(spark, at, SCHEMA)


def load(spark: SparkSession, at: str) -> DataFrame:
    """The cache, empty where nothing has been written; files that can't be read are left out."""
    return cache(spark, at).read()


def latest(rows: DataFrame) -> DataFrame:
    """The last answer to each image."""
    return rows.groupBy("image_hash").agg(F.max_by("raw", "batch").alias("raw"))


def writer(at: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: answers (image_hash, raw) are added; a batch that is tried again adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("image_hash", "raw").dropDuplicates(["image_hash"]).withColumn("batch", F.lit(number).cast("long"))
        cache(batch.sparkSession, at).append(rows, f"batch-{number}")

    return write


def compact(spark: SparkSession, at: str) -> int:
    """Leave the last answer to each image; readers of older generations see them until they are vacuumed."""
    return cache(spark, at).compact(lambda rows: rows.groupBy("image_hash").agg(F.max_by("raw", "batch").alias("raw"), F.max("batch").alias("batch")))
