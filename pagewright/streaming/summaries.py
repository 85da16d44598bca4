"""The summary tree over a stream of chapters: what changed is summarised, then the books it changed, and nothing else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import summaries as M
from pagewright.sources.versions import Versions

SCHEMA = "book string, chapter_id int, title string, span string, hash string, summary string, batch long"
OVERVIEWS = "book string, hash string, joined string, overview string, chapters long, batch long"


def chapters(spark: SparkSession, at: str) -> Versions:
    return Versions(spark, f"{at}/chapters", SCHEMA)


def overviews(spark: SparkSession, at: str) -> Versions:
    return Versions(spark, f"{at}/overviews", OVERVIEWS)


def load(spark: SparkSession, at: str) -> DataFrame:
    """All summaries of chapters that were made, empty where nothing has been written; files that can't be read are left out."""
    return chapters(spark, at).read()


def latest(rows: DataFrame) -> DataFrame:
    """The last summary of each chapter."""
    held = [c for c in rows.columns if c not in ("book", "chapter_id")]
    return rows.groupBy("book", "chapter_id").agg(F.max_by(F.struct(*held), "batch").alias("x")).select("book", "chapter_id", "x.*")


def latest_overviews(rows: DataFrame) -> DataFrame:
    return rows.groupBy("book").agg(F.max_by(F.struct("hash", "joined", "overview", "chapters", "batch"), "batch").alias("x")).select("book", "x.*")


def writer(at: str, summarise: Callable[[Column], Column] = M.extractive) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: chapters (book, chapter_id, text, and title and span if known) whose text isn't that of their last summary are summarised.

    Then the overview of each of their books is made anew, unless the joined summaries are those of its last one. So a changed
    chapter costs one chapter and one book. A batch that is tried again makes what is missing of it and nothing twice. Blank chapters are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        given = lambda c: F.col(c) if c in batch.columns else F.lit(None).cast("string").alias(c)
        rows = batch.select("book", "chapter_id", "text", given("title"), given("span")).dropDuplicates(["book", "chapter_id"])
        known, part = chapters(spark, at), f"batch-{number}"
        new = M.delta(rows, latest(known.read())).where("NOT reused")
        stamp = F.lit(number).cast("long").alias("batch")
        known.append(new.select("book", "chapter_id", "title", "span", "hash", summarise(F.col("text")).alias("summary"), stamp), part)
        done = known.read()
        changed = done.where(F.col("batch") == number).select("book").distinct()
        joined = M.rollup(latest(done.join(changed, "book", "left_semi")).withColumns({"title": F.coalesce("title", F.format_string("Chapter %d", F.col("chapter_id") + 1)), "span": F.coalesce("span", F.lit("?"))}))
        tops = overviews(spark, at)
        fresh = joined.join(latest_overviews(tops.read()).select("book", "hash"), ["book", "hash"], "left_anti")
        tops.append(fresh.select("book", "hash", "joined", summarise(F.col("joined")).alias("overview"), "chapters", stamp), part)

    return write


def compact(spark: SparkSession, at: str) -> None:
    """Leave the last summary of each chapter and the last overview of each book; readers of older generations see them until they are vacuumed."""
    chapters(spark, at).compact(lambda rows: latest(rows).select(*rows.columns))
    overviews(spark, at).compact(lambda rows: latest_overviews(rows).select(*rows.columns))
