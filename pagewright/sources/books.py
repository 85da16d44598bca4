"""Books as Parquet tables, a folder for each book."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(rows: DataFrame, at: str, batch_rows: int = 0) -> None:
    """Replace the books in ``rows`` and leave the others: safe to run again."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book")
    (writer.option("maxRecordsPerFile", batch_rows) if batch_rows else writer).parquet(at)


def replace(rows: DataFrame, books: DataFrame, at: str) -> None:
    """``save`` for tables in which a book of ``books`` (book) may have no row left: its folder is then emptied of rows.

    Each book gets a row, the empty ones one whose other columns are null, which ``load`` and readers by id leave out.
    """
    empty = books.join(rows.select("book").distinct(), "book", "left_anti")
    save(rows.unionByName(empty, allowMissingColumns=True), at)


def load(spark: SparkSession, at: str, book: str) -> DataFrame | None:
    """One book, None if there is none of the name; only its folder is read."""
    try:
        rows = spark.read.parquet(at).where(F.col("book") == book)
    except AnalysisException:
        return None
    return rows if rows.limit(1).count() else None
