"""From laid-out lines to everything that is kept of a book: numbered pages, chapters and chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import patterns as P
from pagewright.operators import chunks as C
from pagewright.operators import pages as PG
from pagewright.sources.settings import Settings


@dataclass(frozen=True)
class Books:
    """``pages`` (with printed_page, chapter and lines), ``chapters`` (book, id, title, start, end), ``numbering`` (book, method, offset), ``margins`` (book, note, ...), ``methods`` (book, method) and ``chunks``."""

    pages: DataFrame
    chapters: DataFrame
    numbering: DataFrame
    margins: DataFrame
    methods: DataFrame
    chunks: DataFrame


def read(lines: DataFrame, labels: DataFrame | None = None, outline: DataFrame | None = None, settings: Settings = Settings()) -> Books:
    """The books of ``lines`` (book, pdf_index, height, seq, text, x0, y0, y1, and filename if known), with catalogue ``labels`` and ``outline`` bookmarks where there are any.

    A page of which every line is blank, or the one line's text null, is a page without lines. Any number of books is read at once.
    """
    spark = lines.sparkSession
    labels = spark.createDataFrame([], "book string, pdf_index int, label string") if labels is None else labels
    outline = spark.createDataFrame([], "book string, level int, title string, page1 int, seq int") if outline is None else outline
    name = F.first("filename", True) if "filename" in lines.columns else F.lit(None).cast("string")
    every = lines.groupBy("book", "pdf_index").agg(name.alias("filename"))
    ordered = PG.reading_order(lines.where("text IS NOT NULL"))
    margins = PG.calibrate_margins(ordered, P.ANY_ARABIC)
    pages = every.join(PG.split_margins(ordered, margins), ["book", "pdf_index"], "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    pages = PG.with_folio(pages)
    numbering = PG.resolve_labels(pages, labels)
    pages = PG.printed_pages(pages, numbering, labels).withColumn("is_index", PG.index_ratio(F.col("lines")) >= P.INDEX_SHARE)
    totals = pages.groupBy("book").agg(F.count("*").cast("int").alias("total"))
    chapters, methods = PG.choose_chapters(PG.chapters_outline(outline, totals), PG.chapters_heading(pages, totals), totals)
    titles = chapters.select("book", F.col("id").alias("chapter_id"), F.col("title").alias("chapter_title"))
    pages = PG.assign_chapters(pages, chapters).join(titles, ["book", "chapter_id"], "left")
    pages = pages.select("book", "filename", "pdf_index", "printed_page", "is_front_matter", "is_index", "chapter_id", F.coalesce("chapter_title", F.lit("")).alias("chapter_title"), F.lit("text").alias("source"), "header", "footer", "lines")
    cut = C.chunk(pages, settings.chunk_chars, settings.chunk_overlap_lines)
    key = F.concat_ws("/", "book", F.lpad(F.col("pdf_index").cast("string"), 9, "0"), F.lpad(F.col("line_start").cast("string"), 9, "0"))
    return Books(pages, chapters, numbering, margins, methods, cut.withColumn("chunk", key))
