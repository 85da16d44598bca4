"""Numbering, status and checks of books that lack something."""

from pyspark.sql import functions as F

from pagewright.operators import pages as PG
from pagewright.operators import status as ST


def test_labels_and_offsets(spark):
    """Ten pages a book; folios on some, catalogues on others."""
    books = {
        "blank one": (None, ["i", " ", *map(str, range(1, 9))]), "roman only": (None, ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"]), "all blank": (range(10), [" "] * 10), "too short": (range(10), ["1"]),
        "folios": (range(10), None), "few folios": ([7, 8], None), "nothing": ([], None), "nulls": (None, ["1", None, *["3"] * 8]),
    }
    pages = [(b, i, str(i - 2) if folios is not None and i in folios and i > 2 else None) for b, (folios, _) in books.items() for i in range(10)]
    labels = [(b, i, x) for b, (_, given) in books.items() for i, x in enumerate(given or [])]
    p, given = spark.createDataFrame(pages, "book string, pdf_index int, folio string"), spark.createDataFrame(labels, "book string, pdf_index int, label string")
    numbering = PG.resolve_labels(p, given)
    assert {r.book: (r.method, r.offset) for r in numbering.collect()} == {
        "blank one": ("pdf_page_labels", 1), "roman only": ("pdf_page_labels", 0), "all blank": ("footer_regex_offset", 2), "too short": ("footer_regex_offset", 2),
        "folios": ("footer_regex_offset", 2), "few folios": ("fallback_sequential", 0), "nothing": ("fallback_sequential", 0), "nulls": ("pdf_page_labels", -1),
    }
    got = {(r.book, r.pdf_index): (r.printed_page, r.is_front_matter) for r in PG.printed_pages(p, numbering, given).collect()}
    assert got["blank one", 1] == ("", True) and got["blank one", 2] == ("1", False) and got["roman only", 3] == ("iv", True) and got["nulls", 1] == ("", True)
    assert got["all blank", 1] == ("[2]", True) and got["all blank", 9] == ("7", False) and got["nothing", 4] == ("5", False) and got["few folios", 8] == ("9", False)


def test_books_without_summaries_chunks_or_chapters_are_reported(spark):
    pages = spark.createDataFrame(
        [("full", i, [f"line {i}"], i // 5, False, "text") for i in range(10)] + [("bare", i, [] if i > 3 else ["x"], -1, False, "vision") for i in range(10)] + [("front", 0, [], -1, True, "text")],
        "book string, pdf_index int, lines array<string>, chapter_id int, is_front_matter boolean, source string",
    )
    chapters = spark.createDataFrame([("full", 0), ("full", 1), ("full", 2)], "book string, id int")
    long = " ".join(["word"] * 31)
    summaries = spark.createDataFrame([("full", 0, long), ("full", 1, "short")], "book string, chapter_id int, summary string")
    overviews = spark.createDataFrame([("full", "all of it")], "book string, overview string")
    got = {r.book: r.asDict() for r in ST.coverage(pages, chapters, summaries, overviews).collect()}
    assert set(got) == {"full", "bare", "front"}
    assert got["full"] == {"book": "full", "empty_body": 0, "few_empty": True, "chapters": 3, "in_chapter": 1.0, "most_in_chapters": True, "bare_chapters": 1, "summaries": 2, "all_summarised": True, "thin_summaries": 1, "has_overview": True}
    assert (got["bare"]["empty_body"], got["bare"]["few_empty"], got["bare"]["in_chapter"], got["bare"]["summaries"], got["bare"]["all_summarised"], got["bare"]["has_overview"]) == (6, False, 0.0, 0, None, False)
    assert got["front"]["in_chapter"] is None and got["front"]["most_in_chapters"] is None

    books = pages.select("book").distinct()
    numbering = books.select("book", F.lit("fallback_sequential").alias("method"), F.lit(0).alias("offset"))
    margins, methods = books.select("book", F.lit("defaults").alias("note")), books.where("book = 'full'").select("book", F.lit("pdf_outline").alias("method"))
    chunks = spark.createDataFrame([("full", 10)], "book string, chunks long")
    s = {r.book: r for r in ST.book_status(pages, numbering, margins, methods, chapters, chunks, summaries, overviews).collect()}
    assert set(s) == {"full", "bare", "front"}
    assert (s["full"].chapters, s["full"].chunks, s["full"].chapters_summarised, s["full"].overview_words, s["full"].offset_rule) == (3, 10, 2, 3, "pdf index = printed page + 0 (0-based)")
    assert (s["bare"].pages, s["bare"].pages_with_text, s["bare"].chapters, s["bare"].chunks, s["bare"].chapters_summarised, s["bare"].extraction) == (10, 4, 0, 0, None, "vision")
