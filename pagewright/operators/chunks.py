"""Line-aligned chunks that never cross a page."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import patterns as P
from pagewright.operators.vision import sounds_only
from pagewright.sources.tables import small_batches


def _spans(sizes: np.ndarray, most: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open spans over lines of these sizes: where each possible span would end is one binary search on the running sums, then the starts are followed once."""
    n, sums = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
    ends = np.maximum(np.searchsorted(sums, sums[:-1] + most, side="right") - 1, np.arange(1, n + 1)).tolist()
    out, s = [], 0
    while s < n:
        out.append((s, ends[s]))
        if ends[s] >= n:
            break
        s = max(ends[s] - overlap, s + 1)
    return out


#: Characters of pieces that a worker holds as strings before they become Arrow arrays.
HELD_CHARS = 1 << 20


def pieces(lines: Column, most: int = P.CHUNK_CHARS, overlap: int = P.CHUNK_OVERLAP_LINES) -> Column:
    """array<struct<s, e, body>> of half-open line spans and their lines, joined by newlines; null lines are empty.

    A span is closed before the line that would take it past ``most`` characters (a newline counted for
    each line) and the next begins ``overlap`` lines before its end, one line on at least.
    """

    def cut(pages: pa.Array) -> pa.Array:
        flat = pages.flatten()
        flat = pc.fill_null(flat, "") if flat.null_count else flat
        sizes = np.asarray(pc.utf8_length(flat), dtype=np.int64) + 1
        counts = np.asarray(pc.fill_null(pc.list_value_length(pages), 0))
        made, first = [], 0
        ends, s, e, body, held = [0], [], [], [], 0

        def close() -> None:
            held_ = pa.StructArray.from_arrays([pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(body, pa.string())], ["s", "e", "body"])
            made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held_))

        for n in counts.tolist():
            text = flat.slice(first, n).to_pylist()
            for a, b in _spans(sizes[first : first + n], most, overlap):
                s.append(a)
                e.append(b)
                body.append("\n".join(text[a:b]))
                held += len(body[-1])
            ends.append(len(s))
            first += n
            if held > HELD_CHARS:
                close()
                ends, s, e, body, held = [0], [], [], [], 0
        close()
        del flat
        return pa.concat_arrays(made)

    return F.arrow_udf(cut, "array<struct<s:int,e:int,body:string>>")(lines)


def chunk(pages: DataFrame, most: int = P.CHUNK_CHARS, overlap: int = P.CHUNK_OVERLAP_LINES) -> DataFrame:
    """Chunks of ``pages`` with header, body, text (header and body) and their metadata.

    ``filename``, ``source`` and ``chapter_title`` come from the pages where they have such columns, else they are null, ``text`` and empty.
    """
    given = lambda c, other: (F.coalesce(c, other) if c in pages.columns else other).alias(c)
    page = small_batches(pages).select(
        "book", "pdf_index", "printed_page", "is_front_matter", "is_index", "chapter_id", "lines",
        given("filename", F.lit(None).cast("string")), given("source", F.lit("text")), given("chapter_title", F.lit("")),
    )
    page = page.withColumn("is_sfx_only", (F.col("source") == "vision") & sounds_only(F.col("lines"))).withColumn("_p", pieces(F.col("lines"), most, overlap)).drop("lines")
    # the outer form: for the other one Spark tests the size of _p before, and to that end cuts every page twice
    rows = page.select("*", F.inline_outer("_p")).where("s IS NOT NULL").drop("_p")
    header = F.format_string("[Source: PDF Viewer Page %d | Printed Page %s | Lines %d-%d | %s]", F.col("pdf_index") + 1, F.col("printed_page"), F.col("s") + 1, F.col("e"), F.col("book"))
    number = F.when(F.rlike("printed_page", F.lit("^[0-9]+$")), F.expr("try_cast(printed_page AS INT)")).otherwise(-1)
    out = rows.select(
        "book", "filename", "pdf_index", (F.col("pdf_index") + 1).alias("pdf_viewer_page"), "printed_page", number.alias("printed_page_num"),
        (F.col("s") + 1).alias("line_start"), F.col("e").alias("line_end"), "is_front_matter", "is_index", "is_sfx_only", "chapter_id", "chapter_title", "source",
        header.alias("header"), "body",
    )
    return out.withColumn("text", F.concat("header", F.lit("\n"), "body"))
