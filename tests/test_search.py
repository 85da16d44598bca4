"""Phrases, chapters of pages, cells of vectors and long pages: against plain loops, and by what they read."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import cells as C
from pagewright.operators import chunks
from pagewright.operators import pages as PG
from pagewright.operators import phrases as PH
from pagewright.operators import retrieval as R


@pytest.mark.parametrize("block", [1 << 21, 40])
def test_phrases_equal_a_loop(spark, monkeypatch, block):
    """Phrases inside words, inside each other, across lines, repeated, of other books, null and empty; in one block and in many."""
    monkeypatch.setattr(PH, "BLOCK_CHARS", block)
    r = random.Random(3)
    word = lambda n: "".join(r.choices("abé \n", k=n))
    texts = [(r.choice(["x", "y", None]), i, word(r.randint(0, 60))) for i in range(200)] + [("x", 500, None), ("x", 501, ""), ("x", 7, "again ab"), ("x", 7, "again ab")]
    asked = [(i, r.choice(["x", "y", "z", None]), word(r.randint(0, 6))) for i in range(80)] + [(100, "x", None), (101, "x", "again"), (102, "x", "again"), (102, "x", "again")]
    t = spark.createDataFrame(texts, "book string, pdf_index int, text string").repartition(4)
    p = spark.createDataFrame(asked, "phrase_id int, book string, phrase string")
    want = sorted((k, b, i) for b, i, x in texts for k, s, q in asked if b is not None and b == s and q and x and q in x)
    assert sorted(map(tuple, PH.occurrences(t, p).collect())) == want and len(want) > 500
    everywhere = sorted((k, i) for _, i, x in texts for k, _, q in asked if q and x and q in x)
    assert sorted(map(tuple, PH.occurrences(t, p, scope=(), keys=("pdf_index",)).collect())) == everywhere
    assert PH.occurrences(t, p.where("false")).count() == 0 and PH.occurrences(t.where("false"), p).count() == 0


def test_phrases_join_matches_only(spark):
    """10,000 phrases and 2,000 texts of one book that share 30 matches: no operator makes more rows than texts, phrases or matches."""
    texts = spark.range(2000).select(F.lit("b").alias("book"), F.col("id").cast("int").alias("pdf_index"), F.concat(F.lit("text number "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    asked = spark.range(10_000).select(F.col("id").alias("phrase_id"), F.lit("b").alias("book"), F.when(F.col("id") < 30, F.concat(F.lit(" "), F.col("id").cast("string"), F.lit("."))).otherwise(F.concat(F.lit("absent "), F.col("id").cast("string"))).alias("phrase"))
    df = PH.occurrences(texts, asked)
    assert df.count() == 30
    assert "CartesianProduct" not in df._jdf.queryExecution().toString() and "NestedLoop" not in df._jdf.queryExecution().toString()


def plain_chapters(pages, chapters):
    found = {p: -1 for p in pages}
    for b, i, s, e in chapters:
        if s is not None and e is not None:
            for p in pages:
                if p[0] == b and s <= p[1] <= e:
                    found[p] = max(found[p], i)
    return found


def test_overlapping_chapters_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(PG, "RANGE_PAGES", 8)
    r = random.Random(9)
    pages = [(b, i) for b in "abc" for i in range(120) if r.random() < 0.9]
    chapters = [(r.choice("abd"), i, s, s + r.choice([-1, 0, 3, 7, 8, 9, 50, 10**9])) for i in range(60) for s in [r.randrange(-5, 130)]] + [("a", 99, None, 3), ("a", 98, 3, None), ("a", 5, 16, 23), ("a", 5, 16, 23)]
    df = PG.assign_chapters(spark.createDataFrame(pages, "book string, pdf_index int"), spark.createDataFrame(chapters, "book string, id int, start int, end int"))
    assert {(x.book, x.pdf_index): x.chapter_id for x in df.collect()} == plain_chapters(pages, chapters)


def test_a_book_of_a_million_pages_in_ten_thousand_chapters(spark):
    pages = spark.range(1_000_000).select(F.lit("b").alias("book"), F.col("id").cast("int").alias("pdf_index"))
    chapters = spark.range(10_000).select(F.lit("b").alias("book"), F.col("id").cast("int").alias("id"), (F.col("id") * 100).cast("int").alias("start"), (F.col("id") * 100 + 98).cast("int").alias("end"))
    whole = spark.createDataFrame([("b", -1000 + k, 0, 10**9) for k in range(50)], "book string, id int, start int, end int").where("false")
    got = PG.assign_chapters(pages, chapters.unionByName(whole))
    began = time.time()
    assert got.where("chapter_id <> CASE WHEN pdf_index % 100 = 99 THEN -1 ELSE pdf_index div 100 END").count() == 0 and got.count() == 1_000_000
    assert time.time() - began < 60


def test_long_pages_are_cut_in_linear_time(spark):
    page = spark.range(1).select(F.lit("b").alias("book"), F.lit(0).alias("pdf_index"), F.lit("1").alias("printed_page"), F.lit(False).alias("is_front_matter"), F.lit(False).alias("is_index"), F.lit(0).alias("chapter_id"), F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: F.concat(F.lit("line "), i.cast("string"))).alias("lines"))
    began = time.time()
    got = chunks.chunk(page)
    ends = got.agg(F.count("*").alias("n"), F.max("line_end").alias("last"), F.sum(F.length("body")).alias("chars"), F.max(F.length("body")).alias("most")).first()
    assert ends["last"] == 1_000_000 and ends["most"] <= 900 and ends["n"] > 10_000
    assert time.time() - began < 60


def test_chunk_metadata_comes_from_the_pages(spark):
    page = spark.createDataFrame([("b", 0, "7", False, False, 2, ["[sfx] BOOM", None, "[sfx] x"], "vision", "f.pdf", "Two"), ("b", 1, "8", False, False, -1, ["words"], None, None, None)],
                                 "book string, pdf_index int, printed_page string, is_front_matter boolean, is_index boolean, chapter_id int, lines array<string>, source string, filename string, chapter_title string")
    got = {r.pdf_index: r for r in chunks.chunk(page.withColumn("lines", F.array_compact("lines"))).collect()}
    assert (got[0].is_sfx_only, got[0].source, got[0].filename, got[0].chapter_title, got[0].body) == (True, "vision", "f.pdf", "Two", "[sfx] BOOM\n[sfx] x")
    assert (got[1].is_sfx_only, got[1].source, got[1].filename, got[1].chapter_title) == (False, "text", None, "")
    holes = chunks.chunk(page.where("pdf_index = 0")).first()
    assert holes.body == "[sfx] BOOM\n\n[sfx] x"


@pytest.mark.parametrize("block", [1000, 8])
def test_cells_equal_brute_force_and_read_less(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(R, "QUERY_BLOCK", block)
    rng = np.random.default_rng(11)
    spots = rng.normal(size=(12, 8)) * 3
    x = np.concatenate([spots[i % 12] + rng.normal(size=8) * 0.2 for i in range(2000)]).reshape(-1, 8)
    x[::40] = x[0]  # ties, and a frequent vector
    rows = [(i, [float(v) for v in x[i]]) for i in range(2000)] + [(5000, None), (5001, [1.0] * 3), (5002, [0.0] * 8), (5003, [None] * 8)]
    vectors = spark.createDataFrame(rows, "chunk int, vector array<double>").repartition(6)
    asked = spark.createDataFrame([(f"q{i}", rows[i][1]) for i in range(0, 2000, 50)] + [("zero", [0.0] * 8), ("short", [1.0]), ("null", None)], "query_id string, vector array<double>")
    index = C.Cells(spark, str(tmp_path / "cells")).write(vectors, cells=24, sample=500)
    found, report = index.topk(asked, 10)
    rows_of = lambda df: sorted((r.query_id, r["rank"], r.chunk, r.score) for r in df.collect())
    want = rows_of(R.dense_topk(vectors.withColumn("vector", F.transform("vector", lambda v: F.coalesce(v, F.lit(0.0)))), asked, 10))
    assert rows_of(found) == want and len(want) == 41 * 10
    assert report.pairs == 41 * len(spark.read.parquet(str(tmp_path / "cells" / "balls")).collect()) and report.read < 0.6 * report.pairs
    none = C.Cells(spark, str(tmp_path / "none")).write(vectors.where("false"))
    assert none.topk(asked, 3)[0].count() == 0


def test_queries_of_several_widths(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0, 1.0])], "chunk int, vector array<double>")
    asked = spark.createDataFrame([("two", [1.0, 1.0]), ("three", [0.0, 0.0, 5.0]), ("four", [1.0] * 4)], "query_id string, vector array<double>")
    assert {(r.query_id, r.chunk, r["rank"]) for r in R.dense_topk(vectors, asked, 5).collect()} == {("two", 1, 1), ("two", 0, 2), ("three", 2, 1)}
