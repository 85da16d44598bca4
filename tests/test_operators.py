"""Fixed cases of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import patterns as P
from pagewright.operators import chunks, conversation, limits, pages, routing, vision
from pagewright.plans import binding as B
from pagewright.operators import retrieval as R

ROUTES = {
    "What does page 34 line 5 say?": ("page_line", 34, 5, None, None),
    "read me line 12 of page 200": ("page_line", 200, 12, None, None),
    "What happened on page 23?": ("page", 23, None, None, None),
    "Summarize the entire book": ("global", None, None, None, None),
    "What are the main themes?": ("global", None, None, None, None),
    "What is the best problem in the book?": ("global", None, None, None, None),
    "Explain chapter 4": ("chapter", None, None, None, "4"),
    "What happens in chapter VII?": ("chapter", None, None, None, "VII"),
    "What did I just ask you?": ("memory", None, None, None, None),
    "Who is the main character?": ("semantic", None, None, None, None),
    "pages 3 to 5": ("pages", None, None, [3, 4, 5], None),
    "pages 12-10": ("pages", None, None, [10, 11, 12], None),
    "page 110, 64 and 171": ("pages", None, None, [64, 110, 171], None),
    "pages 1 through 90": ("page", 1, None, None, None),
    "Step. 5 of it": ("page", 5, None, None, None),
    "Is there a page 12345?": ("page", 1234, None, None, None),
    "": ("semantic", None, None, None, None),
}


def test_routes(spark):
    df = routing.classify(spark.createDataFrame([(q,) for q in ROUTES], "question string"))
    got = {r.question: (r.route.kind, r.route.page, r.route.line, r.route.pages, r.route.chapter) for r in df.collect()}
    assert got == ROUTES


@pytest.mark.parametrize("question, needed", [("What about her sister?", True), ("and then?", True), ("Tell me more", True), ("What is a while loop in Python?", False), ("Summarize chapter 4 of the book", False)])
def test_follow_ups(spark, question, needed):
    df = spark.createDataFrame([(question,)], "q string")
    assert df.select(conversation.needs_rewrite(F.col("q"), F.lit(True))).first()[0] is needed
    assert df.select(conversation.needs_rewrite(F.col("q"), F.lit(False))).first()[0] is False


def greedy(lines, most=900, overlap=2):
    out, s, n = [], 0, len(lines)
    while s < n:
        e, size = s, 0
        while e < n and size + len(lines[e]) + 1 <= most:
            size += len(lines[e]) + 1
            e += 1
        e = max(e, s + 1)
        out.append((s, e))
        if e >= n:
            break
        s = max(e - overlap, s + 1)
    return out


def test_chunks_equal_a_greedy_loop(spark):
    import random

    r = random.Random(1)
    pages_ = [["x" * r.choice([0, 5, 80, 300, 700, 899, 900, 1200]) for _ in range(r.randrange(0, 25))] for _ in range(300)] + [[]]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages_)], "i int, lines array<string>")
    got = {row.i: [(x.s, x.e) for x in row.s] for row in df.select("i", chunks.pieces(F.col("lines")).alias("s")).collect()}
    assert got == {i: greedy(p) for i, p in enumerate(pages_)}


@pytest.mark.parametrize("text, folio", [("34", "34"), (" 007 ", "7"), ("iv", "iv"), ("MIX", "mix"), ("34   A HEAD", "34"), ("A HEAD 35", "35"), ("12345", None), ("word", None), ("", None), (None, None)])
def test_folio(spark, text, folio):
    assert spark.createDataFrame([(text,)], "t string").select(pages.folio(F.col("t"))).first()[0] == folio


def test_modal_offset_ties_go_to_the_first(spark):
    rows = [("b", 0, "5"), ("b", 1, "9"), ("b", 2, "7"), ("b", 3, "11"), ("b", 4, None)]
    got = pages.modal_offset(spark.createDataFrame(rows, "book string, pdf_index int, folio string")).first()
    assert (got.offset, round(got.agreement, 3), got.accepted) == (-5, 0.4, True)


def test_short_pages_count_edge_lines_twice(spark):
    rows = [("b", 0, 100.0, 0, "7", 0.0, 9.0, 0.0), ("b", 0, 100.0, 1, "text", 50.0, 51.0, 0.0), ("b", 1, 100.0, 0, "a b", 30.0, 31.0, 0.0)]
    ordered = pages.reading_order(spark.createDataFrame(rows, "book string, pdf_index int, height double, seq int, text string, y0 double, y1 double, x0 double"))
    got = pages.calibrate_margins(ordered).first()
    assert (round(got.top, 6), got.bottom, got.note) == (0.095, 0.92, "header")


def test_bucket_equals_steps(spark):
    import random

    r = random.Random(2)
    arrivals = sorted(r.randrange(0, 600_000_000) for _ in range(200))
    for capacity in (1, 3):
        df = spark.createDataFrame([("k", i, a) for i, a in enumerate(arrivals)], "key string, seq long, arrival long")
        got = [x.granted for x in limits.token_bucket(df, 10, capacity).orderBy("seq").collect()]
        full = 6_000_000
        level, last, want = float(capacity), None, []
        for a in arrivals:
            now = a if last is None else max(a, last)
            level = min(capacity, level + (now - (last if last is not None else now)) / full)
            if level < 1:
                now += (1 - level) * full
                level = 1.0
            level, last = level - 1, now
            want.append(now)
        assert max(abs(x - y) for x, y in zip(got, want, strict=True)) < 2


def test_archives(spark):
    m = spark.createDataFrame(list(B.ARCHIVE_MEMBERS), "archive string, member string, width int, height int")
    got = [(r.pdf_page, r.source_image, r.declared_page) for r in vision.manifest(m).orderBy("pdf_page").collect()]
    assert got[:4] == [(1, "Alpha 01-001.jpg", 1), (2, "Alpha 01-002_009.jpg", 2), (3, "Alpha 01-002_009.jpg", 3), (4, "Alpha 01-004 (scan).jpg", 4)]
    assert not any("zzZone" in x[1] or "cover" in x[1] or "000" in x[1] for x in got)
    assert [x[0] for x in got] == list(range(1, len(got) + 1))


def test_vision_text(spark):
    raw = spark.createDataFrame(list(B.VISION_RAW), "image_hash string, pdf_index int, raw string")
    got = {r.pdf_index: r.lines for r in vision.pages(raw, vision.clean_items(raw)).collect()}
    assert got[0] == ["Ann: Hello there", "[sfx] BOOM"] and got[1] == ["[caption] Later that day", "Bob: Run"]
    assert got[2] == [] and got[3] == ["unknown (thinking): Hm"] and got[4] == ["[sfx] CRASH"] and got[5] == []


def test_dense_topk_in_blocks_equals_brute_force(spark, monkeypatch):
    """Ties go to the smaller chunk, scopes must agree, zero vectors score 0, and blocks change nothing."""
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (300, 8)).astype(float)
    x[::7] = 0
    rows = [(i, f"b{i % 3}", [float(v) for v in x[i]]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "chunk int, book string, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", b, v) for i, b, v in rows[:23]] + [("none", None, rows[0][2])], "query_id string, book string, vector array<double>")
    want = set()
    for i, b, v in rows[:23]:
        near = sorted((-round(float(np.dot(v, u)), 6), c) for c, d, u in rows if d == b)[:6]
        want |= {(f"q{i}", c, r) for r, (_, c) in enumerate(near, 1)}
    got = lambda: {(r.query_id, r.chunk, r["rank"]) for r in R.dense_topk(vectors, asked, 6, ("book",)).collect()}
    assert got() == want
    monkeypatch.setattr(R, "QUERY_BLOCK", 8)
    assert got() == want
    assert R.dense_topk(vectors, asked.where("false"), 6, ("book",)).count() == 0


def test_index_counts_terms(spark):
    rows = [("b", "c0", "It's it's a A a"), ("b", "c1", ""), ("b", "c2", None), ("b", "c3", "?!")]
    got = {r.chunk: r for r in R.index(spark.createDataFrame(rows, "book string, chunk string, text string"), R.HASHED).collect()}
    assert {t.term: t.tf for t in got["c0"].terms} == {"it's": 2, "a": 3} and got["c0"].dl == 5
    assert all(got[c].dl == 0 and got[c].terms == [] and not any(got[c].vector) for c in ("c1", "c2", "c3"))
    assert sum(v * v for v in got["c0"].vector) == pytest.approx(1)


def test_search_inside_a_chapter(spark):
    rows = [("b", f"c{i}", i // 3, f"common words {'rare' if i in (1, 7) else 'plain'} n{i}") for i in range(9)]
    index = R.index(spark.createDataFrame(rows, "book string, chunk string, chapter_id int, text string"), R.HASHED)
    asked = spark.createDataFrame([("q", "b", 2, "rare")], "query_id string, book string, chapter_id int, text string")
    found = [r.chunk for r in R.search(index, asked, 3, by_chapter=True)[0].orderBy("rank").collect()]
    assert found[0] == "c7" and set(found) == {"c6", "c7", "c8"}
    dense = R.search(index, asked, 2, hybrid=False, by_chapter=True)[0]
    assert dense.count() == 2


def test_margins_and_chapters_of_a_long_book(spark):
    """Page numbers of five digits calibrate margins, and chapters beyond 999 are chapters."""
    line = lambda k, i, text, y: ("b", k, 1000.0, i, text, 72.0, y, y + 12.0)
    rows = [x for k in range(40) for x in (line(k, 0, str(10_000 + k) if k % 3 == 0 else f"{10_000 + k}   B", 78.0), line(k, 1, "one", 200.0), line(k, 2, "two", 300.0), line(k, 3, "draft", 950.0))]
    ordered = pages.reading_order(spark.createDataFrame(rows, "book string, pdf_index int, height double, seq int, text string, x0 double, y0 double, y1 double"))
    got = pages.split_margins(ordered, pages.calibrate_margins(ordered, P.ANY_ARABIC)).orderBy("pdf_index").collect()
    assert [(r.header, r.lines) for r in got[:2]] == [("10000", ["one", "two"]), ("10001   B", ["one", "two"])]
    totals = spark.createDataFrame([("b", 9000)], "book string, total int")
    outline = spark.createDataFrame([("b", 1, f"Chapter {n}. Part of b", n, n) for n in (999, 1000, 12345)], "book string, level int, title string, page1 int, seq int")
    assert [r.start for r in pages.chapters_outline(outline, totals).orderBy("start").collect()] == [998, 999, 12344]
    headed = spark.createDataFrame([("b", n, [f"Chapter {n}. Part of b"]) for n in (999, 1000)], "book string, pdf_index int, lines array<string>")
    assert pages.chapters_heading(headed, totals).count() == 2


def test_pages_are_spread_over_tasks(spark, small, monkeypatch):
    """A table of one row group is one task to read; its pages are not."""
    assert B._book_pages(spark, small).rdd.getNumPartitions() >= 8
    monkeypatch.setattr(B, "PART_BYTES", 1 << 12)
    assert B._book_pages(spark, small).rdd.getNumPartitions() > 8


def test_chapters_are_found_without_pairing_names_and_titles(spark):
    chapters = spark.createDataFrame([("b", n, f"Chapter {n}") for n in range(1, 40)] + [("c", 1, None), ("c", 2, "IV")], "book string, id int, title string")
    wanted = spark.createDataFrame([("b", "3"), ("b", " XII "), ("b", ""), ("b", None), ("c", "4"), ("c", ""), ("d", "1")], "book string, chapter string")
    found = pages.find_chapter(chapters, wanted)
    assert {(r.book, r.chapter): r.chapter_id for r in found.collect()} == {("b", "3"): 3, ("b", " XII "): 12, ("b", ""): 1, ("b", None): None, ("c", "4"): 2, ("c", ""): 2, ("d", "1"): None}
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
