"""Files that land: names, replacement, repeats, errors, and what questions find afterwards."""

import os

import pytest
from pyspark.sql import functions as F

from pagewright.operators import models as MD
from pagewright.operators import retrieval as R
from pagewright.plans import ingest
from pagewright.streaming import landing


@pytest.mark.parametrize("path, name", [("file:/a/b/My Book.pdf", "My Book"), ("C:\\x\\..\\etc\\pass wd.txt", "pass wd"), ("/a/../.hidden.pdf", "hidden"), ("/a/<b>&?.tar.gz", "_b_.tar"), ("/x/.pdf", "pdf"), ("/x/", "book"), ("/x/Übung 3", "Übung 3")])
def test_names_are_made_safe(spark, path, name):
    assert spark.createDataFrame([(path,)], "p string").select(landing.book_name(F.col("p"))).first()[0] == name


def strict():
    plain = MD.plain_text

    def parser(content):
        if content.startswith(b"!"):
            raise ValueError("broken file")
        return plain(content)

    return parser


def text(word, pages=6):
    """Pages with a chapter's heading on every third, a number at the foot, and one without text."""
    return "\f".join("\n".join(["A HEAD"] + ["Chapter %d" % (k // 3 + 1)] * (k % 3 == 0) + [f"{word} on page {k}", *["more words"] * 20, str(k + 1)]) if k != 4 else " \n " for k in range(pages)).encode()


def land(spark, library, at, state):
    q = landing.stream(spark, at).writeStream.foreachBatch(library.writer(strict())).option("checkpointLocation", state).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None


def test_files_become_books_and_changed_ones_replace_them(spark, tmp_path):
    at, state = tmp_path / "in", str(tmp_path / "state")
    (at / "sub").mkdir(parents=True)
    library = landing.Library(spark, str(tmp_path / "library"))
    (at / "One.txt").write_bytes(text("whale"))
    (at / "Two.txt").write_bytes(text("ship", 3))
    (at / "bad.txt").write_bytes(b"! no")
    land(spark, library, str(at), state)
    assert {r.book: r.filename for r in library.files().collect()} == {"One": "One.txt", "Two": "Two.txt"}
    assert [(r.filename, r.error) for r in library.errors().collect()] == [("bad.txt", "ValueError: broken file")]
    pages = {(r.book, r.pdf_index): r for r in library.pages().collect()}
    assert len(pages) == 9 and pages["One", 4].lines == [] and pages["One", 3].chapter_title == "Chapter 2" and pages["One", 1].printed_page == "2"
    assert pages["One", 0].lines[:2] == ["Chapter 1", "whale on page 0"] and pages["One", 0].lines[-1] == "more words" and pages["One", 0].filename == "One.txt"
    assert library.chapters().where("id IS NOT NULL").count() == 3 and library.index.generations() == [1]
    # the same content under another name of the same book, in another folder: nothing is done
    (at / "sub" / "One.md").write_bytes(text("whale"))
    os.utime(at / "sub" / "One.md", (2_000_000_000, 2_000_000_000))
    land(spark, library, str(at), state)
    assert library.index.generations() == [1] and library.pages().count() == 9
    # another content: the book is replaced, the other one stays, and open readers still see the old one
    old = library.index.open()
    (at / "sub" / "Two.txt").write_bytes(text("storm", 2))
    os.utime(at / "sub" / "Two.txt", (2_000_000_001, 2_000_000_001))
    land(spark, library, str(at), state)
    assert library.index.generations() == [1, 2]
    assert {(r.book, r["count"]) for r in library.pages().groupBy("book").count().collect()} == {("One", 6), ("Two", 2)}
    words = lambda index: {(r.book, w) for r in index.chunks.collect() for w in ("whale", "ship", "storm") if w in r.text}
    assert words(library.index.open()) == {("One", "whale"), ("Two", "storm")} and words(old) == {("One", "whale"), ("Two", "ship")}
    ask = spark.createDataFrame([("q", "Two", "storm on page 1")], "query_id string, book string, text string")
    assert R.search(library.index.open(), ask, 3)[0].count() == 2
    # a batch that is tried again changes nothing
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(at))
    library.writer(strict())(files.where("path LIKE '%sub/Two%' OR path LIKE '%bad%'"), 0)
    assert library.index.generations() == [1, 2] and library.errors().count() == 1


def test_a_read_book_has_the_pieces_that_the_plan_promises(spark):
    lines = MD.parsed_files(spark.createDataFrame([("b", text("w")), ("blank", b" ")], "book string, content binary"), MD.plain_text).drop("error")
    got = ingest.read(lines)
    assert {(r.book, r.method) for r in got.methods.collect()} == {("b", "heading_regex"), ("blank", "none")}
    assert {(r.book, r.method) for r in got.numbering.collect()} == {("b", "footer_regex_offset"), ("blank", "fallback_sequential")}
    assert got.pages.count() == 7 and got.chunks.where("book = 'blank'").count() == 0 and got.chunks.where("chapter_title = 'Chapter 1'").count() >= 3
