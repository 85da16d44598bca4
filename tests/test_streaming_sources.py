import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright.operators import limits
from pagewright.sources import archives, books
from pagewright.sources.settings import Settings
from pagewright.streaming import limiter, summaries


def test_stream_limiter_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival"))
    cut = events.agg(F.percentile_approx("arrival", 0.5)).first()[0]
    for k, part in enumerate((events.where(F.col("arrival") < cut), events.where(F.col("arrival") >= cut))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = limiter.token_bucket(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 10, 2).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
        q.awaitTermination()
        assert q.exception() is None, k
    got = {(r.key, r.seq): r.granted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.key, r.seq): r.granted for r in limits.token_bucket(events, 10, 2).collect()}


def test_summary_cache(spark, tmp_path):
    at = str(tmp_path / "cache")
    write = summaries.writer(at)
    one = spark.createDataFrame([("b", 0, "first text"), ("b", 1, "second text"), ("b", 2, " ")], "book string, chapter_id int, text string")
    write(one, 0)
    write(one, 0)
    assert summaries.load(spark, at).count() == 2
    write(spark.createDataFrame([("b", 0, "changed text")], one.schema), 1)
    assert {(r.chapter_id, r.summary) for r in summaries.latest(summaries.load(spark, at)).collect()} == {(0, "changed text"), (1, "second text")}


def test_a_changed_chapter_costs_one_chapter_and_one_book(spark, tmp_path):
    at = str(tmp_path / "tree")
    write = summaries.writer(at)
    schema = "book string, chapter_id int, text string, title string, span string"
    first = [(b, i, f"text {b} {i}", f"Chapter {i + 1}", f"{i}-{i}") for b in "abc" for i in range(3)]
    write(spark.createDataFrame(first, schema), 0)
    assert summaries.load(spark, at).count() == 9 and summaries.overviews(spark, at).read().count() == 3
    changed = [(b, i, "another text" if (b, i) == ("b", 1) else t, x, s) for b, i, t, x, s in first]
    write(spark.createDataFrame(changed, schema), 1)
    write(spark.createDataFrame(changed, schema), 1)  # tried again
    write(spark.createDataFrame(changed, schema), 2)  # nothing new
    new = summaries.load(spark, at).where("batch >= 1").collect()
    assert [(r.book, r.chapter_id, r.summary) for r in new] == [("b", 1, "another text")]
    tops = summaries.overviews(spark, at)
    assert [(r.book, r.overview) for r in tops.read().where("batch >= 1").collect()] == [("b", "Chapter 1 (pages 0-0): text b 0 Chapter 2 (pages 1-1): another text Chapter 3 (pages 2-2): text b 2")]
    # compaction: the latest rows in one part; who reads an older generation still can, until it is vacuumed
    known = summaries.chapters(spark, at)
    old, want = known.read(), sorted(tuple(r) for r in summaries.latest(known.read()).collect())
    summaries.compact(spark, at)
    assert len(known.parts()) == 1 and known.read().count() == 9 and old.count() == 10 and sorted(tuple(r) for r in summaries.latest(known.read()).collect()) == want
    assert summaries.latest_overviews(tops.read()).count() == tops.read().count() == 3
    assert len(known.vacuum()) == 3 and len(known.generations()) == 1 and known.read().count() == 9
    write(spark.createDataFrame([("b", 1, "third text", "Chapter 2", "1-1")], schema), 3)
    assert {r.summary for r in summaries.latest(summaries.load(spark, at)).where("book = 'b'").collect()} == {"text b 0", "third text", "text b 2"}


def test_parts_that_are_damaged_or_unfinished_are_left_out(spark, tmp_path):
    from pagewright.streaming import readings

    at = str(tmp_path / "cache")
    write = readings.writer(at)
    for k in range(3):
        write(spark.createDataFrame([("h", f"answer {k}"), (f"h{k}", "x")], "image_hash string, raw string"), k)
    assert readings.load(spark, at).count() == 6 and readings.compact(spark, at) == 4 and readings.load(spark, at).count() == 4
    assert {r.image_hash: r.raw for r in readings.latest(readings.load(spark, at)).collect()}["h"] == "answer 2"
    write(spark.createDataFrame([("late", "y")], "image_hash string, raw string"), 9)
    for f in (tmp_path / "cache" / "parts" / "batch-9").glob("part-*"):
        f.write_bytes(b"no parquet at all")
    for f in (tmp_path / "cache" / "parts" / "batch-9").glob(".part-*.crc"):
        f.unlink()
    assert readings.load(spark, at).count() == 4
    (tmp_path / "cache" / "generations" / "000000000006").write_text("half a li")
    assert len(readings.cache(spark, at).parts()) == 2


def test_books_are_replaced_one_by_one(spark, tmp_path):
    at = str(tmp_path / "books")
    books.save(spark.createDataFrame([("a", 1), ("b", 2)], "book string, n int"), at)
    books.save(spark.createDataFrame([("a", 3)], "book string, n int"), at)
    assert [r.n for r in books.load(spark, at, "a").collect()] == [3] and [r.n for r in books.load(spark, at, "b").collect()] == [2]
    assert books.load(spark, at, "c") is None and books.load(spark, str(tmp_path / "nowhere"), "a") is None


def test_archive_members(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 30, 20)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 40, 50) + b"\0" * 8
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, data in (("b.PNG", png), ("a.jpg", jpeg), ("x.txt", b"no")):
            z.writestr(name, data)
    (tmp_path / "2 one.cbz").write_bytes(held.getvalue())
    got = [tuple(r) for r in archives.whole(archives.members(spark, str(tmp_path / "*.cbz"))).collect()]
    assert got == [("2 one.cbz", "a.jpg", 50, 40), ("2 one.cbz", "b.PNG", 30, 20)]
    assert [tuple(r) for r in archives.inspected(archives.members(spark, str(tmp_path / "*.cbz"))).select("member", "ratio", "landscape", "cover", "declared").collect()] == [("a.jpg", 1.25, True, False, []), ("b.PNG", 1.5, True, False, [])]
    names = spark.createDataFrame([("z.cbz",), ("10 a.cbz",), ("2 b.cbz",)], "archive string")
    assert [r.archive for r in archives.in_order(names).collect()] == ["2 b.cbz", "10 a.cbz", "z.cbz"]


def test_settings():
    s = Settings.read({"CHUNK_CHARS": "100", "HEADER_ZONE": "x", "HYBRID_RETRIEVAL": "No", "REWRITE_FOLLOWUPS": "on"})
    assert (s.chunk_chars, s.header_zone, s.hybrid_retrieval, s.rewrite_followups) == (100, 0.08, False, True)


def test_damaged_archives_give_an_error_and_no_part_of_a_book(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    (tmp_path / "bad.cbz").write_bytes(b"not a zip at all")
    (tmp_path / "notes.txt").write_bytes(b"no archive")
    for name in ("good.cbz", "crc.cbz", "deflated.cbz", "locked.cbz"):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED if name == "deflated.cbz" else zipfile.ZIP_STORED) as z:
            for k in range(5):
                z.writestr(f"p{k}.png", png + bytes([k]) * 400)
    # the third member's bytes change, so its checksum is wrong; a compressed one breaks in the middle; the fourth archive says that it is encrypted
    for name, change in (("crc.cbz", lambda d, at: d[:at] + b"!" + d[at + 1 :]), ("deflated.cbz", lambda d, at: d[:at] + b"\xff\xff\xff" + d[at + 3 :])):
        data = (tmp_path / name).read_bytes()
        at = data.index(b"p2.png") + 6 + (40 if name == "crc.cbz" else 1)
        (tmp_path / name).write_bytes(change(data, at))
    data = bytearray((tmp_path / "locked.cbz").read_bytes())
    for mark, off in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        at = data.find(mark)
        while at >= 0:
            data[at + off] |= 1
            at = data.find(mark, at + 1)
    (tmp_path / "locked.cbz").write_bytes(bytes(data))
    got = archives.members(spark, str(tmp_path))
    assert {r.archive for r in archives.failed(got).collect()} == {"bad.cbz", "notes.txt", "crc.cbz", "deflated.cbz", "locked.cbz"}
    assert sorted(tuple(r) for r in archives.whole(got).collect()) == [("good.cbz", f"p{k}.png", 7, 9) for k in range(5)]
    assert {r.member for r in got.where("error IS NOT NULL").collect()} == {None}


def test_manifest_goes_to_lines_of_json_and_back(spark, small, tmp_path):
    from pagewright.operators import vision
    from pagewright.plans import binding

    pages = vision.manifest(binding.members(spark, small))
    archives.write_manifest(pages, str(tmp_path / "m"))
    back = archives.read_manifest(spark, str(tmp_path / "m"))
    rows = lambda df: sorted(tuple(r[c] for c in ("pdf_page", "issue", "source_image", "from_spread", "declared_page")) for r in df.collect())
    assert rows(back) == rows(pages) and back.count() > 100


def test_answers_on_several_pages_and_their_cache(spark, tmp_path):
    from pagewright.operators import vision
    from pagewright.streaming import readings

    raw = '{"pages":[{"page":"3","items":[{"text":"a"},{"text":"b"}]},{"page":"4","items":[{"text":"c"}]},{"page":"","items":[{"text":"d"}]},{"page":"4","items":[{"text":"e"}]}]}'
    df = spark.createDataFrame([("h", 0, raw)], "image_hash string, pdf_index int, raw string")
    got = {r.pdf_index: r.lines for r in vision.lines(vision.clean_items(df)).collect()}
    assert got == {2: ["unknown: a", "unknown: b"], 3: ["unknown: e"], 0: ["unknown: d"]}
    at = str(tmp_path / "cache")
    assert readings.load(spark, at).count() == 0
    write = readings.writer(at)
    for number in (1, 1, 2):
        write(df.select("image_hash", F.concat("raw", F.lit(f" {number}")).alias("raw")), number)
    cache = readings.load(spark, at)
    assert cache.count() == 2 and readings.latest(cache).collect()[0].raw.endswith(" 2")


def test_calls_are_tried_again_on_quota_errors_only():
    from pagewright.operators import models

    slept, left = [], ["429 retry in 2.5s", "RESOURCE_EXHAUSTED"]

    def call():
        if left:
            raise RuntimeError(left.pop(0))
        return "done"

    passes = []
    assert models.retried(call, lambda: passes.append(1), slept.append) == "done" and slept == [3.5, 10.0] and len(passes) == 3

    def fail(text):
        raise RuntimeError(text)

    for text, waits in (("429", [5.0, 10.0, 20.0]), ("500 broken", [])):
        slept.clear()
        with pytest.raises(RuntimeError, match=text):
            models.retried(lambda t=text: fail(t), sleep=slept.append)
        assert slept == waits
    now = [0.0]
    throttle = models.paced(30, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    times = [(throttle(), now[0])[1] for _ in range(3)]
    assert times == [0.0, 2.0, 4.0]


def test_wait_equals_the_column(spark):
    from pagewright.operators import limits, models

    rows = [(m, a) for m in ("429 retry in 12.5s", "RESOURCE_EXHAUSTED", "429 'retryDelay': '33s'", "429 retry in 400s", "500 broken") for a in range(5)]
    got = spark.createDataFrame(rows, "m string, a int").select("m", "a", limits.retry_delay(F.col("m"), F.col("a")).alias("w")).collect()
    assert [r.w for r in got] == [models.wait_seconds(*r[:2]) for r in got]


def test_follow_ups_are_rewritten_by_a_model(spark):
    from pagewright.operators import models

    rows = [("a", "What about her sister?", "Reader: Who is Ann?"), ("b", "What about her sister?", "Reader: Who is Ann?"), ("c", "What is a while loop in Python?", "Reader: hi"), ("d", "and then?", None), ("e", "and then?", "Reader: x"), ("f", None, None)]
    q = spark.createDataFrame(rows, "question_id string, question string, history string")
    got = {r.question_id: r.asked for r in models.rewritten(q, lambda p, _: '"Who is the sister of Ann?"\nmore' if "sister" in p else "  ", 600_000).collect()}
    assert got == {"a": "Who is the sister of Ann?\"", "b": "Who is the sister of Ann?\"", "c": rows[2][1], "d": "and then?", "e": "and then?", "f": None}


def test_files_are_parsed_into_lines_and_pages_rendered(spark, tmp_path):
    from pagewright.operators import models

    (tmp_path / "my book.txt").write_text("one\ntwo\f\fthree")
    (tmp_path / "other.txt").write_text("\n")
    (tmp_path / "empty.txt").write_text("")
    lines = models.parsed(spark, str(tmp_path), models.plain_text)
    assert [(r.book, r.pdf_index, r.text) for r in lines.orderBy("book", "pdf_index", "seq").collect()] == [("my book", 0, "one"), ("my book", 0, "two"), ("my book", 1, ""), ("my book", 2, "three"), ("other", 0, ""), ("other", 0, "")]
    assert models.parsed(spark, str(tmp_path), models.plain_text, max_pages=1).select("book", "pdf_index").distinct().count() == 2
    assert models.parsed(spark, str(tmp_path), lambda _: iter([(10.0, [])])).where("text IS NULL").count() == 2
    pages = spark.createDataFrame([("b", 0, b"x"), ("b", 1, b"x")], "book string, pdf_index int, content binary")
    images = models.rendered(pages, lambda data, page, edge, quality: data * (page + 1) + f" {edge} {quality}".encode(), 100, 80).orderBy("pdf_index").collect()
    assert [bytes(r.image) for r in images] == [b"x 100 80", b"xx 100 80"] and images[0].image_hash != images[1].image_hash
    sizes = spark.createDataFrame([(3000, 1500), (10, 4000)], "w int, h int").select(*models.fitted(F.col("w"), F.col("h"), 1000), models.halves(F.col("w"), 0.1)).collect()
    assert [tuple(r)[:2] for r in sizes] == [(1000, 500), (3, 1000)] and [tuple(p) for p in sizes[0][2]] == [(0, 1650), (1350, 3000)]


def test_requests_hold_text_and_images(spark):
    import base64
    import json

    from pagewright.operators import models

    image = bytes(range(256))
    row = spark.createDataFrame([("p. 3", [image]), ("p. 4", None)], "pages string, images array<binary>").select(models.message(models.reading_prompt(F.col("pages")), F.col("images")).alias("m")).collect()
    parts = json.loads(row[0].m)
    assert parts[0]["value"].endswith("p. 3") and base64.b64decode(parts[1]["value"].split(",")[1]) == image and len(json.loads(row[1].m)) == 1
