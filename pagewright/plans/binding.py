"""Book tables bound to the shared test tables: books are document sources, pages are documents."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import patterns as P
from pagewright.operators import chunks as C
from pagewright.operators import pages as PG
from pagewright.sources.tables import Files, shared_folder, stamp


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_folder(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """Where this session keeps what it derives from the documents at ``sf_dir``: another folder for each session and each state of the table."""
    of = hashlib.sha256(f"{spark.sparkContext.applicationId} {stamp(spark, f'{sf_dir}/documents.parquet')}".encode()).hexdigest()[:32]
    return shared_folder(spark, f"{kind}-{of}")


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of all books; the first query of a session derives and writes them, all others read them."""
    at = session_folder(spark, sf_dir, "pages")
    if "_SUCCESS" not in Files(spark, at).names(""):
        _book_pages(spark, sf_dir).write.mode("overwrite").option("compression", "zstd").parquet(at)
    return spark.read.parquet(at)


def _placed(d: DataFrame) -> DataFrame:
    """``d`` (book, doc_id, ...) with pdf_index, its place in the book from 0: places in ranges of doc_id and counts of the ranges before, so no task ranks a whole book."""
    ends = d.agg(F.min("doc_id"), F.max("doc_id")).first()
    width = 1 if ends[0] is None else (ends[1] - ends[0]) // 4096 + 1
    ranged = d.withColumn("_range", F.expr(f"doc_id div {width}L"))
    sums = ranged.groupBy("book", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("book").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # 4,097 ranges a book at most
    bases = sums.select("book", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    bases = bases.withColumnsRenamed({"book": "_book", "_range": "_of"})
    inside = F.row_number().over(Window.partitionBy("book", "_range").orderBy("doc_id"))
    rows = ranged.withColumn("_i", inside).join(bases, F.col("book").eqNullSafe(F.col("_book")) & F.col("_range").eqNullSafe(F.col("_of")))
    return rows.select(*d.columns, (F.col("_base") + F.col("_i") - 1).cast("int").alias("pdf_index"))


#: Bytes of text in one file of pages, about. What is derived from pages costs far more than reading them, and files of a few row groups would be as few tasks.
PART_BYTES = 1 << 23


def _book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), "doc_id", "text", *row)
    # places are found on narrow rows; a text moves once at most, when it meets its own
    places = _placed(d.drop("text")).select("_file", "_at", "pdf_index")
    # with fewer parts than the session's, the join would deal both sides anew
    parts = max((d.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    p = d.repartition(parts, "_file", "_at").join(places.repartition(parts, "_file", "_at"), ["_file", "_at"]).withColumn("lines", F.split("text", "\n")).drop("text")
    roman = F.get(F.array(*[F.lit(x) for x in ("i", "ii", "iii", "iv")]), F.col("pdf_index"))
    label = F.when(F.col("pdf_index") < 4, roman).otherwise((F.col("pdf_index") - 3).cast("string"))
    return p.select("book", "doc_id", "pdf_index", label.alias("printed_page"), (F.col("pdf_index") < 4).alias("is_front_matter"), (PG.index_ratio(F.col("lines")) >= P.INDEX_SHARE).alias("is_index"), F.expr("pdf_index div 5").cast("int").alias("chapter_id"), "lines")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = book_pages(spark, sf_dir).groupBy("book", F.col("chapter_id").alias("id")).agg(F.min("pdf_index").alias("start"), F.max("pdf_index").alias("end"))
    return g.withColumn("title", F.concat(F.lit("Chapter "), (F.col("id") + 1).cast("string"), F.lit(". Part of "), "book"))


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bookmark for each chapter, one that is no chapter, and one of the second level."""
    c = chapters(spark, sf_dir)
    rows = F.array(
        F.struct(F.lit(1).alias("level"), F.when(F.col("id") == 0, F.lit("Contents")).otherwise(F.col("title")).alias("title"), F.lit(1).alias("seq")),
        F.struct(F.lit(2).alias("level"), F.concat(F.col("title"), F.lit(" again")).alias("title"), F.lit(2).alias("seq")),
    )
    x = c.select("book", "id", "start", F.explode(rows).alias("r"))
    return x.select("book", "r.level", "r.title", (F.col("start") + 1).alias("page1"), (F.col("id") * 10 + F.col("r.seq")).alias("seq"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book_pages(spark, sf_dir).groupBy("book").agg(F.count("*").cast("int").alias("total"))


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in the catalogue of every other book: one blank among them in every fourth, no arabic one in every eighth."""
    n = F.regexp_extract("book", "([0-9]+)$", 1).try_cast("int")
    label = F.when(n % 8 == 0, F.concat(F.lit("p-"), "printed_page")).when((n % 4 == 2) & (F.col("pdf_index") == 6), " ").otherwise(F.col("printed_page"))
    return book_pages(spark, sf_dir).where(n % 2 == 0).select("book", "pdf_index", label.alias("label"))


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laid-out lines: a head with the folio (bare on every third page), the body, and a foot."""
    p = book_pages(spark, sf_dir).withColumn("n", F.size("lines"))
    head = F.when(F.col("pdf_index") % 3 == 0, F.col("printed_page")).otherwise(F.concat("printed_page", F.lit("   "), F.upper("book")))
    body = F.transform("lines", lambda t, i: F.struct((i + 1).alias("seq"), t.alias("text"), F.lit(72.0).alias("x0"), (F.lit(100.0) + F.lit(800.0) * i / F.col("n")).alias("y0"), (F.lit(100.0) + F.lit(800.0) * (i + 0.5) / F.col("n")).alias("y1")))
    edge = lambda seq, text, y0, y1: F.array(F.struct(seq.alias("seq"), text.alias("text"), F.lit(72.0).alias("x0"), F.lit(y0).alias("y0"), F.lit(y1).alias("y1")))
    rows = F.concat(edge(F.lit(0), head, 78.0, 90.0), body, edge(F.col("n") + 1, F.lit("draft"), 950.0, 962.0))
    return p.select("book", "pdf_index", F.lit(1000.0).alias("height"), F.inline(rows))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.chunk(book_pages(spark, sf_dir))
    return c.withColumn("chunk", F.concat_ws("/", "book", F.lpad(F.col("pdf_index").cast("string"), 9, "0"), F.lpad(F.col("line_start").cast("string"), 9, "0")))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer to the image of each document: its lines as items, in a fence, within prose, bare, or none at all.

    Every fourth answer names its page twice, the first time with a draft; every third names no page.
    """
    d = table(spark, sf_dir, "documents")
    i = lambda k, *values: F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))
    item = lambda t, at: F.struct((at % 3 + 1).alias("panel"), i(at + F.col("doc_id"), "speech", "THOUGHT", " caption ", "sfx", "shout").alias("type"), i(at, "", " Ann ", "Bob").alias("speaker"), F.when(at % 2 == 0, F.replace(t, F.lit(" "), F.lit("  "))).otherwise(F.concat(F.lit(" "), t, F.lit(" "))).alias("text"))
    page = F.when(F.col("doc_id") % 3 == 0, "").otherwise((F.col("doc_id") + 1).cast("string"))
    entry = F.struct(page.alias("page"), F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), item).alias("items"))
    draft = F.struct(page.alias("page"), F.array(F.struct(F.lit(1).alias("panel"), F.lit("speech").alias("type"), F.lit("").alias("speaker"), F.lit("draft").alias("text"))).alias("items"))
    answer = F.to_json(F.struct(F.when(F.col("doc_id") % 4 == 0, F.array(draft, entry)).otherwise(F.array(entry)).alias("pages")))
    k = F.col("doc_id") % 6
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Sure! "), answer, F.lit(" Done."))).when(k == 2, "no json here").when(k == 4, "").otherwise(answer)
    return d.select(F.sha2("text", 256).alias("image_hash"), F.col("doc_id").cast("int").alias("pdf_index"), raw.alias("raw"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each source, an image for each of its documents: single pages, spreads with and without two numbers, scans, covers, strangers.

    Half of the archives of odd sources are strangers, so no name prevails there; every fifth archive has no number of its own.
    """
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), F.expr("doc_id div 20").alias("k"))
    number = F.regexp_extract("source", "([0-9]*)$", 1)
    v, odd = F.col("k") % 10, F.coalesce(F.nullif(number, F.lit("")).cast("int"), F.lit(0)) % 2 == 1
    digits = lambda k: F.lpad((k % 10000).cast("string"), 4, "0")
    plain = F.concat("source", F.lit(" "), digits(F.col("k") + 1))
    inner = F.concat(F.lit("v"), F.expr("k div 10000").cast("string"), F.lit("/"))
    name = (
        F.when((v >= 8) | odd & (v >= 5), F.concat(inner, F.lit("zz"), F.col("k").cast("string"), F.lit("zone.jpg")))
        .when(v == 0, F.concat(inner, plain, F.lit("_"), digits(F.col("k") + 2), F.lit(".jpg")))
        .when(v == 3, F.concat(inner, plain, F.lit(" (scan).jpg")))
        .when(v == 4, F.concat(F.lit("c"), F.col("k").cast("string"), F.lit("/"), "source", F.lit("-000.jpg")))
        .otherwise(F.concat(inner, plain, F.lit(".jpg")))
    )
    archive = F.concat(F.when((number == "") | (number.cast("int") % 5 == 0), "").otherwise(F.concat(number, F.lit(" "))), "source", F.lit(".cbz"))
    return d.select(archive.alias("archive"), name.alias("member"), F.when(v == 0, 1600).when(v == 1, 1500).when(v == 2, 1300).otherwise(800).alias("width"), F.lit(1200).alias("height"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


#: A question for each page, an expression in SQL that both engines read.
ASKED = """CASE pdf_index % 25
  WHEN 0 THEN 'What does page ' || CAST(pdf_index + 1 AS STRING) || ' line ' || CAST(pdf_index % 7 + 1 AS STRING) || ' say?'
  WHEN 1 THEN 'read me line ' || CAST(pdf_index % 7 + 1 AS STRING) || ' of page ' || CAST(pdf_index + 1 AS STRING)
  WHEN 2 THEN 'What happened on page ' || CAST(pdf_index + 1 AS STRING) || '?' WHEN 3 THEN 'Summarize the entire book' WHEN 4 THEN 'What are the main themes?' WHEN 5 THEN left(text, 60)
  WHEN 6 THEN 'Explain chapter ' || CAST(chapter_id + 1 AS STRING) WHEN 7 THEN 'What happens in chapter VII?' WHEN 8 THEN 'What did I just ask you?'
  WHEN 9 THEN 'pages ' || CAST(pdf_index + 1 AS STRING) || ' to ' || CAST(pdf_index + 7 AS STRING) WHEN 10 THEN 'pages ' || CAST(pdf_index + 29 AS STRING) || '-' || CAST(pdf_index + 1 AS STRING)
  WHEN 11 THEN 'page ' || CAST(pdf_index + 1 AS STRING) || ', ' || CAST(pdf_index + 3 AS STRING) || ' and ' || CAST(pdf_index + 108 AS STRING)
  WHEN 12 THEN 'pages ' || CAST(pdf_index + 1 AS STRING) || ' through ' || CAST(pdf_index + 91 AS STRING) WHEN 13 THEN 'what is on pg. ' || CAST(pdf_index + 1 AS STRING)
  WHEN 14 THEN 'line ' || CAST(pdf_index % 7 + 1 AS STRING) || ' from p. ' || CAST(pdf_index + 1 AS STRING) WHEN 15 THEN 'page number ' || CAST(pdf_index + 4000 AS STRING)
  WHEN 16 THEN 'pages ' || CAST(pdf_index + 4000 AS STRING) || ', ' || CAST(pdf_index + 4001 AS STRING) WHEN 17 THEN '' WHEN 18 THEN 'chapter ' || CAST(chapter_id + 31 AS STRING) || ' overall' WHEN 19 THEN 'Plot summary please'
  WHEN 20 THEN 'my last question was?' WHEN 21 THEN left(text, 25) || '?' WHEN 22 THEN 'and then?' WHEN 23 THEN 'Tell me more about it in chapter ' || CAST(chapter_id + 1 AS STRING) ELSE '   ' END"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each page, to the page's book (now and then to one that isn't there), in a conversation that may or may not have turns."""
    p = book_pages(spark, sf_dir).withColumn("text", F.array_join("lines", "\n"))
    book = F.when(F.col("doc_id") % 97 == 5, "no such book").otherwise(F.col("book"))
    return p.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("question_id"), book.alias("book"), (F.col("doc_id") % 250).alias("conv_id"), F.expr(ASKED).alias("question"))


VISION_RAW = (
    ("h1", 0, '```json\n{"pages":[{"page":"1","items":[{"panel":1,"type":"speech","speaker":"Ann","text":"Hello\\n  there"},{"panel":2,"type":"SFX","speaker":"","text":"BOOM"}]}]}\n```'),
    ("h2", 1, 'Sure! {"pages":[{"page":"2","items":[{"type":"caption","text":"Later   that day"},{"panel":3,"type":"shout","speaker":" Bob ","text":"Run"},{"panel":3,"type":"speech","text":"  "}]}]} Done.'),
    ("h3", 2, "no json here"),
    ("h4", 3, '{"pages":[{"page":"4","items":[{"panel":1,"type":"thought","speaker":"","text":"Hm"}]}]}'),
    ("h5", 4, '{"pages":[{"page":"5","items":[{"panel":1,"type":"sfx","speaker":"","text":"CRASH"}]}]}'),
    ("h6", 5, ""),
    ("h1", 6, '{"pages":[]}'),
)

ARCHIVE_MEMBERS = (
    ("2 Beta.cbz", "x/Beta 02-001.jpg", 800, 1200), ("2 Beta.cbz", "x/Beta 02-002_003.jpg", 1600, 1200), ("2 Beta.cbz", "x/Beta 02-004.jpg", 1500, 1200),
    ("2 Beta.cbz", "x/Beta 02-005.jpg", 800, 1200), ("2 Beta.cbz", "x/zzZone2.jpg", 900, 300),
    ("1 Alpha.cbz", "Alpha 01-000.jpg", 800, 1200), ("1 Alpha.cbz", "Alpha 01-001.jpg", 800, 1200), ("1 Alpha.cbz", "Alpha 01-002_009.jpg", 1600, 1200),
    ("1 Alpha.cbz", "Alpha 01-004 (scan).jpg", 800, 1200), ("1 Alpha.cbz", "Alpha 01-005.jpg", 1210, 1200), ("Gamma.cbz", "cover.jpg", 800, 1200), ("Gamma.cbz", "g1.jpg", 800, 1200),
)

def sql_values(rows: tuple, names: str) -> str:
    """``rows`` as a SQL relation for the oracle."""
    quoted = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(quoted(v) for v in r) + ')' for r in rows)}) AS t({names}))"
