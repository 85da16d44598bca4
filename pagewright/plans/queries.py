"""Queries over the bound tables, each with the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import patterns as P
from pagewright.operators import answers as A
from pagewright.operators import conversation as V
from pagewright.operators import limits as L
from pagewright.operators import pages as PG
from pagewright.operators import phrases as PH
from pagewright.operators import retrieval as R
from pagewright.operators import routing as Q
from pagewright.operators import status as ST
from pagewright.operators import summaries as M
from pagewright.operators import vision as G
from pagewright.operators.cells import Cells
from pagewright.operators.index import KeptIndex
from pagewright.plans import binding as B
from pagewright.sources import html as H
from pagewright.sources.tables import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_PAGES = f"""
bp AS (SELECT source AS book, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS pdf_index, string_split(text, chr(10)) AS lines FROM documents),
book_pages AS (SELECT *, CASE WHEN pdf_index < 4 THEN ['i', 'ii', 'iii', 'iv'][pdf_index + 1] ELSE CAST(pdf_index - 3 AS VARCHAR) END AS printed_page,
  pdf_index < 4 AS is_front_matter, CAST(pdf_index // 5 AS INT) AS chapter_id, array_to_string(lines, chr(10)) AS text,
  len(lines) >= 8 AND len(list_filter(lines, lambda x: regexp_matches(trim(x), '{P.INDEX_ENTRY}'))) / len(lines) >= 0.4 AS is_index FROM bp),
totals AS (SELECT book, CAST(count(*) AS INT) AS total FROM book_pages GROUP BY book),
chapters AS (SELECT book, chapter_id AS id, min(pdf_index) AS "start", max(pdf_index) AS "end", 'Chapter ' || (chapter_id + 1) || '. Part of ' || book AS title FROM book_pages GROUP BY book, chapter_id)
"""
_LAYOUT = _PAGES + """,
layout AS (
  SELECT book, pdf_index, 1000.0::DOUBLE AS height, 0 AS pos, CASE WHEN pdf_index % 3 = 0 THEN printed_page ELSE printed_page || '   ' || upper(book) END AS text, 78.0::DOUBLE AS y0, 90.0::DOUBLE AS y1 FROM book_pages
  UNION ALL SELECT book, pdf_index, 1000.0, i + 1, t, 100.0::DOUBLE + 800.0::DOUBLE * i / n, 100.0::DOUBLE + 800.0::DOUBLE * (i + 0.5::DOUBLE) / n FROM (SELECT book, pdf_index, len(lines) AS n, unnest(lines) AS t, unnest(range(len(lines))) AS i FROM book_pages)
  UNION ALL SELECT book, pdf_index, 1000.0, len(lines) + 1, 'draft', 950.0, 962.0 FROM book_pages),
ordered AS (SELECT book, pdf_index, height, rtrim(text) AS text, y0, y1, row_number() OVER (PARTITION BY book, pdf_index ORDER BY pos) - 1 AS pos FROM layout WHERE trim(text) <> '')
"""
_CHUNKS = """
sums AS (SELECT book, pdf_index, printed_page, is_front_matter, is_index, chapter_id, lines, len(lines) AS n,
  list_transform(range(0, len(lines) + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE list_sum(list_transform(lines[1:i], lambda x: length(x) + 1)) END) AS c FROM book_pages),
spans AS (
  SELECT *, 0::BIGINT AS s, greatest(1, len(list_filter(c, lambda v: v <= 900)) - 1)::BIGINT AS e FROM sums WHERE n > 0
  UNION ALL
  SELECT * EXCLUDE (s, e, s2), s2 AS s, greatest(s2 + 1, len(list_filter(c, lambda v: v - c[s2 + 1] <= 900)) - 1)::BIGINT AS e
  FROM (SELECT *, greatest(e - 2, s + 1)::BIGINT AS s2 FROM spans WHERE e < n)),
chunks AS (SELECT book, pdf_index, printed_page, is_front_matter, is_index, chapter_id, CAST(s + 1 AS INT) AS line_start, CAST(e AS INT) AS line_end,
  '[Source: PDF Viewer Page ' || (pdf_index + 1) || ' | Printed Page ' || printed_page || ' | Lines ' || (s + 1) || '-' || e || ' | ' || book || ']' AS header, array_to_string(lines[s + 1:e], chr(10)) AS body,
  '[Source: PDF Viewer Page ' || (pdf_index + 1) || ' | Printed Page ' || printed_page || ' | Lines ' || (s + 1) || '-' || e || ' | ' || book || ']' || chr(10) || array_to_string(lines[s + 1:e], chr(10)) AS text,
  book || '/' || lpad(CAST(pdf_index AS VARCHAR), 9, '0') || '/' || lpad(CAST(s + 1 AS VARCHAR), 9, '0') AS chunk FROM spans)
"""
_BM25 = """
toks AS (SELECT book, chunk, regexp_extract_all(lower(text), '[a-z0-9'']+') AS ts FROM chunks WHERE NOT is_index),
stats AS (SELECT book, count(*) AS n, avg(len(ts)) AS avgdl FROM toks GROUP BY book),
post AS (SELECT book, chunk, dl, term, count(*) AS tf FROM (SELECT book, chunk, len(ts) AS dl, unnest(ts) AS term FROM toks) GROUP BY ALL),
df AS (SELECT post.book, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw, any_value(avgdl) AS avgdl FROM post JOIN stats ON stats.book = post.book GROUP BY post.book, term),
idf AS (SELECT book, term, avgdl, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY book) ELSE raw END AS idf FROM df),
questions AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS book, text FROM benchmark),
qt AS (SELECT query_id, book, term, count(*) AS qtf FROM (SELECT query_id, book, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS term FROM questions) GROUP BY ALL),
lex0 AS (SELECT query_id, qt.book, chunk, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt JOIN idf ON idf.book = qt.book AND idf.term = qt.term JOIN post ON post.book = qt.book AND post.term = qt.term GROUP BY query_id, qt.book, chunk),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS rank FROM lex0) WHERE rank <= 40 AND score > 0)
"""


_BOOK = "CAST(regexp_extract(book, '([0-9]+)$', 1) AS INT)"


def query(name: str, sql: str | None = None, ctes: str = "", recursive: bool = False):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (f"WITH {'RECURSIVE ' * recursive}{ctes} " if ctes else "") + sql
        return f

    return add


# ---------------------------------------------------------------- sources
@query("scan_pages", "SELECT book, pdf_index, len(lines) AS n_lines FROM book_pages", _PAGES)
def scan_pages(spark, sf):
    return B.book_pages(spark, sf).select("book", "pdf_index", F.size("lines").alias("n_lines"))


@query("reading_order", "SELECT book, pdf_index, pos, text FROM ordered", _LAYOUT)
def reading_order(spark, sf):
    return PG.reading_order(B.layout(spark, sf)).select("book", "pdf_index", "pos", "text")


@query("html_lines", H.SQL)
def html_lines(spark, sf):
    return H.lines(B.table(spark, sf, "pages"))


@query("corpus_count", "SELECT book, count(*) AS chunks FROM chunks GROUP BY book", _PAGES + "," + _CHUNKS, True)
def corpus_count(spark, sf):
    return B.chunks(spark, sf).groupBy("book").agg(F.count("*").alias("chunks"))


# ---------------------------------------------------------------- margins and numbers
_ZONE = "CASE WHEN y1 <= height * 0.08 THEN 'header' WHEN y0 >= height * 0.92 THEN 'footer' ELSE 'body' END"


@query("split_margins", f"""SELECT book, pdf_index, arg_min(text, pos) FILTER (zone = 'header') AS header, arg_min(text, pos) FILTER (zone = 'footer') AS footer,
  coalesce(list(text ORDER BY pos) FILTER (zone = 'body'), []) AS lines
  FROM (SELECT o.*, CASE WHEN y1 <= height * 0.095 THEN 'header' WHEN y0 >= height * 0.92 THEN 'footer' ELSE 'body' END AS zone FROM ordered o) GROUP BY book, pdf_index""", _LAYOUT)
def split_margins(spark, sf):
    ordered = PG.reading_order(B.layout(spark, sf))
    return PG.split_margins(ordered, PG.calibrate_margins(ordered, P.ANY_ARABIC)).select("book", "pdf_index", "header", "footer", "lines")


def _paged(spark, sf):
    """Pages with margins and folio, from the layout alone."""
    return PG.with_folio(split_margins(spark, sf))


_EDGE = r"""
edge AS (SELECT *, row_number() OVER (PARTITION BY book, pdf_index ORDER BY pos) AS up, row_number() OVER (PARTITION BY book, pdf_index ORDER BY pos DESC) AS down FROM ordered),
cand AS (SELECT * FROM edge WHERE up <= 2 UNION ALL SELECT * FROM edge WHERE down <= 2),
folios AS (SELECT *, y0 / height < 0.5 AS upper FROM cand WHERE regexp_matches(text, '^\s*[0-9]{1,4}\s*$') OR regexp_matches(text, '(?i)^\s*[ivxlcdm]{1,8}\s*$')),
cal AS (SELECT book, count(*) FILTER (upper) AS tops, count(*) FILTER (NOT upper) AS bots, median(y1 / height) FILTER (upper) AS t, median(y0 / height) FILTER (NOT upper) AS b FROM folios GROUP BY book),
seen AS (SELECT book, count(DISTINCT pdf_index) AS seen FROM ordered GROUP BY book),
cal2 AS (SELECT seen.book, coalesce(tops / seen >= 0.25 AND least(t + 0.005, 0.2) > 0.08, false) AS up, coalesce(bots / seen >= 0.25 AND greatest(b - 0.005, 0.8) < 0.92, false) AS down, least(t + 0.005, 0.2) AS t, greatest(b - 0.005, 0.8) AS b FROM seen LEFT JOIN cal ON cal.book = seen.book)
"""


@query("calibrate_margins", """SELECT book, CASE WHEN up THEN t ELSE 0.08 END AS "top", CASE WHEN down THEN b ELSE 0.92 END AS bottom,
  CASE WHEN up AND down THEN 'top and bottom' WHEN up THEN 'header' WHEN down THEN 'footer' ELSE 'defaults' END AS note FROM cal2""", _LAYOUT + "," + _EDGE)
def calibrate_margins(spark, sf):
    return PG.calibrate_margins(PG.reading_order(B.layout(spark, sf)))


@query("margin_probe", f"""SELECT book, pdf_index, pos, {_ZONE} AS zone, text FROM edge JOIN totals USING (book) WHERE pdf_index IN (total // 4, total // 2, 3 * total // 4) AND (up <= 3 OR down <= 3)""", _LAYOUT + "," + _EDGE)
def margin_probe(spark, sf):
    return PG.margin_probe(PG.reading_order(B.layout(spark, sf)))


_FOLIO = r"""CASE WHEN regexp_matches({0}, '^\s*[0-9]{{1,4}}\s*$') THEN CAST(CAST(trim({0}) AS INT) AS VARCHAR) WHEN regexp_matches({0}, '(?i)^\s*[ivxlcdm]{{1,8}}\s*$') THEN lower(trim({0}))
  WHEN regexp_matches(trim({0}), '^[0-9]{{1,4}}\b') THEN CAST(CAST(regexp_extract(trim({0}), '^([0-9]{{1,4}})\b', 1) AS INT) AS VARCHAR) WHEN regexp_matches(trim({0}), '\b[0-9]{{1,4}}$') THEN CAST(CAST(regexp_extract(trim({0}), '\b([0-9]{{1,4}})$', 1) AS INT) AS VARCHAR) END"""


@query("extract_folio", f"SELECT book, pdf_index, pos, {_FOLIO.format('text')} AS folio FROM ordered", _LAYOUT)
def extract_folio(spark, sf):
    return PG.reading_order(B.layout(spark, sf)).select("book", "pdf_index", "pos", PG.folio(F.col("text")).alias("folio"))


#: Folios from the head of each page (the foot has none), the modal offset, catalogue labels, and the numbering that follows from them.
_NUMBERING = _PAGES + rf""",
fol AS (SELECT book, pdf_index, {_FOLIO.format('head')} AS folio FROM (SELECT *, CASE WHEN pdf_index % 3 = 0 THEN printed_page ELSE printed_page || '   ' || upper(book) END AS head FROM book_pages)),
delta AS (SELECT book, pdf_index - CAST(folio AS INT) AS d, count(*) AS n, min(pdf_index) AS first FROM fol WHERE regexp_matches(folio, '^[0-9]+$') GROUP BY ALL),
modal AS (SELECT t.book, m.d AS "offset", coalesce(m.n / total, 0) AS agreement FROM totals t LEFT JOIN (SELECT * FROM delta QUALIFY row_number() OVER (PARTITION BY book ORDER BY n DESC, first) = 1) m ON m.book = t.book),
labels AS (SELECT book, pdf_index, CASE WHEN n % 8 = 0 THEN 'p-' || printed_page WHEN n % 4 = 2 AND pdf_index = 6 THEN ' ' ELSE printed_page END AS label FROM (SELECT *, CAST(regexp_extract(book, '([0-9]+)$', 1) AS INT) AS n FROM book_pages) WHERE n % 2 = 0),
cat AS (SELECT book, count(*) AS labels, bool_or(trim(label) <> '') AS said, min(pdf_index) FILTER (regexp_matches(trim(label), '^[0-9]+$')) AS first FROM labels GROUP BY book),
numbering AS (SELECT t.book, CASE WHEN said AND labels >= total THEN 'pdf_page_labels' WHEN agreement >= 0.3 THEN 'footer_regex_offset' ELSE 'fallback_sequential' END AS method,
  CASE WHEN said AND labels >= total THEN coalesce(cat.first - CAST(trim(l.label) AS INT), 0) WHEN agreement >= 0.3 THEN "offset" ELSE 0 END AS "offset"
  FROM totals t LEFT JOIN cat ON cat.book = t.book LEFT JOIN labels l ON l.book = t.book AND l.pdf_index = cat.first JOIN modal ON modal.book = t.book)"""


@query("modal_offset", 'SELECT book, "offset", agreement, agreement >= 0.3 AS accepted FROM modal', _NUMBERING)
def modal_offset(spark, sf):
    return PG.modal_offset(_paged(spark, sf))


@query("resolve_labels", 'SELECT book, method, "offset" FROM numbering', _NUMBERING)
def resolve_labels(spark, sf):
    return PG.resolve_labels(_paged(spark, sf), B.page_labels(spark, sf))


QUERIES["label_source"] = resolve_labels
ORACLE_SQL["label_source"] = ORACLE_SQL["resolve_labels"]


@query("printed_page", """SELECT book, pdf_index, printed_page, NOT regexp_matches(printed_page, '^[0-9]+$') AS is_front_matter FROM (
  SELECT f.book, f.pdf_index, CASE method WHEN 'pdf_page_labels' THEN trim(label) WHEN 'fallback_sequential' THEN CAST(f.pdf_index + 1 AS VARCHAR)
    ELSE coalesce(folio, CASE WHEN f.pdf_index - "offset" >= 1 THEN CAST(f.pdf_index - "offset" AS VARCHAR) ELSE '[' || (f.pdf_index + 1) || ']' END) END AS printed_page
  FROM fol f JOIN numbering n ON n.book = f.book LEFT JOIN labels l ON l.book = f.book AND l.pdf_index = f.pdf_index)""", _NUMBERING)
def printed_page(spark, sf):
    pages = _paged(spark, sf)
    labels = B.page_labels(spark, sf)
    return PG.printed_pages(pages, PG.resolve_labels(pages, labels), labels).select("book", "pdf_index", "printed_page", "is_front_matter")


@query("front_matter", "SELECT book, count(*) FILTER (is_front_matter) AS front, count(*) FILTER (NOT is_front_matter) AS body FROM book_pages GROUP BY book", _PAGES)
def front_matter(spark, sf):
    return B.book_pages(spark, sf).groupBy("book").agg(F.count_if("is_front_matter").alias("front"), F.count_if(~F.col("is_front_matter")).alias("body"))


@query("index_pages", f"SELECT book, pdf_index, CASE WHEN len(lines) < 8 THEN 0.0 ELSE len(list_filter(lines, lambda x: regexp_matches(trim(x), '{P.INDEX_ENTRY}'))) / len(lines) END AS ratio, is_index FROM book_pages", _PAGES)
def index_pages(spark, sf):
    return B.book_pages(spark, sf).select("book", "pdf_index", PG.index_ratio(F.col("lines")).alias("ratio"), "is_index")


# ---------------------------------------------------------------- lookups
@query("by_printed", "SELECT book, CAST(pdf_index + 1 AS VARCHAR) AS label, CASE WHEN pdf_index + 4 < total THEN pdf_index + 4 END AS found FROM book_pages JOIN totals USING (book)", _PAGES)
def by_printed(spark, sf):
    pages = B.book_pages(spark, sf)
    wanted = pages.select("book", (F.col("pdf_index") + 1).cast("string").alias("label"))
    return PG.by_printed(pages, wanted).select("book", "label", F.col("page.pdf_index").alias("found"))


@query("by_index", "SELECT book, pdf_index, printed_page FROM book_pages WHERE pdf_index = 7", _PAGES)
def by_index(spark, sf):
    return B.book_pages(spark, sf).where("pdf_index = 7").select("book", "pdf_index", "printed_page")


@query("line_at", "SELECT book, printed_page, n, CASE WHEN n >= 1 THEN lines[n] END AS text FROM book_pages CROSS JOIN (VALUES (0), (1), (3), (50)) v(n)", _PAGES)
def line_at(spark, sf):
    p = B.book_pages(spark, sf).withColumn("n", F.explode(F.array(*[F.lit(x) for x in (0, 1, 3, 50)])))
    return p.select("book", "printed_page", "n", PG.line(F.col("lines"), F.col("n")).alias("text"))


@query("body_pages", "SELECT book, pdf_index, printed_page FROM book_pages WHERE NOT is_front_matter", _PAGES)
def body_pages(spark, sf):
    return B.book_pages(spark, sf).where("NOT is_front_matter").select("book", "pdf_index", "printed_page")


@query("chapter_pages", "SELECT book, chapter_id, list(printed_page ORDER BY pdf_index) AS pages FROM book_pages GROUP BY book, chapter_id", _PAGES)
def chapter_pages(spark, sf):
    g = B.book_pages(spark, sf).groupBy("book", "chapter_id").agg(F.sort_array(F.collect_list(F.struct("pdf_index", "printed_page"))).alias("p"))
    return g.select("book", "chapter_id", F.col("p.printed_page").alias("pages"))


_NAMES = ("1", "II", "4", "ix", "99", "of")


@query("find_chapter", f"""SELECT t.book, w.chapter, arg_min(id, (try_, id)) AS chapter_id, arg_min(title, (try_, id)) AS title FROM totals t CROSS JOIN {B.sql_values(tuple((n, n.lower(), o) for n, o in zip(_NAMES, ('i', '2', 'iv', '9', None, None), strict=True)), 'chapter, n0, n1')} w
  LEFT JOIN (SELECT c.*, k.try_, k.name FROM chapters c, (VALUES (0, '1'), (0, 'ii'), (0, '4'), (0, 'ix'), (0, '99'), (0, 'of'), (1, 'i'), (1, '2'), (1, 'iv'), (1, '9')) k(try_, name)) c
  ON c.book = t.book AND ((c.try_ = 0 AND c.name = n0) OR (c.try_ = 1 AND c.name = n1)) AND (contains(lower(title), c.name) OR starts_with(lower(title), 'chapter ' || c.name)) GROUP BY t.book, w.chapter""", _PAGES)
def find_chapter(spark, sf):
    wanted = B.totals(spark, sf).select("book", F.explode(F.array(*[F.lit(n) for n in _NAMES])).alias("chapter"))
    return PG.find_chapter(B.chapters(spark, sf), wanted)


# ---------------------------------------------------------------- chapters
@query("chapters_outline", """SELECT c.book, CAST(id - 1 AS INT) AS id, title, "start", CASE WHEN id = (SELECT max(id) FROM chapters x WHERE x.book = c.book) THEN total - 1 ELSE "end" END AS "end" FROM chapters c JOIN totals t ON t.book = c.book WHERE id > 0""", _PAGES)
def chapters_outline(spark, sf):
    return PG.chapters_outline(B.outline(spark, sf), B.totals(spark, sf))


@query("chapters_heading", """SELECT book, id, title, "start", "end" FROM chapters""", _PAGES)
def chapters_heading(spark, sf):
    pages, c = B.book_pages(spark, sf), B.chapters(spark, sf).select("book", F.col("start").alias("pdf_index"), "title")
    headed = pages.join(c, ["book", "pdf_index"], "left").withColumn("lines", F.when(F.col("title").isNotNull(), F.concat(F.array("title"), "lines")).otherwise(F.col("lines")))
    return PG.chapters_heading(headed, B.totals(spark, sf))


@query("chapter_method", """SELECT book, n, CASE n % 3 WHEN 0 THEN 'pdf_outline' WHEN 1 THEN 'heading_regex' ELSE 'none' END AS method, coalesce(CASE n % 3 WHEN 0 THEN c - 1 WHEN 1 THEN c END, 0) AS chapters
  FROM (SELECT book, CAST(regexp_extract(book, '([0-9]+)$', 1) AS INT) AS n, count(*) AS c FROM chapters GROUP BY book)""", _PAGES)
def chapter_method(spark, sf):
    """A third of the books has an outline, a third headings only, and a third neither."""
    n = F.regexp_extract("book", "([0-9]+)$", 1).try_cast("int")
    headed = chapters_heading(spark, sf).where(n % 3 != 2)
    found, method = PG.choose_chapters(chapters_outline(spark, sf).where(n % 3 == 0), headed, B.totals(spark, sf))
    counts = found.groupBy("book").agg(F.count("*").alias("chapters"))
    return method.join(counts, "book", "left").select("book", n.alias("n"), "method", F.coalesce("chapters", F.lit(0)).alias("chapters"))


@query("assign_chapters", """SELECT p.book, p.pdf_index, CAST(coalesce(max(c.id), 0) - 1 AS INT) AS chapter_id FROM book_pages p LEFT JOIN chapters c ON c.book = p.book AND p.pdf_index BETWEEN c."start" AND c."end" GROUP BY ALL""", _PAGES)
def assign_chapters(spark, sf):
    return PG.assign_chapters(B.book_pages(spark, sf).drop("chapter_id"), chapters_outline(spark, sf)).select("book", "pdf_index", "chapter_id")


_CHAPTER_TEXT = """chapter_texts AS (SELECT book, chapter_id, string_agg(text, chr(10) ORDER BY pdf_index) AS text, arg_min(printed_page, pdf_index) || '-' || arg_max(printed_page, pdf_index) AS span FROM book_pages GROUP BY book, chapter_id)"""


@query("chapter_text", "SELECT book, chapter_id, text FROM chapter_texts", _PAGES + "," + _CHAPTER_TEXT)
def chapter_text(spark, sf):
    return PG.chapter_texts(B.book_pages(spark, sf)).select("book", "chapter_id", "text")


@query("chapter_span", "SELECT book, chapter_id, span FROM chapter_texts", _PAGES + "," + _CHAPTER_TEXT)
def chapter_span(spark, sf):
    return PG.chapter_texts(B.book_pages(spark, sf)).select("book", "chapter_id", "span")


# ---------------------------------------------------------------- chunks
@query("chunk_lines", "SELECT book, pdf_index, line_start, line_end FROM chunks", _PAGES + "," + _CHUNKS, True)
def chunk_lines(spark, sf):
    return B.chunks(spark, sf).select("book", "pdf_index", "line_start", "line_end")


@query("chunk_header", "SELECT chunk, header FROM chunks", _PAGES + "," + _CHUNKS, True)
def chunk_header(spark, sf):
    return B.chunks(spark, sf).select("chunk", "header")


@query("chunk_meta", "SELECT chunk, body, printed_page, CASE WHEN is_front_matter THEN -1 ELSE CAST(printed_page AS INT) END AS printed_page_num, is_front_matter, is_index, chapter_id FROM chunks", _PAGES + "," + _CHUNKS, True)
def chunk_meta(spark, sf):
    return B.chunks(spark, sf).select("chunk", "body", "printed_page", "printed_page_num", "is_front_matter", "is_index", "chapter_id")


@query("chunk_checks", f"""SELECT book, bool_and(line_start <= line_end) AS ordered, bool_and(starts_with(header, '[Source: ')) AS headed,
  count(*) FILTER (length(text) > {P.CHUNK_CHARS + 250} AND line_start < line_end) AS too_long FROM chunks GROUP BY book""", _PAGES + "," + _CHUNKS, True)
def chunk_checks(spark, sf):
    c = B.chunks(spark, sf)
    return c.groupBy("book").agg(F.bool_and(F.col("line_start") <= F.col("line_end")).alias("ordered"), F.bool_and(F.startswith("header", F.lit("[Source: "))).alias("headed"), F.count_if((F.length("text") > P.CHUNK_CHARS + 250) & (F.col("line_start") < F.col("line_end"))).alias("too_long"))


# ---------------------------------------------------------------- retrieval
@query("tokenize", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS n, regexp_extract_all(lower(text), '[a-z0-9'']+')[1] AS first FROM documents")
def tokenize(spark, sf):
    t = B.table(spark, sf, "documents").select("doc_id", R.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.get("t", F.lit(0)).alias("first"))


def _corpus(spark, sf):
    return B.chunks(spark, sf).where("NOT is_index")


_CHUNK_COLUMNS = ("book", "chunk", "pdf_index", "chapter_id", "text")


def _kept_index(spark, sf) -> KeptIndex:
    return KeptIndex(spark, B.session_folder(spark, sf, "index"))


def _index(spark, sf):
    """The searchable chunks: the first query analyses and writes them, all later ones read that index."""
    index = _kept_index(spark, sf)
    if not index.generations():
        index.ingest(_corpus(spark, sf).select(*_CHUNK_COLUMNS))
    return index.open(index.generations()[0])


def _questions(spark, sf):
    return B.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("book"), "text")


@query("bm25_stats", "SELECT book, n, round(avgdl, 6) AS avgdl FROM stats", _PAGES + "," + _CHUNKS + "," + _BM25, True)
def bm25_stats(spark, sf):
    return R.bm25_stats(R.index(_corpus(spark, sf))).withColumn("avgdl", F.round("avgdl", 6))


@query("bm25_topk", "SELECT query_id, chunk, rank, score FROM lex", _PAGES + "," + _CHUNKS + "," + _BM25, True)
def bm25_topk(spark, sf):
    return R.bm25_topk(_index(spark, sf), _questions(spark, sf)).select("query_id", "chunk", "rank", "score")


@query("index_replaced", "SELECT query_id, chunk, rank, score FROM lex", _PAGES + "," + _CHUNKS + "," + _BM25.replace("NOT is_index", f"NOT is_index AND NOT ({_BOOK} % 2 = 1 AND pdf_index % 2 = 1)"), True)
def index_replaced(spark, sf):
    """Lexical search after every odd book was ingested anew with half of its pages."""
    first, index = _index(spark, sf), _kept_index(spark, sf)
    if len(index.generations()) < 2:
        index.ingest(first.chunks.where((F.regexp_extract("book", "([0-9]+)$", 1).try_cast("int") % 2 == 1) & (F.col("pdf_index") % 2 == 0)).select(*_CHUNK_COLUMNS))
    return R.bm25_topk(index.open(), _questions(spark, sf)).select("query_id", "chunk", "rank", "score")


@query("dense_topk", """SELECT query_id, chunk, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS chunk, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 40""")
def dense_topk(spark, sf):
    v = B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk"), F.col("embedding").alias("vector"))
    return R.dense_topk(v, v.where("chunk % 50 = 0").withColumnRenamed("chunk", "query_id")).select("query_id", "chunk", "rank", "score")


@query("dense_cells", ORACLE_SQL["dense_topk"])
def dense_cells(spark, sf):
    """The same search over vectors in cells, most of which need not be read."""
    v = B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk"), F.col("embedding").alias("vector"))
    cells = Cells(spark, shared_folder(spark, f"cells-{uuid.uuid4().hex}")).write(v)
    return cells.topk(v.where("chunk % 50 = 0").withColumnRenamed("chunk", "query_id"))[0].select("query_id", "chunk", "rank", "score")


_EMBED = """list_transform(range(64), lambda b: coalesce(list_sum(list_transform(list_filter({0}, lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 = b), lambda t: CASE WHEN CAST('0x' || substr(md5(t), 9, 1) AS INT) < 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)), 0.0::DOUBLE))"""


@query("hash_embed", f"""SELECT item_id, list_transform(v, lambda x: CASE WHEN n > 0 THEN round(x / n, 6) ELSE 0.0 END) AS v FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (
  SELECT item_id, {_EMBED.format('ts')} AS v FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS ts FROM benchmark)))""")
def hash_embed(spark, sf):
    v = B.table(spark, sf, "benchmark").select("item_id", R.HASHED.passages(F.col("text")).alias("v"))
    return v.select("item_id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


_HYBRID = f"""
vec AS (SELECT book, chunk, list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0.0 END) AS v FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT book, chunk, {_EMBED.format('ts')} AS v FROM toks))),
qvec AS (SELECT query_id, book, list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0.0 END) AS v FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT query_id, book, {_EMBED.format('ts')} AS v FROM (SELECT *, regexp_extract_all(lower(text), '[a-z0-9'']+') AS ts FROM questions)))),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS rank FROM (SELECT query_id, chunk, round(list_dot_product(vec.v, qvec.v), 6) AS score FROM vec JOIN qvec ON qvec.book = vec.book)) WHERE rank <= 40),
fused AS (SELECT query_id, chunk, round(sum(1 / (60 + rank)), 9) AS score, min(d) AS d, min(l) AS l FROM (SELECT query_id, chunk, rank, rank AS d, NULL AS l FROM dense UNION ALL SELECT query_id, chunk, rank, NULL, rank FROM lex) GROUP BY ALL),
top AS (SELECT * FROM (SELECT query_id, chunk, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d NULLS LAST, l, chunk) AS rank FROM fused) WHERE rank <= 12)
"""
_ALL = _PAGES + "," + _CHUNKS + "," + _BM25 + "," + _HYBRID


@query("rrf_fusion", "SELECT query_id, chunk, rank, score FROM top", _ALL, True)
def rrf_fusion(spark, sf):
    return R.search(_index(spark, sf), _questions(spark, sf))[0].select("query_id", "chunk", "rank", "score")


@query("rrf_promoted", "SELECT t.query_id, count(*) FILTER (d.chunk IS NULL) AS promoted FROM top t LEFT JOIN (SELECT * FROM dense WHERE rank <= 12) d ON d.query_id = t.query_id AND d.chunk = t.chunk GROUP BY t.query_id", _ALL, True)
def rrf_promoted(spark, sf):
    return R.promoted(*R.search(_index(spark, sf), _questions(spark, sf)))


@query("context_block", "SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM top JOIN chunks USING (chunk) GROUP BY query_id", _ALL, True)
def context_block(spark, sf):
    index = _index(spark, sf)
    return R.context(R.search(index, _questions(spark, sf))[0], index.chunks)


QUERIES["semantic_context"] = context_block
ORACLE_SQL["semantic_context"] = ORACLE_SQL["context_block"]


@query("hybrid_chapter", """SELECT query_id, chunk, rank FROM (SELECT query_id, chunk, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d NULLS LAST, l, chunk) AS rank FROM (
  SELECT query_id, chunk, round(sum(1 / (60 + rank)), 9) AS score, min(d) AS d, min(l) AS l FROM (
    SELECT query_id, chunk, rank, rank AS d, NULL AS l FROM (SELECT query_id, chunk, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS rank FROM (SELECT query_id, vec.chunk, round(list_dot_product(vec.v, qvec.v), 6) AS score FROM vec JOIN qvec ON qvec.book = vec.book JOIN chunks c ON c.chunk = vec.chunk WHERE c.chapter_id = 1)) WHERE rank <= 40
    UNION ALL SELECT query_id, chunk, rank, NULL, rank FROM (SELECT query_id, lex.chunk, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM lex JOIN chunks c ON c.chunk = lex.chunk WHERE c.chapter_id = 1)) GROUP BY ALL)) WHERE rank <= 12""", _ALL, True)
def hybrid_chapter(spark, sf):
    asked = _questions(spark, sf).withColumn("chapter_id", F.lit(1))
    return R.search(_index(spark, sf), asked, by_chapter=True)[0].select("query_id", "chunk", "rank")


_GOLD = """gold AS (SELECT DISTINCT b.item_id AS query_id, p.book, p.pdf_index FROM benchmark b JOIN book_pages p ON p.book = 'src' || (b.item_id % 20) AND contains(p.text, b.text)),
hits AS (SELECT query_id, min(rank) AS rank FROM top JOIN chunks USING (chunk) JOIN gold USING (query_id, book, pdf_index) GROUP BY query_id),
ranks AS (SELECT g.query_id, h.rank FROM (SELECT DISTINCT query_id FROM gold) g LEFT JOIN hits h ON h.query_id = g.query_id)"""


def _ranks(spark, sf):
    pages = B.book_pages(spark, sf).select("book", "pdf_index", F.array_join("lines", "\n").alias("text"))
    gold = PH.occurrences(pages, _questions(spark, sf).select(F.col("query_id").alias("phrase_id"), "book", F.col("text").alias("phrase"))).withColumnRenamed("phrase_id", "query_id").distinct()
    index = _index(spark, sf)
    ranked = R.search(index, _questions(spark, sf))[0].join(index.chunks.select("chunk", "book", "pdf_index"), "chunk")
    return R.rank_of_hit(ranked, gold)


@query("rank_of_hit", "SELECT query_id, rank FROM ranks", _ALL + "," + _GOLD, True)
def rank_of_hit(spark, sf):
    return _ranks(spark, sf)


@query("eval_metrics", """SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_5,
  round(avg(CASE WHEN rank <= 12 THEN 1.0 ELSE 0.0 END), 6) AS hit_12, round(avg(coalesce(1 / rank, 0.0)), 6) AS mrr FROM ranks""", _ALL + "," + _GOLD, True)
def eval_metrics(spark, sf):
    return R.eval_metrics(_ranks(spark, sf))


@query("eval_misses", "SELECT r.query_id, q.book, left(q.text, 60) AS shown FROM ranks r JOIN questions q ON q.query_id = r.query_id WHERE r.rank IS NULL", _ALL + "," + _GOLD, True)
def eval_misses(spark, sf):
    return R.misses(_ranks(spark, sf), _questions(spark, sf))


# ---------------------------------------------------------------- routing and conversation
def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_ROUTE = f"""
asked AS (SELECT 'd' || doc_id AS question_id, CASE WHEN doc_id % 97 = 5 THEN 'no such book' ELSE book END AS book, doc_id % 250 AS conv_id, {B.ASKED} AS question FROM book_pages),
q AS (SELECT question_id, question FROM asked UNION ALL SELECT 'c' || conv_id || '/' || turn, text FROM conversations),
t AS (SELECT question_id, regexp_replace(coalesce(question, ''), '^\\s+|\\s+$', '', 'g') AS q FROM q),
n AS (SELECT *, TRY_CAST(regexp_extract(q, {_quoted(P.PAGE_RANGE)}, 1) AS INT) AS a, TRY_CAST(regexp_extract(q, {_quoted(P.PAGE_RANGE)}, 2) AS INT) AS b,
  list_sort(list_distinct(list_transform(regexp_extract_all(regexp_extract(q, {_quoted(P.PAGE_LIST)}, 1), '[0-9]{{{{1,4}}}}'), lambda x: CAST(x AS INT)))) AS l FROM t),
k AS (SELECT *, CASE WHEN q = '' THEN 'semantic' WHEN regexp_matches(q, {_quoted(P.PAGE_LINE)}) THEN 'page_line' WHEN regexp_matches(q, {_quoted(P.LINE_PAGE)}) THEN 'line_page'
  WHEN abs(b - a) <= 30 THEN 'range' WHEN len(l) BETWEEN 2 AND 30 THEN 'list' WHEN regexp_matches(q, {_quoted(P.PAGE)}) THEN 'page' WHEN regexp_matches(q, {_quoted(P.MEMORY)}) THEN 'memory'
  WHEN regexp_matches(q, {_quoted('(?i)' + '|'.join(P.GLOBAL))}) THEN 'global' WHEN regexp_matches(q, {_quoted(P.CHAPTER)}) THEN 'chapter' ELSE 'semantic' END AS k FROM n),
r AS (SELECT question_id, CASE k WHEN 'line_page' THEN 'page_line' WHEN 'range' THEN 'pages' WHEN 'list' THEN 'pages' ELSE k END AS kind,
  TRY_CAST(CASE k WHEN 'page_line' THEN regexp_extract(q, {_quoted(P.PAGE_LINE)}, 1) WHEN 'line_page' THEN regexp_extract(q, {_quoted(P.LINE_PAGE)}, 2) WHEN 'page' THEN regexp_extract(q, {_quoted(P.PAGE)}, 1) END AS INT) AS page,
  TRY_CAST(CASE k WHEN 'page_line' THEN regexp_extract(q, {_quoted(P.PAGE_LINE)}, 2) WHEN 'line_page' THEN regexp_extract(q, {_quoted(P.LINE_PAGE)}, 1) END AS INT) AS line,
  CASE k WHEN 'range' THEN list_transform(range(least(a, b), greatest(a, b) + 1), lambda x: CAST(x AS INT)) WHEN 'list' THEN l END AS pages, CASE WHEN k = 'chapter' THEN upper(regexp_extract(q, {_quoted(P.CHAPTER)}, 1)) END AS chapter FROM k)
""".replace("{{", "{").replace("}}", "}")


@query("route_classify", """SELECT *, kind || coalesce(' pages=' || pages[1] || '..' || pages[-1] || ' (' || len(pages) || ')', ' page=' || page, '') || coalesce(' line=' || line, '') || coalesce(' chapter=' || chapter, '') AS shown FROM r""", _PAGES + "," + _ROUTE)
def route_classify(spark, sf):
    said = B.turns(spark, sf).select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("question_id"), F.col("text").alias("question"))
    r = Q.classify(B.asked(spark, sf).select("question_id", "question").unionByName(said))
    return r.select("question_id", F.col("route.kind").alias("kind"), "route.page", "route.line", "route.pages", "route.chapter", Q.route_text(F.col("route")).alias("shown"))


@query("route_pages", "SELECT question_id, unnest(pages) AS page FROM r WHERE kind = 'pages'", _PAGES + "," + _ROUTE)
def route_pages(spark, sf):
    return route_classify(spark, sf).where("kind = 'pages'").select("question_id", F.explode("pages").alias("page"))


@query("needs_rewrite", rf"""SELECT conv_id, turn, turn > first AND q <> '' AND (len(regexp_split_to_array(q, '\s+')) <= 4 OR regexp_matches(q, '{P.CONTINUATION}') OR regexp_matches(q, '{P.PRONOUNS}')) AS needed FROM (
  SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS first, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS q FROM conversations)""")
def needs_rewrite(spark, sf):
    from pyspark.sql import Window

    first = F.min("turn").over(Window.partitionBy("conv_id"))
    return B.turns(spark, sf).select("conv_id", "turn", V.needs_rewrite(F.col("text"), F.col("turn") > first).alias("needed"))


@query("history_window", r"""SELECT conv_id, string_agg((CASE WHEN lower(coalesce(role, 'user')) IN ('user', 'human') THEN 'Reader' ELSE 'Tutor' END) || ': ' || CASE WHEN length(t) > 600 THEN left(t, 600) || ' [...]' ELSE t END, chr(10) ORDER BY turn) AS history
  FROM (SELECT *, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 GROUP BY conv_id""")
def history_window(spark, sf):
    return V.history(B.turns(spark, sf))


@query("history_cap", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 12")
def history_cap(spark, sf):
    return V.capped(B.turns(spark, sf))


@query("last_user_turn", """SELECT conv_id, CASE WHEN max(turn) FILTER (lower(role) IN ('user', 'human')) IS NULL THEN 'There is no earlier question of yours in this conversation.'
  ELSE 'Your previous question was: ' || trim(arg_max(text, turn) FILTER (lower(role) IN ('user', 'human'))) END AS answer FROM conversations GROUP BY conv_id""")
def last_user_turn(spark, sf):
    return V.last_user_turn(B.turns(spark, sf))


@query("rewrite_guard", """SELECT conv_id, turn, CASE WHEN trim(cut) = '' THEN 'original' ELSE cut END AS rewritten FROM (SELECT *, CASE WHEN length(o) > 400 OR contains(o, chr(10)) THEN left(string_split(o, chr(10))[1], 400) ELSE o END AS cut FROM (
  SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), '^"+|"+$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS o FROM conversations))""".replace("\\\\", "\\"))
def rewrite_guard(spark, sf):
    return B.turns(spark, sf).select("conv_id", "turn", V.rewrite_guard(F.lit("original"), F.col("text")).alias("rewritten"))


# ---------------------------------------------------------------- answers
@query("answer_page_line", """SELECT p.book || '/' || p.pdf_index AS question_id, p.book, CASE WHEN f.pdf_index IS NULL THEN 'Page ' || (p.pdf_index + 1) || ' is not among the ' || total || ' pages of this book.'
  WHEN f.lines[3] IS NULL THEN 'Page ' || (p.pdf_index + 1) || ' has ' || len(f.lines) || ' lines; there is no line 3.'
  ELSE 'Page ' || (p.pdf_index + 1) || ', line 3: ' || f.lines[3] || ' (viewer page ' || (f.pdf_index + 1) || ' of ' || len(f.lines) || ' lines)' END AS answer
  FROM book_pages p JOIN totals USING (book) LEFT JOIN book_pages f ON f.book = p.book AND f.printed_page = CAST(p.pdf_index + 1 AS VARCHAR)""", _PAGES)
def answer_page_line(spark, sf):
    pages = B.book_pages(spark, sf)
    asked = pages.select(F.concat("book", F.lit("/"), F.col("pdf_index").cast("string")).alias("question_id"), "book", (F.col("pdf_index") + 1).alias("page"), F.lit(3).alias("line"))
    return A.answer_page_line(asked, pages)


_NUMBERED = "array_to_string(list_transform({0}, lambda t, i: CASE WHEN i <= 999 THEN lpad(CAST(i AS VARCHAR), 3, ' ') ELSE CAST(i AS VARCHAR) END || ' | ' || t), chr(10))"


@query("page_context", f"SELECT book, printed_page, {_NUMBERED.format('lines')} AS context FROM book_pages", _PAGES)
def page_context(spark, sf):
    return B.book_pages(spark, sf).select("book", "printed_page", A.numbered(F.col("lines")).alias("context"))


def _asked_pages(spark, sf):
    """In each book for each page k from 1: pages k, k + 2 and one that is not there."""
    p = B.book_pages(spark, sf)
    return p, p.select(F.concat("book", F.lit("/"), F.col("pdf_index").cast("string")).alias("question_id"), "book", F.array(F.col("pdf_index") + 1, F.col("pdf_index") + 3, F.lit(99999)).alias("pages"))


_PAGES_SQL = f""",asked AS (SELECT book || '/' || pdf_index AS question_id, book, unnest([pdf_index + 1, pdf_index + 3, 99999]) AS p, unnest([0, 1, 2]) AS ord FROM book_pages),
got AS (SELECT a.*, f.pdf_index, '=== PRINTED PAGE ' || f.printed_page || ' ===' || chr(10) || CASE WHEN trim({_NUMBERED.format('f.lines')}) = '' THEN '(this page has no text)' ELSE {_NUMBERED.format('f.lines')} END AS block FROM asked a LEFT JOIN book_pages f ON f.book = a.book AND f.printed_page = CAST(a.p AS VARCHAR))"""


@query("pages_context", "SELECT question_id, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY ord), '') AS context FROM got GROUP BY question_id", _PAGES + _PAGES_SQL)
def pages_context(spark, sf):
    pages, asked = _asked_pages(spark, sf)
    return A.pages_context(asked, pages).select("question_id", "context")


@query("pages_missing", "SELECT question_id, string_agg(CAST(p AS VARCHAR), ', ' ORDER BY ord) FILTER (block IS NULL) AS missing FROM got GROUP BY question_id", _PAGES + _PAGES_SQL)
def pages_missing(spark, sf):
    pages, asked = _asked_pages(spark, sf)
    return A.pages_context(asked, pages).select("question_id", "missing")


# ---------------------------------------------------------------- summaries
_SUMMARY = _CHAPTER_TEXT + r""",
summ AS (SELECT t.book, t.chapter_id, c.title, t.span, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:40], ' ') AS summary, substr(sha256(text), 1, 16) AS hash FROM chapter_texts t JOIN chapters c ON c.book = t.book AND c.id = t.chapter_id WHERE trim(text) <> ''),
roll AS (SELECT book, string_agg(title || ' (pages ' || span || '):' || chr(10) || summary, chr(10) || chr(10) ORDER BY chapter_id) AS joined, count(*) AS chapters FROM summ GROUP BY book)"""


def _summaries(spark, sf):
    t = PG.chapter_texts(B.book_pages(spark, sf)).where("trim(text) <> ''")
    titles = B.chapters(spark, sf).select("book", F.col("id").alias("chapter_id"), "title")
    return t.join(titles, ["book", "chapter_id"]).select("book", "chapter_id", "title", "span", "text", M.extractive(F.col("text")).alias("summary"))


@query("content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def content_hash(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", M.content_hash(F.col("text")).alias("hash"))


@query("summary_delta", "SELECT book, chapter_id, hash, chapter_id % 2 = 0 AS reused FROM summ", _PAGES + "," + _SUMMARY)
def summary_delta(spark, sf):
    t = PG.chapter_texts(B.book_pages(spark, sf))
    cache = t.where("chapter_id % 2 = 0").select("book", "chapter_id", M.content_hash(F.col("text")).alias("hash"))
    return M.delta(t, cache).select("book", "chapter_id", "hash", "reused")


@query("clip_text", "SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 1000) || chr(10) || '[...]' || chr(10) || right(text, 1000) ELSE text END AS clipped FROM documents")
def clip_text(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", M.clip(F.col("text"), 2000).alias("clipped"))


@query("book_rollup", "SELECT book, chapters, substr(sha256(joined), 1, 16) AS hash FROM roll", _PAGES + "," + _SUMMARY)
def book_rollup(spark, sf):
    return M.rollup(_summaries(spark, sf)).select("book", "chapters", "hash")


@query("overview_build", r"""SELECT roll.book, array_to_string(list_filter(regexp_split_to_array(joined, '\s+'), lambda w: w <> '')[1:40], ' ') AS overview,
  (SELECT count(*) FROM summ WHERE summ.book = roll.book AND chapter_id % 2 = 1) + (CASE WHEN length(roll.book) % 2 = 0 THEN 0 ELSE 1 END) AS built,
  (SELECT count(*) FROM summ WHERE summ.book = roll.book AND chapter_id % 2 = 0) + (CASE WHEN length(roll.book) % 2 = 0 THEN 1 ELSE 0 END) AS reused FROM roll""", _PAGES + "," + _SUMMARY)
def overview_build(spark, sf):
    """The cache holds chapters of even number and the overviews of books whose names are of even length."""
    rows = _summaries(spark, sf)
    texts = rows.withColumn("hash", M.content_hash(F.col("text"))).withColumn("reused", F.col("chapter_id") % 2 == 0)
    joined = M.rollup(rows)
    return M.overview(joined, texts, joined.where("length(book) % 2 = 0").select("book", "hash"))


@query("global_context", "SELECT book, joined AS context FROM roll", _PAGES + "," + _SUMMARY)
def global_context(spark, sf):
    return M.rollup(_summaries(spark, sf)).select("book", F.col("joined").alias("context"))


# ---------------------------------------------------------------- vision and archives
_ITEMS = r"""
read AS (SELECT doc_id, sha256(text) AS image_hash, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id % 6 NOT IN (2, 4)),
every AS (SELECT doc_id, image_hash, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM read),
items AS (SELECT image_hash, CAST(doc_id AS INT) AS pdf_index, CAST(i AS INT) AS ord, CAST(i % 3 + 1 AS INT) AS panel, ['speech', 'thought', 'caption', 'sfx', 'speech'][(i + doc_id) % 5 + 1] AS type,
  ['', 'Ann', 'Bob'][i % 3 + 1] AS speaker, trim(regexp_replace(trim(l), '[ \t]{2,}', ' ', 'g')) AS text FROM every WHERE trim(l) <> ''),
seen AS (SELECT pdf_index, list(CASE type WHEN 'caption' THEN '[caption] ' || text WHEN 'sfx' THEN '[sfx] ' || text
  WHEN 'thought' THEN CASE speaker WHEN '' THEN 'unknown' ELSE speaker END || ' (thinking): ' || text ELSE CASE speaker WHEN '' THEN 'unknown' ELSE speaker END || ': ' || text END ORDER BY ord) AS lines FROM items GROUP BY pdf_index),
vision AS (SELECT CAST(doc_id AS INT) AS pdf_index, CAST(doc_id + 1 AS VARCHAR) AS printed_page, coalesce(lines, []) AS lines FROM documents LEFT JOIN seen ON seen.pdf_index = doc_id)
"""


@query("json_lenient", "SELECT sha256(text) AS image_hash, CAST(doc_id AS INT) AS pdf_index, doc_id % 6 NOT IN (2, 4) AS parsed FROM documents")
def json_lenient(spark, sf):
    return B.readings(spark, sf).select("image_hash", "pdf_index", G.parse(F.col("raw"))["pages"].isNotNull().alias("parsed"))


@query("vision_items", "SELECT * FROM items", _ITEMS)
def vision_items(spark, sf):
    return G.clean_items(B.readings(spark, sf))


@query("vision_lines", "SELECT * FROM seen", _ITEMS)
def vision_lines(spark, sf):
    return G.lines(G.clean_items(B.readings(spark, sf)))


@query("vision_pages", "SELECT * FROM vision", _ITEMS)
def vision_pages(spark, sf):
    raw = B.readings(spark, sf)
    return G.pages(raw, G.clean_items(raw))


@query("sfx_only", "SELECT pdf_index, len(lines) > 0 AND len(list_filter(lines, lambda x: NOT starts_with(x, '[sfx]'))) = 0 AS is_sfx_only FROM vision", _ITEMS)
def sfx_only(spark, sf):
    return vision_pages(spark, sf).select("pdf_index", G.sounds_only(F.col("lines")).alias("is_sfx_only"))


@query("top_speakers", "SELECT trim(string_split(line, ':')[1]) AS speaker, count(*) AS n FROM (SELECT unnest(lines) AS line FROM vision) WHERE contains(line, ':') AND NOT starts_with(line, '[') GROUP BY ALL ORDER BY n DESC, speaker LIMIT 10", _ITEMS)
def top_speakers(spark, sf):
    return G.top_speakers(vision_pages(spark, sf))


@query("vision_delta", "SELECT image_hash, count(*) AS images FROM (SELECT sha256(text) AS image_hash, doc_id FROM documents) WHERE doc_id % 3 <> 0 AND image_hash NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY image_hash")
def vision_delta(spark, sf):
    images = B.table(spark, sf, "documents").select(F.sha2("text", 256).alias("image_hash"), F.col("doc_id").alias("pdf_index"))
    _, new = G.pending(images.where("pdf_index % 3 <> 0"), images.where("pdf_index % 3 = 0"))
    return images.where("pdf_index % 3 <> 0").join(new.select("image_hash"), "image_hash").groupBy("image_hash").agg(F.count("*").alias("images"))


_MEMBERS = r"""
am0 AS (SELECT coalesce(source, 'none') AS source, doc_id // 20 AS k, doc_id // 20 % 10 AS v, regexp_extract(coalesce(source, 'none'), '([0-9]*)$', 1) AS num FROM documents),
am1 AS (SELECT *, 'v' || (k // 10000) || '/' AS dir, source || ' ' || lpad(CAST((k + 1) % 10000 AS VARCHAR), 4, '0') AS p, coalesce(CAST(nullif(num, '') AS INT), 0) % 2 = 1 AS odd FROM am0),
am AS (SELECT CASE WHEN num = '' OR CAST(nullif(num, '') AS INT) % 5 = 0 THEN '' ELSE num || ' ' END || source || '.cbz' AS archive,
  CASE WHEN v >= 8 OR odd AND v >= 5 THEN dir || 'zz' || k || 'zone.jpg' WHEN v = 0 THEN dir || p || '_' || lpad(CAST((k + 2) % 10000 AS VARCHAR), 4, '0') || '.jpg'
    WHEN v = 3 THEN dir || p || ' (scan).jpg' WHEN v = 4 THEN 'c' || k || '/' || source || '-000.jpg' ELSE dir || p || '.jpg' END AS member,
  CASE v WHEN 0 THEN 1600 WHEN 1 THEN 1500 WHEN 2 THEN 1300 ELSE 800 END AS width, 1200 AS height FROM am1),
nm AS (SELECT *, regexp_replace(string_split(member, '/')[-1], '\.[^.]*$', '') AS base FROM am),
np AS (SELECT *, trim(regexp_replace(base, '\s*\(.*?\)\s*$', '')) AS plain FROM nm),
ns AS (SELECT *, lower(trim(regexp_replace(plain, '[0-9]{1,4}[a-z]?(_[0-9]{1,4})?$', ''))) AS stem FROM np),
share AS (SELECT archive, stem, count(*) AS n, sum(count(*)) OVER (PARTITION BY archive) AS total, row_number() OVER (PARTITION BY archive ORDER BY count(*) DESC, length(min(lower(member)))) AS place FROM ns GROUP BY archive, stem),
own AS (SELECT ns.* FROM ns JOIN (SELECT * FROM share WHERE place = 1) s ON s.archive = ns.archive WHERE NOT (total >= 4 AND n >= 0.6 * total) OR s.stem = ns.stem),
dp AS (SELECT *, CAST(nullif(regexp_extract(plain, '([0-9]{1,4})_[0-9]{1,4}$', 1), '') AS INT) AS pair, CAST(nullif(regexp_extract(plain, '([0-9]{1,4})$', 1), '') AS INT) AS single FROM own
  WHERE NOT regexp_matches(trim(string_split(base, '-')[-1]), '(?i)^0+[a-z]?(\s*\(.*\))?$') AND NOT regexp_matches(base, '(?i)cover|wraparound')),
sp AS (SELECT *, width > height AND (pair IS NOT NULL OR width / height > 1.15) AS spread FROM dp),
hv AS (SELECT archive, member, spread, 0 AS half, CASE WHEN spread THEN pair ELSE coalesce(pair, single) END AS declared FROM sp UNION ALL SELECT archive, member, spread, 1, pair + 1 FROM sp WHERE spread),
man AS (SELECT row_number() OVER (ORDER BY coalesce(CAST(nullif(regexp_extract(archive, '^\s*([0-9]+)', 1), '') AS BIGINT), 1000000000), lower(archive), lower(member), half) AS pdf_page,
  regexp_replace(archive, '\.[^.]*$', '') AS issue, string_split(member, '/')[-1] AS source_image, spread AS from_spread, declared AS declared_page FROM hv)
"""


@query("archive_dominant", "SELECT archive, member, width, height FROM own", _MEMBERS)
def archive_dominant(spark, sf):
    return G.dominant(B.members(spark, sf))


@query("archive_pages", "SELECT * FROM man", _MEMBERS)
def archive_pages(spark, sf):
    return G.manifest(B.members(spark, sf))


@query("archive_align", "SELECT count(*) FILTER (declared_page = pdf_page) AS aligned, count(declared_page) AS declared FROM man", _MEMBERS)
def archive_align(spark, sf):
    return G.alignment(G.manifest(B.members(spark, sf)))


@query("batch_plan", "SELECT batch, count(*) AS images FROM (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 4 AS batch FROM documents) GROUP BY batch")
def batch_plan(spark, sf):
    """Four pages a request."""
    return G.batches(B.table(spark, sf, "documents").select("doc_id"), 4, "doc_id")


# ---------------------------------------------------------------- limiter, status, checks
_BUCKET = """r AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
g AS (SELECT key, seq, greatest(arrival, coalesce(i * 6000000 + max(arrival - i * 6000000) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), arrival)) AS granted, arrival FROM r)"""


def _granted(spark, sf):
    e = B.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival"))
    return L.token_bucket(e, L.effective_rate())


@query("token_bucket", "SELECT key, seq, granted, granted - arrival AS wait FROM g", _BUCKET)
def token_bucket(spark, sf):
    return _granted(spark, sf).select("key", "seq", "granted", "wait")


@query("bucket_stats", "SELECT key, count(*) AS requests, count(*) FILTER (granted > arrival) AS throttled, CAST(sum(granted - arrival) AS BIGINT) AS total_wait, count(*) FILTER (seq % 7 = 0) AS quota_errors FROM g GROUP BY key", _BUCKET)
def bucket_stats(spark, sf):
    """Every seventh request came back with a quota error, every fifth with another one."""
    error = F.when(F.col("seq") % 7 == 0, "429 retry in 3s").when(F.col("seq") % 5 == 0, "500 broken")
    return L.stats(_granted(spark, sf).withColumn("error", error))


@query("retry_delay", """SELECT seq, message, attempt, CASE WHEN contains(message, '429') OR contains(message, 'RESOURCE_EXHAUSTED') THEN least(coalesce(
  CAST(nullif(regexp_extract(message, 'retry in ([0-9.]+)s', 1), '') AS DOUBLE) + 1, CAST(nullif(regexp_extract(message, '''retryDelay'': ''([0-9]+)s''', 1), '') AS DOUBLE) + 1, 5 * pow(2, attempt)), 65.0) END AS wait
  FROM (SELECT event_id AS seq, CAST(event_id // 4 % 5 AS INT) AS attempt, CASE event_id % 4 WHEN 0 THEN '429 retry in ' || (event_id % 90) || '.5s' WHEN 1 THEN 'RESOURCE_EXHAUSTED'
    WHEN 2 THEN '429 ''retryDelay'': ''' || (event_id % 80) || 's''' ELSE '500 broken' END AS message FROM events)""")
def retry_delay(spark, sf):
    seq = F.col("event_id")
    message = (
        F.when(seq % 4 == 0, F.concat(F.lit("429 retry in "), (seq % 90).cast("string"), F.lit(".5s"))).when(seq % 4 == 1, "RESOURCE_EXHAUSTED")
        .when(seq % 4 == 2, F.concat(F.lit("429 'retryDelay': '"), (seq % 80).cast("string"), F.lit("s'"))).otherwise("500 broken")
    )
    e = B.table(spark, sf, "events").select(seq.alias("seq"), message.alias("message"), F.expr("cast(event_id div 4 % 5 as int)").alias("attempt"))
    return e.withColumn("wait", L.retry_delay(F.col("message"), F.col("attempt")))


_OVERVIEW = r"array_to_string(list_filter(regexp_split_to_array(joined, '\s+'), lambda w: w <> '')[1:40], ' ')"


@query("book_status", rf"""SELECT b.book, b.pages, pages_with_text, extraction, method AS page_numbering, n."offset", CASE WHEN up AND down THEN 'top and bottom' WHEN up THEN 'header' WHEN down THEN 'footer' ELSE 'defaults' END AS margin_bands,
  CASE {_BOOK.replace('book', 'b.book')} % 3 WHEN 0 THEN 'pdf_outline' WHEN 1 THEN 'heading_regex' ELSE 'none' END AS chapter_detection,
  CASE {_BOOK.replace('book', 'b.book')} % 3 WHEN 0 THEN ch - 1 WHEN 1 THEN ch ELSE 0 END AS chapters, coalesce(c.chunks, 0) AS chunks, chapters_summarised, overview_words, 'pdf index = printed page + ' || n."offset" || ' (0-based)' AS offset_rule
  FROM (SELECT book, count(*) AS pages, count(*) FILTER (len(lines) > 0) AS pages_with_text, CASE WHEN {_BOOK} % 4 = 3 THEN 'vision' ELSE 'text' END AS extraction FROM book_pages GROUP BY book) b
  JOIN numbering n ON n.book = b.book JOIN cal2 ON cal2.book = b.book LEFT JOIN (SELECT book, count(*) AS ch FROM chapters GROUP BY book) k ON k.book = b.book
  LEFT JOIN (SELECT book, count(*) AS chunks FROM chunks WHERE {_BOOK} % 7 <> 0 GROUP BY book) c ON c.book = b.book
  LEFT JOIN (SELECT book, chapters AS chapters_summarised, len(list_filter(regexp_split_to_array({_OVERVIEW}, '\s+'), lambda x: x <> '')) AS overview_words FROM roll WHERE {_BOOK} % 5 <> 0) r ON r.book = b.book""",
  _LAYOUT + "," + _EDGE + _NUMBERING.removeprefix(_PAGES) + "," + _CHUNKS + "," + _SUMMARY, True)
def book_status(spark, sf):
    """Every seventh book has no chunks, every fifth no summaries, a third no chapters."""
    n = F.regexp_extract("book", "([0-9]+)$", 1).try_cast("int")
    pages = B.book_pages(spark, sf).withColumn("source", F.when(n % 4 == 3, "vision").otherwise("text"))
    headed = chapters_heading(spark, sf).where(n % 3 != 2)
    chapters, methods = PG.choose_chapters(chapters_outline(spark, sf).where(n % 3 == 0), headed, B.totals(spark, sf))
    s = _summaries(spark, sf).where(n % 5 != 0)
    overviews = M.rollup(s).select("book", M.extractive(F.col("joined")).alias("overview"))
    return ST.book_status(pages, resolve_labels(spark, sf), calibrate_margins(spark, sf), methods, chapters, corpus_count(spark, sf).where(n % 7 != 0), s, overviews)


@query("index_report", """SELECT book, count(*) FILTER (is_front_matter) AS front, count(*) FILTER (NOT is_front_matter) AS body, min(len(lines)) FILTER (NOT is_front_matter) AS least, max(len(lines)) FILTER (NOT is_front_matter) AS most,
  CAST(sum(len(lines)) FILTER (NOT is_front_matter) // count(*) FILTER (NOT is_front_matter) AS BIGINT) AS mean, arg_min(printed_page, pdf_index) FILTER (NOT is_front_matter) AS first FROM book_pages GROUP BY book""", _PAGES)
def index_report(spark, sf):
    body = ~F.col("is_front_matter")
    n = F.when(body, F.size("lines"))
    g = B.book_pages(spark, sf).groupBy("book").agg(F.count_if("is_front_matter").alias("front"), F.count_if(body).alias("body"), F.min(n).alias("least"), F.max(n).alias("most"), F.sum(n).alias("s"), F.min_by(F.when(body, F.col("printed_page")), F.when(body, F.col("pdf_index"))).alias("first"))
    return g.select("book", "front", "body", "least", "most", F.expr("s div body").alias("mean"), "first")


@query("folio_leak", rf"""SELECT book, count(*) FILTER (regexp_matches(lines[1], '{P.ARABIC}') OR regexp_matches(lines[1], '{P.ROMAN}') OR regexp_matches(lines[-1], '{P.ARABIC}') OR regexp_matches(lines[-1], '{P.ROMAN}')) AS leaks, count(*) AS body FROM book_pages WHERE NOT is_front_matter GROUP BY book""", _PAGES)
def folio_leak(spark, sf):
    leak = PG.is_folio(F.get("lines", F.lit(0))) | PG.is_folio(F.element_at("lines", -1))
    return B.book_pages(spark, sf).where("NOT is_front_matter").groupBy("book").agg(F.count_if(leak).alias("leaks"), F.count("*").alias("body"))


@query("roundtrip", "SELECT book, pdf_index, true AS same FROM book_pages", _PAGES)
def roundtrip(spark, sf):
    pages = B.book_pages(spark, sf)
    back = PG.by_printed(pages, pages.select("book", F.col("printed_page").alias("label"), "pdf_index"))
    return back.select("book", "pdf_index", (F.col("page.pdf_index") == F.col("pdf_index")).alias("same"))


@query("coverage_checks", rf"""SELECT b.book, empty_body, empty_body <= greatest(5, body // 25) AS few_empty, coalesce(c.chapters, 0) AS chapters, i / nullif(body, 0) AS in_chapter, i / nullif(body, 0) >= 0.8 AS most_in_chapters, coalesce(bare, 0) AS bare_chapters,
  coalesce(told, 0) AS summaries, CASE WHEN told IS NOT NULL THEN told >= coalesce(c.chapters, 0) - 1 END AS all_summarised, thin AS thin_summaries, coalesce(has_overview, false) AS has_overview
  FROM (SELECT book, count(*) FILTER (NOT is_front_matter AND len(lines) = 0) AS empty_body, count(*) FILTER (NOT is_front_matter) AS body, count(*) FILTER (NOT is_front_matter AND chapter_id >= 0 AND {_BOOK} % 3 <> 2) AS i FROM book_pages GROUP BY book) b
  LEFT JOIN (SELECT c.book, count(*) AS chapters, count(*) FILTER (w.book IS NULL) AS bare FROM (SELECT book, id FROM chapters WHERE {_BOOK} % 3 <> 2) c LEFT JOIN (SELECT DISTINCT book, chapter_id AS id FROM book_pages WHERE len(lines) > 0) w ON w.book = c.book AND w.id = c.id GROUP BY c.book) c ON c.book = b.book
  LEFT JOIN (SELECT book, count(*) AS told, count(*) FILTER (len(list_filter(regexp_split_to_array(summary, '\s+'), lambda x: x <> '')) <= 30) AS thin FROM summ WHERE {_BOOK} % 5 <> 0 AND {_BOOK} % 3 <> 2 GROUP BY book) t ON t.book = b.book
  LEFT JOIN (SELECT book, trim({_OVERVIEW}) <> '' AS has_overview FROM roll WHERE {_BOOK} % 5 <> 0 AND {_BOOK} % 3 <> 2) o ON o.book = b.book""", _PAGES + "," + _SUMMARY)
def coverage_checks(spark, sf):
    """A third of the books has no chapters, and every fifth of the others no summaries."""
    n = F.regexp_extract("book", "([0-9]+)$", 1).try_cast("int")
    pages = B.book_pages(spark, sf).withColumn("chapter_id", F.when(n % 3 != 2, F.col("chapter_id")).otherwise(-1))
    s = _summaries(spark, sf).where((n % 5 != 0) & (n % 3 != 2))
    overviews = M.rollup(s).select("book", M.extractive(F.col("joined")).alias("overview"))
    return ST.coverage(pages, B.chapters(spark, sf).where(n % 3 != 2), s, overviews)


@query("collection_name", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'book_coding' WHEN 1 THEN 'book_novel' WHEN 2 THEN 'book_manga' ELSE 'book_coding' END AS name FROM documents")
def collection_name(spark, sf):
    kind = F.get(F.array(F.lit("Coding"), F.lit("NOVEL"), F.lit("manga"), F.lit("atlas")), (F.col("doc_id") % 4).cast("int"))
    return B.table(spark, sf, "documents").select("doc_id", ST.collection_name(kind).alias("name"))


@query("escape_html", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(39), '&#39;'), chr(34), '&quot;') AS safe FROM pages")
def escape_html(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", ST.escaped(F.col("html")).alias("safe"))


@query("build_estimate", "SELECT book, count(*) * 60 // 10 AS seconds FROM chapters GROUP BY book", _PAGES)
def build_estimate(spark, sf):
    return B.chapters(spark, sf).groupBy("book").agg(F.count("*").alias("n")).select("book", ST.worst_seconds(F.col("n"), F.lit(10)).alias("seconds"))


@query("history_block", f"SELECT conv_id, CASE WHEN history = '' THEN '' ELSE 'Earlier turns:' || chr(10) || history || chr(10) END AS block FROM ({ORACLE_SQL['history_window']})")
def history_block(spark, sf):
    return history_window(spark, sf).select("conv_id", ST.history_block(F.col("history")).alias("block"))


@query("ingest_message", """SELECT totals.book, 'Read ' || total || ' pages into ' || n || ' chunks (' || method || ', offset ' || "offset" || '). Summaries of ' || c || ' chapters: ' || c || ' new, 0 reused.' AS message
  FROM totals JOIN numbering ON numbering.book = totals.book JOIN (SELECT book, count(*) AS n FROM chunks GROUP BY book) k ON k.book = totals.book JOIN (SELECT book, count(*) AS c FROM chapters GROUP BY book) ch ON ch.book = totals.book""", _NUMBERING + "," + _CHUNKS, True)
def ingest_message(spark, sf):
    chapters = B.chapters(spark, sf).groupBy("book").agg(F.count("*").alias("chapters"))
    books = B.totals(spark, sf).withColumnRenamed("total", "pages").join(corpus_count(spark, sf), "book").join(resolve_labels(spark, sf), "book").join(chapters, "book")
    return ST.ingest_message(books.withColumn("built", F.col("chapters")).withColumn("reused", F.lit(0)))


@query("session_state", "SELECT user_id AS session, event_type AS book, arg_max(props, event_id) AS state FROM events GROUP BY user_id, event_type")
def session_state(spark, sf):
    return ST.latest_state(B.table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("book"), F.col("event_id").alias("seq"), F.col("props").alias("state")))


@query("diagnose_hits", """SELECT b.item_id, count(c.chunk) AS hits, count(c.chunk) FILTER (c.is_front_matter OR c.is_index) AS excluded FROM benchmark b LEFT JOIN chunks c ON c.book = 'src' || (b.item_id % 20) AND contains(lower(c.body), lower(left(b.text, 30))) GROUP BY b.item_id""", _PAGES + "," + _CHUNKS, True)
def diagnose_hits(spark, sf):
    q = _questions(spark, sf).select(F.col("query_id").alias("item_id"), "book", F.lower(F.substring("text", 1, 30)).alias("lit"))
    bodies = B.chunks(spark, sf).select("book", "chunk", (F.col("is_front_matter") | F.col("is_index")).alias("out"), F.lower("body").alias("text"))
    met = PH.occurrences(bodies, q.select(F.col("item_id").alias("phrase_id"), "book", F.col("lit").alias("phrase")), keys=("chunk", "out"))
    hit = met.groupBy(F.col("phrase_id").alias("item_id")).agg(F.count("*").alias("hits"), F.count_if("out").alias("excluded"))
    return q.select("item_id").join(hit, "item_id", "left").select("item_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("excluded", F.lit(0)).alias("excluded"))


_AUTO = 10


@query("auto_cases", rf"""SELECT book, printed_page, array_to_string(w[1:14], ' ') AS phrase FROM (SELECT *, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(best, '^\[[a-z]+\]\s*', ''), '^[A-Za-z ]+:\s*', ''), '\s+'), lambda x: x <> '') AS w FROM (
  SELECT book, printed_page, list_reduce(lines, lambda a, b: CASE WHEN length(regexp_replace(b, '[^A-Za-z ]', '', 'g')) > length(regexp_replace(a, '[^A-Za-z ]', '', 'g')) THEN b ELSE a END) AS best,
    row_number() OVER (PARTITION BY book ORDER BY md5('7:' || book || ':' || pdf_index)) AS n FROM book_pages WHERE NOT is_front_matter AND NOT is_index AND len(lines) >= 4) WHERE n <= {_AUTO}) WHERE len(w[1:14]) >= 5""", _PAGES)
def auto_cases(spark, sf):
    """A seeded sample of pages of each book, each with the first words of its most wordy line."""
    from pyspark.sql import Window

    p = B.book_pages(spark, sf).where(~F.col("is_front_matter") & ~F.col("is_index") & (F.size("lines") >= 4))
    order = F.md5(F.concat(F.lit("7:"), "book", F.lit(":"), F.col("pdf_index").cast("string")))
    p = p.withColumn("n", F.row_number().over(Window.partitionBy("book").orderBy(order))).where(F.col("n") <= _AUTO)
    best = F.array_max(F.transform("lines", lambda t, i: F.struct(F.length(F.regexp_replace(t, "[^A-Za-z ]", "")).alias("n"), (-i).alias("i"), t.alias("t"))))["t"]
    bare = F.regexp_replace(F.regexp_replace(best, r"^\[[a-z]+\]\s*", ""), r"^[A-Za-z ]+:\s*", "")
    words = F.slice(F.array_remove(F.split(bare, r"\s+"), ""), 1, 14)
    return p.select("book", "printed_page", words.alias("w")).where(F.size("w") >= 5).select("book", "printed_page", F.array_join("w", " ").alias("phrase"))


@query("chapter_context", """SELECT w.book, w.chapter, c.title, t.span, t.summary FROM (
  SELECT a.book, a.chapter, min(c.id) AS id FROM (SELECT book, CAST(id + 1 AS VARCHAR) AS chapter FROM chapters) a LEFT JOIN chapters c ON c.book = a.book AND contains(lower(c.title), a.chapter) GROUP BY a.book, a.chapter) w
  JOIN chapters c ON c.book = w.book AND c.id = w.id LEFT JOIN summ t ON t.book = w.book AND t.chapter_id = w.id""", _PAGES + "," + _SUMMARY)
def chapter_context(spark, sf):
    c = B.chapters(spark, sf)
    found = PG.find_chapter(c, c.select("book", (F.col("id") + 1).cast("string").alias("chapter")))
    return found.join(_summaries(spark, sf).select("book", "chapter_id", "span", "summary"), ["book", "chapter_id"], "left").select("book", "chapter", "title", "span", "summary")


_HISTORY = ORACLE_SQL["history_window"]
#: Routed questions with what was said before, the chapter they name, and what to search for.
_ROUTED = _PAGES + "," + _ROUTE + rf""",
chs AS (SELECT * FROM chapters WHERE {_BOOK} % 3 <> 2),
nums AS (SELECT * FROM {B.sql_values(tuple((str(k), v) for k, v in PG.ROMAN_NUMERALS.items()) + tuple((v, str(k)) for k, v in PG.ROMAN_NUMERALS.items()), "a, b")}),
names AS (SELECT a.question_id, a.book, lower(trim(r.chapter)) AS name, 0 AS try_ FROM asked a JOIN r ON r.question_id = a.question_id WHERE kind = 'chapter' UNION ALL SELECT a.question_id, a.book, nums.b, 1 FROM asked a JOIN r ON r.question_id = a.question_id JOIN nums ON nums.a = lower(trim(r.chapter)) WHERE kind = 'chapter'),
named AS (SELECT question_id, arg_min(id, (try_, id)) AS chapter_id, arg_min(title, (try_, id)) AS title FROM names n JOIN chs c ON c.book = n.book AND (contains(lower(title), name) OR starts_with(lower(title), 'chapter ' || name)) GROUP BY question_id),
hist AS ({_HISTORY}),
prev AS (SELECT conv_id, arg_max(coalesce(text, ''), turn) FILTER (lower(role) IN ('user', 'human')) AS previous FROM conversations GROUP BY conv_id),
rq0 AS (SELECT a.*, r.kind, r.page, r.line, r.pages, n.chapter_id, n.title, h.history, p.previous, p.conv_id IS NOT NULL AS has_turns, regexp_replace(coalesce(a.question, ''), '^\s+|\s+$', '', 'g') AS t
  FROM asked a JOIN r ON r.question_id = a.question_id LEFT JOIN named n ON n.question_id = a.question_id LEFT JOIN hist h ON h.conv_id = a.conv_id LEFT JOIN prev p ON p.conv_id = a.conv_id),
rq1 AS (SELECT *, kind IN ('semantic', 'chapter') AND coalesce(history, '') <> '' AND t <> '' AND (len(regexp_split_to_array(t, '\s+')) <= 4 OR regexp_matches(t, {{cont}}) OR regexp_matches(t, {{pron}})) AS needs,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(previous, ''), '\s+', ' ', 'g') || ' ' || coalesce(question, ''), '^\s+|\s+$', '', 'g'), '^"+|"+$', '', 'g'), '^\s+|\s+$', '', 'g') AS o FROM rq0),
rq AS (SELECT * EXCLUDE (o), CASE WHEN NOT needs THEN coalesce(question, '') WHEN trim(CASE WHEN length(o) > 400 OR contains(o, chr(10)) THEN left(string_split(o, chr(10))[1], 400) ELSE o END) = '' THEN coalesce(question, '')
  WHEN length(o) > 400 OR contains(o, chr(10)) THEN left(string_split(o, chr(10))[1], 400) ELSE o END AS searched FROM rq1)""".replace("\\\\", "\\").replace("{cont}", _quoted(P.CONTINUATION)).replace("{pron}", _quoted(P.PRONOUNS))


def _asked_for(spark, sf):
    """A third of the books has no chapters, every fifth of the others no summaries yet."""
    n = F.regexp_extract("book", "([0-9]+)$", 1).try_cast("int")
    s = _summaries(spark, sf).where((n % 5 != 0) & (n % 3 != 2))
    return B.asked(spark, sf), B.turns(spark, sf), B.chapters(spark, sf).where(n % 3 != 2), s, M.rollup(s).select("book", M.extractive(F.col("joined")).alias("overview"), "joined")


@query("question_rewritten", "SELECT question_id, book, kind, chapter_id, title, has_turns, searched AS asked FROM rq", _ROUTED)
def question_rewritten(spark, sf):
    """What each question is searched for, and the chapter that it names."""
    from pagewright.plans.dispatch import routed

    asked, turns, chapters, _, _ = _asked_for(spark, sf)
    return routed(asked, turns, chapters).select("question_id", "book", "kind", "chapter_id", "title", "has_turns", "asked")


_SEARCHED = _CHUNKS + "," + _BM25.split("questions AS")[0].rstrip().rstrip(",") + f""",
open AS (SELECT * FROM rq WHERE kind = 'semantic' OR kind = 'chapter' OR kind = 'global' AND book NOT IN (SELECT book FROM chs)),
questions AS (SELECT question_id AS query_id, book, chapter_id, CASE kind WHEN 'global' THEN 120 ELSE 12 END AS k, searched AS text, regexp_extract_all(lower(searched), '[a-z0-9'']+') AS ts FROM open),
qt AS (SELECT query_id, book, term, count(*) AS qtf FROM (SELECT query_id, book, unnest(ts) AS term FROM questions) GROUP BY ALL),
lex0 AS (SELECT query_id, qt.book, chunk, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN idf ON idf.book = qt.book AND idf.term = qt.term JOIN post ON post.book = qt.book AND post.term = qt.term GROUP BY query_id, qt.book, chunk),
lex1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS place FROM lex0),
lex AS (SELECT l.query_id, l.chunk, row_number() OVER (PARTITION BY l.query_id ORDER BY place) AS rank FROM lex1 l JOIN questions q ON q.query_id = l.query_id JOIN chunks c ON c.chunk = l.chunk WHERE place <= greatest(k, 40) AND score > 0 AND (q.chapter_id IS NULL OR q.chapter_id = c.chapter_id)),
vec AS (SELECT book, chunk, list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0.0 END) AS v FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT book, chunk, {_EMBED.format('ts')} AS v FROM toks))),
qvec AS (SELECT query_id, book, chapter_id, k, list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0.0 END) AS v FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT query_id, book, chapter_id, k, {_EMBED.format('ts')} AS v FROM questions))),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS rank FROM (SELECT query_id, k, vec.chunk, round(list_dot_product(vec.v, qvec.v), 6) AS score FROM vec JOIN qvec ON qvec.book = vec.book JOIN chunks c ON c.chunk = vec.chunk WHERE qvec.chapter_id IS NULL OR qvec.chapter_id = c.chapter_id)) WHERE rank <= greatest(k, 40)),
fused AS (SELECT query_id, chunk, round(sum(1 / (60 + rank)), 9) AS score, min(d) AS d, min(l) AS l FROM (SELECT query_id, chunk, rank, rank AS d, NULL AS l FROM dense UNION ALL SELECT query_id, chunk, rank, NULL, rank FROM lex) GROUP BY ALL),
top AS (SELECT f.* FROM (SELECT query_id, chunk, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d NULLS LAST, l, chunk) AS rank FROM fused) f JOIN questions q ON q.query_id = f.query_id WHERE rank <= k),
passages AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM top JOIN chunks USING (chunk) GROUP BY query_id)"""


@query("answer_dispatch", rf"""SELECT q.question_id, q.book, q.kind, q.searched AS asked, CASE
  WHEN kind = 'page_line' THEN CASE WHEN total IS NULL THEN 'No book of this name has been indexed.' WHEN f.pdf_index IS NULL THEN 'Page ' || page || ' is not among the ' || total || ' pages of this book.'
    WHEN line < 1 OR f.lines[line] IS NULL THEN 'Page ' || page || ' has ' || len(f.lines) || ' lines; there is no line ' || line || '.' ELSE 'Page ' || page || ', line ' || line || ': ' || f.lines[line] || ' (viewer page ' || (f.pdf_index + 1) || ' of ' || len(f.lines) || ' lines)' END
  WHEN kind IN ('page', 'pages') THEN CASE WHEN total IS NULL THEN 'No book of this name has been indexed.' WHEN g.context IS NULL AND kind = 'page' THEN 'Page ' || page || ' is not among the ' || total || ' pages of this book.'
    WHEN g.context IS NULL THEN 'None of these pages is among the ' || total || ' pages of this book.' ELSE g.context || coalesce(chr(10) || chr(10) || 'Not in this book: ' || g.missing, '') END
  WHEN kind = 'memory' THEN CASE WHEN NOT has_turns THEN 'This conversation has no earlier messages; this is its first question.' WHEN previous IS NULL THEN 'There is no earlier question of yours in this conversation.' ELSE 'Your previous question was: ' || trim(previous) END
  WHEN kind = 'global' AND o.joined IS NOT NULL THEN {_OVERVIEW.replace('joined', 'o.joined')} || chr(10) || chr(10) || o.joined
  WHEN kind = 'global' AND q.book IN (SELECT book FROM chs) THEN 'Summaries of this book have not been built yet; questions on its pages, chapters and passages can be answered.'
  WHEN kind = 'chapter' AND q.chapter_id IS NOT NULL THEN q.title || ' (pages ' || coalesce(s.span, '?') || '): ' || coalesce(s.summary, '(not available)') || coalesce(chr(10) || chr(10) || x.context, '')
  ELSE coalesce(x.context, 'Nothing in this book fits the question.') END AS answer
  FROM rq q LEFT JOIN totals t ON t.book = q.book LEFT JOIN book_pages f ON kind = 'page_line' AND f.book = q.book AND f.printed_page = CAST(page AS VARCHAR)
  LEFT JOIN (SELECT question_id, string_agg(block, chr(10) || chr(10) ORDER BY ord) AS context, string_agg(CAST(p AS VARCHAR), ', ' ORDER BY ord) FILTER (block IS NULL) AS missing FROM (
    SELECT w.question_id, p, ord, CASE WHEN f.pdf_index IS NOT NULL THEN '=== PRINTED PAGE ' || f.printed_page || ' ===' || chr(10) || CASE WHEN trim({_NUMBERED.format('f.lines')}) = '' THEN '(this page has no text)' ELSE {_NUMBERED.format('f.lines')} END END AS block
    FROM (SELECT question_id, book, unnest(coalesce(pages, [page])) AS p, unnest(range(len(coalesce(pages, [page])))) AS ord FROM rq WHERE kind IN ('page', 'pages')) w LEFT JOIN book_pages f ON f.book = w.book AND f.printed_page = CAST(p AS VARCHAR)) GROUP BY question_id) g ON g.question_id = q.question_id
  LEFT JOIN (SELECT * FROM roll WHERE {_BOOK} % 5 <> 0 AND {_BOOK} % 3 <> 2) o ON o.book = q.book LEFT JOIN (SELECT * FROM summ WHERE {_BOOK} % 5 <> 0 AND {_BOOK} % 3 <> 2) s ON s.book = q.book AND s.chapter_id = q.chapter_id
  LEFT JOIN passages x ON x.query_id = q.question_id""", _ROUTED + "," + _SEARCHED + "," + _SUMMARY, True)
def answer_dispatch(spark, sf):
    from pagewright.plans.dispatch import answered

    asked, turns, chapters, summaries, overviews = _asked_for(spark, sf)
    return answered(asked, turns, _index(spark, sf), B.book_pages(spark, sf), chapters, summaries, overviews).drop("prompt")


_DIAG = f"""
usable AS (SELECT book, chunk, pdf_index, body, regexp_extract_all(lower(text), '[a-z0-9'']+') AS ts FROM chunks WHERE NOT is_index AND NOT is_front_matter),
uvec0 AS (SELECT book, chunk, pdf_index, {_EMBED.format('ts')} AS v FROM usable),
uvec AS (SELECT *, CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE v END AS u FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM uvec0)),
asks AS (SELECT item_id, 'src' || (item_id % 20) AS book, text AS t, lower(left(text, 30)) AS lit, 0 AS k FROM benchmark UNION ALL SELECT item_id, 'src' || (item_id % 20), left(text, 30), lower(left(text, 30)), 1 FROM benchmark),
avec AS (SELECT *, CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE v END AS u FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT *, {_EMBED.format('ts')} AS v FROM (SELECT *, regexp_extract_all(lower(t), '[a-z0-9'']+') AS ts FROM asks)))),
near AS (SELECT * FROM (SELECT item_id, k, chunk, pdf_index, row_number() OVER (PARTITION BY item_id, k ORDER BY score DESC, chunk) AS rank FROM (SELECT item_id, k, chunk, pdf_index, round(list_dot_product(uvec.u, avec.u), 6) AS score FROM uvec JOIN avec ON avec.book = uvec.book)) WHERE rank <= CASE WHEN k = 0 THEN 25 ELSE 8 END),
target AS (SELECT DISTINCT b.item_id, u.pdf_index FROM benchmark b JOIN usable u ON u.book = 'src' || (b.item_id % 20) AND contains(lower(u.body), lower(left(b.text, 30)))),
found AS (SELECT item_id, min(rank) FILTER (k = 0) AS rank, bool_or(k = 1) AS own FROM near JOIN target USING (item_id, pdf_index) GROUP BY item_id)
"""


@query("diagnose_verdict", """SELECT b.item_id, f.rank, CASE WHEN t.item_id IS NULL THEN 'not ingested' WHEN f.rank <= 12 THEN 'retrieved' WHEN coalesce(f.own, false) THEN 'vocabulary' ELSE 'embedding' END AS verdict
  FROM benchmark b LEFT JOIN (SELECT DISTINCT item_id FROM target) t ON t.item_id = b.item_id LEFT JOIN found f ON f.item_id = b.item_id""", _PAGES + "," + _CHUNKS + "," + _DIAG, True)
def diagnose_verdict(spark, sf):
    """Where each benchmark passage fails: its text is missing, found well, found only by its own words, or not found."""
    usable = B.chunks(spark, sf).where("NOT is_index AND NOT is_front_matter")
    q = _questions(spark, sf).withColumnRenamed("query_id", "item_id")
    literal = F.substring("text", 1, 30)
    said = q.select(F.col("item_id").alias("phrase_id"), "book", F.lower(literal).alias("phrase"))
    target = PH.occurrences(usable.select("book", "pdf_index", F.lower("body").alias("text")), said).select(F.col("phrase_id").alias("item_id"), "pdf_index").distinct()
    v = usable.select("book", "chunk", R.HASHED.passages(F.col("text")).alias("vector"))
    asked = lambda text, k: q.select(F.struct("item_id", F.lit(k).alias("k")).alias("query_id"), "book", R.HASHED.questions(text).alias("vector"))
    near = R.dense_topk(v, asked(F.col("text"), 0).unionByName(asked(literal, 1)), 25, ("book",)).where((F.col("query_id.k") == 0) | (F.col("rank") <= 8))
    hit = near.select("query_id.item_id", "query_id.k", "chunk", "rank").join(usable.select("chunk", "pdf_index"), "chunk").join(target, ["item_id", "pdf_index"])
    found = hit.groupBy("item_id").agg(F.min(F.when(F.col("k") == 0, F.col("rank"))).alias("rank"), F.bool_or(F.col("k") == 1).alias("own"))
    have = target.select("item_id").distinct().withColumn("have", F.lit(True))
    verdict = F.when(F.col("have").isNull(), "not ingested").when(F.col("rank") <= 12, "retrieved").when(F.coalesce("own", F.lit(False)), "vocabulary").otherwise("embedding")
    return q.select("item_id").join(have, "item_id", "left").join(found, "item_id", "left").select("item_id", "rank", verdict.alias("verdict"))


QUERIES["diagnose_rank"] = lambda spark, sf: diagnose_verdict(spark, sf).select("item_id", "rank")
ORACLE_SQL["diagnose_rank"] = f"SELECT item_id, rank FROM ({ORACLE_SQL['diagnose_verdict']})"
