"""Layout, margins, page numbers, lookups and chapters over book tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import patterns as P
from pagewright.operators.phrases import occurrences

_PAGE_KEY = ("book", "pdf_index")


def reading_order(layout: DataFrame) -> DataFrame:
    """Blank lines go, no-break blanks become blanks, right ends are trimmed; ``pos`` counts from 0 down the page."""
    text = F.rtrim(F.translate("text", " ", " "))
    rows = layout.withColumn("text", text).where(F.trim("text") != "")
    pos = F.row_number().over(Window.partitionBy(*_PAGE_KEY).orderBy(F.round("y0", 1), "x0", "seq")) - 1
    return rows.withColumn("pos", pos)


def zone(top: Column, bottom: Column) -> Column:
    return F.when(F.col("y1") <= F.col("height") * top, "header").when(F.col("y0") >= F.col("height") * bottom, "footer").otherwise("body")


def split_margins(ordered: DataFrame, margins: DataFrame | None = None) -> DataFrame:
    """A row for each page: the first line of each margin and the lines between, in order.

    ``margins`` (book, top, bottom) is a row for each book; without it the defaults hold.
    """
    if margins is None:
        rows = ordered.withColumn("zone", zone(F.lit(P.HEADER_ZONE), F.lit(P.FOOTER_ZONE)))
    else:
        rows = ordered.join(margins.select("book", "top", "bottom"), "book").withColumn("zone", zone(F.col("top"), F.col("bottom")))
    first = lambda z: F.min_by(F.when(F.col("zone") == z, F.col("text")), F.when(F.col("zone") == z, F.col("pos")))
    body = F.sort_array(F.collect_list(F.when(F.col("zone") == "body", F.struct("pos", "text"))))
    return rows.groupBy(*_PAGE_KEY).agg(first("header").alias("header"), first("footer").alias("footer"), F.transform(body, lambda x: x["text"]).alias("lines"))


def is_folio(text: Column, arabic: str = P.ARABIC) -> Column:
    return F.rlike(text, F.lit(arabic)) | F.rlike(text, F.lit(P.ROMAN))


def calibrate_margins(ordered: DataFrame, arabic: str = P.ARABIC) -> DataFrame:
    """Margins of each book from where bare page numbers stand among the first and last two lines of its pages.

    Lines of a page with fewer than four lines count from both ends, so twice. ``arabic`` is what a number looks like: with P.ANY_ARABIC
    the numbers of a book of more than 9,999 pages count too, which would otherwise leave it the default margins.
    """
    w = Window.partitionBy(*_PAGE_KEY)
    edge = ordered.withColumn("up", F.row_number().over(w.orderBy("pos"))).withColumn("down", F.row_number().over(w.orderBy(F.desc("pos"))))
    times = (F.col("up") <= 2).cast("int") + (F.col("down") <= 2).cast("int")
    both = edge.withColumn("times", times).where("times > 0").withColumn("times", F.explode(F.sequence(F.lit(1), "times")))
    found = both.where(is_folio(F.col("text"), arabic)).withColumn("upper", F.col("y0") / F.col("height") < 0.5)
    at = found.groupBy("book").agg(
        F.count_if("upper").alias("tops"), F.count_if(~F.col("upper")).alias("bots"),
        F.median(F.when(F.col("upper"), F.col("y1") / F.col("height"))).alias("top_at"),
        F.median(F.when(~F.col("upper"), F.col("y0") / F.col("height"))).alias("bottom_at"),
    )
    seen = ordered.groupBy("book").agg(F.count_distinct("pdf_index").alias("seen"))
    m = seen.join(at, "book", "left")
    top = F.least(F.col("top_at") + 0.005, F.lit(0.20))
    bottom = F.greatest(F.col("bottom_at") - 0.005, F.lit(0.80))
    up = (F.col("tops") / F.col("seen") >= 0.25) & (top > P.HEADER_ZONE)
    down = (F.col("bots") / F.col("seen") >= 0.25) & (bottom < P.FOOTER_ZONE)
    up, down = F.coalesce(up, F.lit(False)), F.coalesce(down, F.lit(False))
    note = F.when(up & down, "top and bottom").when(up, "header").when(down, "footer").otherwise("defaults")
    return m.select("book", F.when(up, top).otherwise(P.HEADER_ZONE).alias("top"), F.when(down, bottom).otherwise(P.FOOTER_ZONE).alias("bottom"), note.alias("note"))


def margin_probe(ordered: DataFrame, edge: int = 3) -> DataFrame:
    """The first and last lines of the pages at a quarter, half and three quarters of each book, with their zones."""
    w = Window.partitionBy(*_PAGE_KEY)
    total = ordered.groupBy("book").agg((F.max("pdf_index") + 1).alias("total"))
    rows = ordered.join(total, "book").where(F.expr("pdf_index IN (total div 4, total div 2, (3 * total) div 4)"))
    rows = rows.withColumn("up", F.row_number().over(w.orderBy("pos"))).withColumn("down", F.row_number().over(w.orderBy(F.desc("pos"))))
    return rows.where((F.col("up") <= edge) | (F.col("down") <= edge)).select(*_PAGE_KEY, "pos", zone(F.lit(P.HEADER_ZONE), F.lit(P.FOOTER_ZONE)).alias("zone"), "text")


def folio(text: Column) -> Column:
    """The page number in a margin line: arabic alone, roman alone, or at either end of a running head."""
    t = F.trim(text)
    part = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit("")).cast("int").cast("string")
    return F.coalesce(part(P.ARABIC), F.when(F.rlike(t, F.lit(P.ROMAN)), F.lower(t)), part(P.LEADING_FOLIO), part(P.TRAILING_FOLIO))


def with_folio(pages: DataFrame) -> DataFrame:
    return pages.withColumn("folio", F.coalesce(folio(F.col("footer")), folio(F.col("header"))))


_DIGITS = "^[0-9]+$"


def modal_offset(pages: DataFrame) -> DataFrame:
    """For each book the most frequent pdf_index - folio, ties to the first met, its share of all pages and whether it is enough."""
    d = pages.where(F.rlike("folio", F.lit(_DIGITS))).withColumn("offset", F.col("pdf_index") - F.col("folio").cast("int"))
    counts = d.groupBy("book", "offset").agg(F.count("*").alias("n"), F.min("pdf_index").alias("first"))
    best = counts.groupBy("book").agg(F.max_by("offset", F.struct("n", -F.col("first"))).alias("offset"), F.max("n").alias("n"))
    total = pages.groupBy("book").agg(F.count("*").alias("total"))
    share = F.coalesce(F.col("n") / F.col("total"), F.lit(0.0))
    return total.join(best, "book", "left").select("book", "offset", share.alias("agreement"), (share >= P.MIN_FOLIO_AGREEMENT).alias("accepted"))


def resolve_labels(pages: DataFrame, page_labels: DataFrame) -> DataFrame:
    """For each book its numbering: the catalogue's labels if they cover all pages, else folios, else positions.

    A catalogue counts if one of its labels isn't blank; blank ones are then labels too. Its offset is that of the first
    arabic label, 0 without one.
    """
    total = pages.groupBy("book").agg(F.count("*").alias("total"))
    labels = page_labels.groupBy("book").agg(
        F.count("*").alias("labels"), F.coalesce(F.bool_or(F.trim("label") != ""), F.lit(False)).alias("said"),
        F.min_by(F.struct("pdf_index", "label"), F.when(F.rlike(F.trim("label"), F.lit(_DIGITS)), F.col("pdf_index"))).alias("l"),
    )
    m = total.join(labels, "book", "left").join(modal_offset(pages).withColumnRenamed("offset", "modal"), "book")
    have = F.coalesce(F.col("said") & (F.col("labels") >= F.col("total")), F.lit(False))
    method = F.when(have, "pdf_page_labels").when(F.col("accepted"), "footer_regex_offset").otherwise("fallback_sequential")
    offset = F.when(have, F.coalesce(F.col("l.pdf_index") - F.trim("l.label").cast("int"), F.lit(0))).when(F.col("accepted"), F.col("modal")).otherwise(0)
    return m.select("book", method.alias("method"), offset.alias("offset"))


def printed_pages(pages: DataFrame, numbering: DataFrame, page_labels: DataFrame) -> DataFrame:
    """Each page's label: the catalogue's where it counts; else its own folio, else from the offset, else its
    place in brackets; its place alone where nothing is known."""
    own = F.col("pdf_index") - F.col("offset")
    label = (
        F.when(F.col("method") == "pdf_page_labels", F.trim(F.coalesce("_label", F.lit(""))))
        .when(F.col("method") == "fallback_sequential", (F.col("pdf_index") + 1).cast("string"))
        .when(F.col("folio").isNotNull(), F.col("folio"))
        .when(own >= 1, own.cast("string"))
        .otherwise(F.concat(F.lit("["), (F.col("pdf_index") + 1).cast("string"), F.lit("]")))
    )
    labels = page_labels.select("book", "pdf_index", F.col("label").alias("_label"))
    rows = pages.join(numbering, "book").join(labels, ["book", "pdf_index"], "left").withColumn("printed_page", label).drop("_label")
    return rows.withColumn("is_front_matter", ~F.rlike("printed_page", F.lit(_DIGITS)))


def index_ratio(lines: Column) -> Column:
    hits = F.size(F.filter(lines, lambda x: F.rlike(F.trim(x), F.lit(P.INDEX_ENTRY))))
    return F.when(F.size(lines) < P.INDEX_LEAST_LINES, F.lit(0.0)).otherwise(hits / F.size(lines))


def by_printed(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (book, label) with the first page in file order of that label, compared trimmed and in lower case; null if none.

    Places are found on three narrow columns of the wanted labels; lines move only for the pages found.
    """
    asked = wanted.withColumn("_label", F.lower(F.trim("label")))
    places = pages.select("book", "pdf_index", F.lower(F.trim("printed_page")).alias("_label")).join(asked.select("book", "_label").distinct(), ["book", "_label"], "left_semi")
    first = places.groupBy("book", "_label").agg(F.min("pdf_index").alias("pdf_index"))
    found = pages.join(first, ["book", "pdf_index"]).select("book", "_label", F.struct(*[c for c in pages.columns if c != "book"]).alias("page"))
    return asked.join(found, ["book", "_label"], "left").drop("_label")


def line(lines: Column, n: Column) -> Column:
    """Line ``n`` from 1 on, null outside."""
    return F.when(n >= 1, F.get(lines, n - 1))


ROMAN_NUMERALS = dict(enumerate("i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx xxi xxii xxiii xxiv xxv xxvi xxvii xxviii xxix xxx".split(), 1))


def _other_numeral(name: Column) -> Column:
    pairs = [(str(k), v) for k, v in ROMAN_NUMERALS.items()] + [(v, str(k)) for k, v in ROMAN_NUMERALS.items()]
    return F.get(F.filter(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]), lambda x: x["a"] == name), F.lit(0))["b"]


def find_chapter(chapters: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (book, chapter) with chapter_id and title of the first chapter whose title fits the name,
    as it is or, failing that, in the other kind of numeral. Titles pass the automaton of their book's names, so rows grow with matches and not with names times titles."""
    name = F.lower(F.trim("chapter"))
    both = wanted.withColumn("_names", F.array(name, _other_numeral(name))).select("*", F.posexplode("_names").alias("_try", "_name")).where("_name IS NOT NULL").drop("_names")
    titles = chapters.select("book", F.col("id").alias("chapter_id"), "title", F.lower("title").alias("text"))
    keys = wanted.columns
    named = both.select(F.struct(*keys, "_try").alias("phrase_id"), "book", F.col("_name").alias("phrase"))
    # a title that begins with "chapter" and the name contains the name
    found = occurrences(titles, named, keys=("chapter_id", "title")).select("phrase_id.*", "chapter_id", "title")
    blank = both.where("_name = ''").join(titles.drop("text").where("title IS NOT NULL"), "book").groupBy(*keys, "_try").agg(F.min("chapter_id").alias("chapter_id"), F.min_by("title", "chapter_id").alias("title"))
    found = found.unionByName(blank.select(*found.columns))
    best = found.groupBy(*keys).agg(F.min_by(F.struct("chapter_id", "title"), F.struct("_try", "chapter_id")).alias("c"))
    return wanted.join(best, keys, "left").select(*keys, "c.chapter_id", "c.title")


def _ranges(marks: DataFrame, totals: DataFrame) -> DataFrame:
    w = Window.partitionBy("book").orderBy("ord")
    rows = marks.withColumn("id", F.row_number().over(w) - 1).withColumn("_next", F.lead("start").over(w)).join(totals, "book")
    return rows.select("book", "id", "title", "start", F.coalesce(F.col("_next") - 1, F.col("total") - 1).alias("end"))


def chapters_outline(outline: DataFrame, totals: DataFrame) -> DataFrame:
    """Chapters from bookmarks of the first level whose title is a heading or a note."""
    fits = F.rlike("title", F.lit(P.CHAPTER_HEADING)) | F.startswith(F.lower("title"), F.lit("note"))
    marks = outline.where((F.col("level") == 1) & (F.col("page1") >= 1) & fits)
    return _ranges(marks.select("book", F.trim("title").alias("title"), (F.col("page1") - 1).alias("start"), F.col("seq").alias("ord")), totals)


def chapters_heading(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """Chapters from pages with a heading among their first three lines."""
    first = F.get(F.filter(F.slice("lines", 1, 3), lambda x: F.rlike(F.trim(x), F.lit(P.CHAPTER_HEADING))), F.lit(0))
    marks = pages.withColumn("_h", first).where("_h IS NOT NULL")
    return _ranges(marks.select("book", F.substring(F.trim("_h"), 1, 80).alias("title"), F.col("pdf_index").alias("start"), F.col("pdf_index").alias("ord")), totals)


def choose_chapters(outlined: DataFrame, headed: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chapters, method of each book): those of the outline if it has any, else those of headings, else none."""
    books = totals.select("book").join(outlined.select("book", F.lit(True).alias("_o")).distinct(), "book", "left").join(headed.select("book", F.lit(True).alias("_h")).distinct(), "book", "left")
    method = F.when(F.col("_o"), "pdf_outline").when(F.col("_h"), "heading_regex").otherwise("none")
    return outlined.unionByName(headed.join(outlined.select("book").distinct(), "book", "left_anti")), books.select("book", method.alias("method"))


#: Pages of a range, inside which pages and chapters meet.
RANGE_PAGES = 256


def assign_chapters(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """Each page's last chapter whose range holds it, -1 where none does; chapters may overlap, and one without a start or an end holds none.

    Chapters are cut at the ends of ranges of RANGE_PAGES pages, up to the book's last page. A range has its pieces in one row: a piece a
    chapter that begins or ends there, and one for all that hold it whole (of equal pieces the last chapter counts). So a page
    meets the few pieces of its own range, and a book of any length is many ranges.
    """
    w = RANGE_PAGES
    last = pages.groupBy("book").agg(F.max("pdf_index").alias("_last"))
    c = chapters.where("start IS NOT NULL AND end IS NOT NULL").join(last, "book").select("book", F.col("id").alias("_id"), F.greatest(F.col("start"), F.lit(0)).alias("_s"), F.least("end", "_last").alias("_e"))
    c = c.where(F.col("_s") <= F.col("_e")).withColumn("_range", F.explode(F.expr(f"sequence(_s div {w}, _e div {w})")))
    pieces = c.groupBy("book", "_range", F.greatest("_s", F.col("_range") * w).alias("s"), F.least("_e", F.col("_range") * w + w - 1).alias("e")).agg(F.max("_id").alias("id"))
    ranges = pieces.groupBy("book", "_range").agg(F.collect_list(F.struct("s", "e", "id")).alias("_pieces"))
    rows = pages.drop("chapter_id").withColumn("_range", F.expr(f"pdf_index div {w}")).join(ranges, ["book", "_range"], "left")
    over = F.filter("_pieces", lambda x: F.col("pdf_index").between(x["s"], x["e"]))
    return rows.withColumn("chapter_id", F.coalesce(F.array_max(F.transform(over, lambda x: x["id"])), F.lit(-1))).drop("_range", "_pieces")


def chapter_texts(pages: DataFrame) -> DataFrame:
    """Text, first and last label of the pages with lines of each chapter, in file order."""
    rows = pages.where((F.size("lines") > 0) & (F.col("chapter_id") >= 0)).select("book", "chapter_id", "pdf_index", "printed_page", F.array_join("lines", "\n").alias("t"))
    parts = F.sort_array(F.collect_list(F.struct("pdf_index", "t")))
    return rows.groupBy("book", "chapter_id").agg(
        F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"),
        F.concat(F.min_by("printed_page", "pdf_index"), F.lit("-"), F.max_by("printed_page", "pdf_index")).alias("span"),
    )
