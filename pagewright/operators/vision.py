"""Lenient JSON of image models, cleaned items and page lines; archives of page images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import patterns as P

PARSED = "pages array<struct<page:string,items:array<struct<panel:int,type:string,speaker:string,text:string>>>>"


def unfenced(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def parse(raw: Column) -> Column:
    """The parsed object without fences, or of the outermost braces, or null."""
    whole = F.from_json(unfenced(raw), PARSED)
    inner = F.from_json(F.regexp_extract(unfenced(raw), r"(?s)\{.*\}", 0), PARSED)
    return F.coalesce(F.when(whole["pages"].isNotNull(), whole), F.when(inner["pages"].isNotNull(), inner))


def clean_items(raw: DataFrame) -> DataFrame:
    """Items of each answer (image_hash, pdf_index, raw) in order; blank ones go, kinds and blanks are made regular.

    An answer may cover several pages: an entry's items go to the page it names (a number from 1 on), and to the
    answer's own page where it names none. Of two entries for a page the later one counts.
    """
    named = F.trim(F.coalesce("p.page", F.lit("")))
    page = F.coalesce(F.when(F.rlike(named, F.lit("^[0-9]{1,9}$")), named.cast("int") - 1), F.col("asked")).alias("pdf_index")
    entries = raw.select("image_hash", F.col("pdf_index").alias("asked"), F.posexplode(parse(F.col("raw"))["pages"]).alias("entry", "p"))
    entries = entries.select("image_hash", "asked", page, "entry", "p")
    last = F.max("entry").over(Window.partitionBy("image_hash", "asked", "pdf_index"))
    rows = entries.withColumn("_last", last).where("entry = _last").select("image_hash", "pdf_index", F.posexplode("p.items").alias("ord", "it"))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("it.text", F.lit(""))), r"\s*\n\s*", " "), r"[ \t]{2,}", " "))
    kind = F.lower(F.trim(F.coalesce("it.type", F.lit("speech"))))
    return rows.select(
        "image_hash", "pdf_index", "ord", F.coalesce("it.panel", F.lit(1)).alias("panel"),
        F.when(kind.isin(*P.ITEM_TYPES), kind).otherwise("speech").alias("type"),
        F.trim(F.coalesce("it.speaker", F.lit(""))).alias("speaker"), text.alias("text"),
    ).where("text <> ''")


def lines(items: DataFrame, with_sounds: bool = True) -> DataFrame:
    """Items as page lines: (pdf_index, lines)."""
    who = F.when(F.col("speaker") == "", "unknown").otherwise(F.col("speaker"))
    line = (
        F.when(F.col("type") == "caption", F.concat(F.lit("[caption] "), "text"))
        .when(F.col("type") == "sfx", F.concat(F.lit("[sfx] "), "text"))
        .when(F.col("type") == "thought", F.concat(who, F.lit(" (thinking): "), "text"))
        .otherwise(F.concat(who, F.lit(": "), "text"))
    )
    rows = items if with_sounds else items.where("type <> 'sfx'")
    return rows.withColumn("line", line).groupBy("pdf_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]).alias("lines"))


def pages(raw: DataFrame, items: DataFrame) -> DataFrame:
    """Every image's page, with no lines where nothing was read."""
    every = raw.select("pdf_index").distinct()
    return every.join(lines(items), "pdf_index", "left").select("pdf_index", (F.col("pdf_index") + 1).cast("string").alias("printed_page"), F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))


def top_speakers(pages_: DataFrame, most: int = 10) -> DataFrame:
    """(speaker, n) of the names before the colon of page lines, most lines first; bracketed kinds of lines have none."""
    said = pages_.select(F.explode("lines").alias("line")).where(F.contains("line", F.lit(":")) & ~F.startswith("line", F.lit("[")))
    return said.groupBy(F.trim(F.substring_index("line", ":", 1)).alias("speaker")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "speaker").limit(most)


def sounds_only(lines_: Column) -> Column:
    return (F.size(lines_) > 0) & F.forall(lines_, lambda x: F.startswith(x, F.lit("[sfx]")))


def pending(images: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known images, one row for each unknown hash)."""
    known = images.join(cache.select("image_hash").distinct(), "image_hash", "left_semi")
    new = images.join(cache.select("image_hash"), "image_hash", "left_anti")
    return known, new.groupBy("image_hash").agg(F.min("pdf_index").alias("pdf_index"))


def batches(new: DataFrame, each: int, key: str = "pdf_index") -> DataFrame:
    """Requests of ``each`` rows in order of ``key``: (batch, images). Places come from counts of at most 4,097 ranges
    of the key and places inside a range, so no window holds the table."""
    ends = new.agg(F.min(key), F.max(key)).first()
    width = 1 if ends[0] is None else (ends[1] - ends[0]) // 4096 + 1
    d = new.select(key, F.expr(f"`{key}` div {width}L").alias("r"))
    sums = d.groupBy("r").agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = d.withColumn("i", F.row_number().over(Window.partitionBy("r").orderBy(key))).join(sums.withColumn("base", base), "r")
    return placed.groupBy(F.expr(f"(base + i - 1) div {each}").alias("batch")).agg(F.count("*").alias("images"))


def _base(member: Column) -> Column:
    name = F.element_at(F.split(member, "/"), -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _plain(member: Column) -> Column:
    return F.trim(F.regexp_replace(_base(member), r"\s*\(.*?\)\s*$", ""))


def stem(member: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(_plain(member), r"[0-9]{1,4}[a-z]?(?:_[0-9]{1,4})?$", "")))


def is_cover(member: Column) -> Column:
    tail = F.trim(F.element_at(F.split(_base(member), "-"), -1))
    return F.rlike(tail, F.lit(r"(?i)^0+[a-z]?(\s*\(.*\))?$")) | F.rlike(_base(member), F.lit("(?i)cover|wraparound"))


def declared(member: Column) -> tuple[Column, Column]:
    """The page numbers in a name: (first, second); the second is the first plus one for names such as 012_013."""
    pair = F.nullif(F.regexp_extract(_plain(member), r"([0-9]{1,4})_([0-9]{1,4})$", 1), F.lit("")).cast("int")
    single = F.nullif(F.regexp_extract(_plain(member), r"([0-9]{1,4})$", 1), F.lit("")).cast("int")
    return F.coalesce(pair, single), pair + 1


def dominant(members: DataFrame) -> DataFrame:
    """``members`` (archive, member, ...) without files that don't follow the name that 60 % of at least four share."""
    rows = members.withColumn("_stem", stem(F.col("member")))
    counts = rows.groupBy("archive", "_stem").agg(F.count("*").alias("n"), F.min(F.lower("member")).alias("first"))
    best = counts.groupBy("archive").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.max_by("_stem", F.struct("n", -F.length("first"))).alias("_best"))
    best = best.withColumn("clear", (F.col("total") >= 4) & (F.col("most") >= 0.6 * F.col("total")))
    return rows.join(best, "archive").where(~F.col("clear") | (F.col("_stem") == F.col("_best"))).select(*members.columns)


def manifest(members: DataFrame, keep_covers: bool = False, split: bool = True) -> DataFrame:
    """Pages of archives in order: spreads give two, covers none unless kept; numbered across all archives."""
    first, second = declared(F.col("member"))
    rows = dominant(members).where(F.lit(keep_covers) | ~is_cover(F.col("member")))
    wide = (F.col("width") > F.col("height")) & (second.isNotNull() | (F.col("width") / F.col("height") > 1.15))
    rows = rows.withColumn("spread", wide & F.lit(split)).withColumn("a", first).withColumn("b", second)
    halves = F.when(F.col("spread"), F.array(F.struct(F.lit(0).alias("half"), F.when(F.col("b").isNotNull(), F.col("a")).alias("declared_page")), F.struct(F.lit(1).alias("half"), F.col("b").alias("declared_page")))).otherwise(F.array(F.struct(F.lit(0).alias("half"), F.col("a").alias("declared_page"))))
    rows = rows.select("archive", "member", "spread", F.explode(halves).alias("h"))
    lead = F.coalesce(F.nullif(F.regexp_extract("archive", r"^\s*([0-9]+)", 1), F.lit("")).cast("long"), F.lit(1_000_000_000))
    # pages within an archive, and archives before it: no window over all pages
    w = Window.partitionBy("archive").orderBy(F.lower("member"), "h.half")
    inside = rows.withColumn("_n", F.row_number().over(w))
    sizes = inside.groupBy("archive").agg(F.count("*").alias("n")).withColumn("lead", lead)
    before = Window.orderBy("lead", F.lower("archive")).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("archive", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return inside.join(bases, "archive").select((F.col("base") + F.col("_n")).alias("pdf_page"), F.regexp_replace("archive", r"\.[^.]*$", "").alias("issue"), _name(F.col("member")).alias("source_image"), F.col("spread").alias("from_spread"), F.col("h.declared_page").alias("declared_page"))


def _name(member: Column) -> Column:
    return F.element_at(F.split(member, "/"), -1)


def alignment(manifest_: DataFrame) -> DataFrame:
    have = F.col("declared_page").isNotNull()
    return manifest_.agg(F.count_if(have & (F.col("declared_page") == F.col("pdf_page"))).alias("aligned"), F.count_if(have).alias("declared"))
