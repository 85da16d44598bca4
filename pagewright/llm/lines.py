"""Quality rules with cross-document line frequency, with DataFrame functions only.

Lines are normalised and hashed; for each host (here: source) the distinct documents with a
line are counted. Lines in more documents than the limit are boilerplate and are removed; a
document that keeps too few of its words is rejected.

Copies of one document must not look like boilerplate, so documents are told apart by their
texts: rows whose texts are identical without white space count as one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import SPACES, compact, let, place, retexted, stable, whole, written

#: A line is boilerplate in a host if more distinct documents have it than both of these say.
LEAST_LIMIT, HOST_SHARE = 20, 0.005
#: A document is depleted if less than this share of its words remains.
LEAST_LEFT = 0.3
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50


def _words(text: Column) -> Column:
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that the text has twice or more: windows are sorted by
    hash so that equal ones are neighbours, then their places by position."""

    def places(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def twice(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    marked = let(words, lambda w: let(F.sort_array(places(w)), lambda s: let(F.sort_array(twice(s)), covered)))
    return F.when(F.size(words) >= 3, marked).otherwise(F.lit(0).cast("long"))


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, white space as one blank."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")), "[0-9]", "0"))


def _hash60(text: Column) -> Column:
    """60 bits of the MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def line_hash(line: Column) -> Column:
    return _hash60(normal_line(line))


def _shape(docs: DataFrame) -> DataFrame:
    """One scan: base counts, the text's identity and the (hash, words) of each line that has a word."""
    rows = docs.select("doc_id", F.col("source").alias("host"), F.coalesce("text", F.lit("")).alias("text"), *place(docs))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    counted = let(lines, lambda x: F.struct(
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.transform(x, lambda y: F.struct(line_hash(y).alias("h"), F.size(_words(y)).alias("n"))).alias("lines")))
    of_words = let(_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")))
    of_text = let(compact(F.col("text")), lambda t: F.struct(F.length(t).cast("long").alias("word_chars"), _hash60(t).alias("copy")))
    got = rows.select(
        "file", "at", "doc_id", "host",
        of_words.alias("w"), counted.alias("l"), of_text.alias("t"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    # numbered where it is written: the number is read from the table from now on, never made again
    number = F.monotonically_increasing_id().alias("row")
    got = got.select(number, "file", "at", "doc_id", "host", "t.copy", "w.n_words", "t.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.lines")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return got.withColumn("base_failed", failed)


def _frequent(shaped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the lines of all documents; host and hash of lines above the limit)."""
    host = F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("host")
    lines = shaped.select("row", host, F.inline("lines"))
    # a line is one row a document and copies are one before anything is counted; both sums combine before they move
    seen = shaped.select(host, "copy", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).distinct()
    seen = seen.groupBy("host", "h").agg(F.count("*").alias("documents")).where(F.col("documents") > LEAST_LIMIT)
    hosts = shaped.where("n_words > 0").select(host, "copy").distinct().groupBy("host").agg(F.count("*").alias("of_host"))
    often = seen.join(hosts, "host").where(F.col("documents") > F.col("of_host") * HOST_SHARE)
    return lines, written(often.select("host", "h"))


def _judged(docs: DataFrame) -> DataFrame:
    shaped = written(_shape(docs))
    lines, often = _frequent(shaped)
    lost = lines.join(often, ["host", "h"]).groupBy("row").agg(F.sum("n").alias("lost"), F.collect_set("h").alias("boilerplate"))
    out = shaped.drop("lines", "host").join(lost, "row", "left").withColumn("n_left", F.col("n_words") - F.coalesce("lost", F.lit(0)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_left") >= LEAST_LEFT * F.col("n_words")))


def judge(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, source, ...): doc_id, the counts, base_failed, n_left and kept.

    Null text counts as empty, which fails the base rule; a null source is a host of its own.
    Repeated rows are one document for the counts of lines and get a row each; a line at a
    limit stays. Extra columns are ignored, whatever their names; an empty table gives none.
    ``n_left`` is the number of words outside boilerplate lines.
    """
    return _judged(stable(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", "kept")


def clean(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` without their boilerplate lines; n_chars follows the text, other columns are unchanged.

    Null and empty texts and null sources are judged as by ``judge``; repeated rows, also those of a
    file that is read twice, stay repeated. Any names of columns are fine; an empty table stays empty.
    """
    docs = stable(docs)
    verdict = written(_judged(docs).where("kept").select("file", "at", "boilerplate"))
    rows = whole(docs).join(verdict, ["file", "at"])
    left = F.filter(F.split("doc.text", "\n"), lambda x: ~F.coalesce(F.array_contains("boilerplate", line_hash(x)), F.lit(False)))
    text = F.when(F.col("boilerplate").isNull(), F.col("doc.text")).otherwise(F.array_join(left, "\n"))
    return retexted(rows.select("doc", text.alias("text")), docs)
