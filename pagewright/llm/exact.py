"""Exact duplicates by deterministic block naming, with DataFrame functions only.

A normalised text is cut into blocks of fixed size. Distinct blocks are sorted and numbered;
then adjacent numbers of a document are paired, distinct pairs sorted and numbered, and so on
until each document has one number. Two documents get the same number at the same level
exactly if their texts are equal.

Blocks travel once. They are grouped by a hash, and a group is numbered by that hash only
after its smallest and largest block have been found equal; blocks whose hash two different
blocks share are grouped by the whole block instead. So no collision can merge documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import compact, let, place, stable, whole, written

BLOCK_BYTES = 4096


def _numbered(keys: DataFrame, *by: str) -> DataFrame:
    """Distinct ``keys`` with an integer name in sort order, written so that names can't change."""
    return written(keys.orderBy(*by).withColumn("name", F.monotonically_increasing_id()))


def block_hash(block: Column) -> Column:
    return F.xxhash64(block)


def _cut(norm: Column, size: int) -> Column:
    """The blocks of a text, bytes, at least one."""
    last = lambda t: F.greatest(F.lit(0), F.floor((F.octet_length(t) - 1) / size)).cast("int")
    return let(F.encode(norm, "UTF-8"), lambda t: F.transform(F.sequence(F.lit(0), last(t)), lambda i: F.substring(t, i * size + 1, F.lit(size))))


def identities(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """file, at, doc_id, n_points, text_sha256, level, name for each row of a ``stable`` table; (level, name) is the text's identity.

    Null texts count as empty, and empty texts are equal; ties don't occur, as names are those of
    contents. Repeated rows keep their own places. Other columns aren't read; an empty table gives none.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *place(docs))
    rows = rows.select("file", "at", "doc_id", F.length("text").cast("long").alias("n_points"), compact(F.col("text")).alias("norm"))
    blocks = rows.select("file", "at", F.posexplode(_cut(F.col("norm"), size)).alias("i", "block"))

    head = rows.select("file", "at", "doc_id", "n_points", let(F.col("norm"), lambda t: F.struct(F.sha2(t, 256).alias("text_sha256"), F.transform(_cut(t, size), block_hash).alias("hashes"))).alias("x"))
    # numbered where it is written: the number is read from the table from now on, never made again
    head = written(head.select(F.monotonically_increasing_id().alias("row"), "file", "at", "doc_id", "n_points", "x.text_sha256", "x.hashes"))
    hashes = head.select("row", F.size("hashes").alias("n"), F.posexplode("hashes").alias("i", "hash"))

    content = blocks.select("file", "at", "i", "block", block_hash(F.col("block")).alias("hash"))
    seen = written(content.groupBy("hash").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).select("hash", (F.col("lo") != F.col("hi")).alias("mixed")))
    mixed = seen.where("mixed").select("hash")
    plain = seen.where("NOT mixed").select("hash", F.lit(None).cast("binary").alias("block"))
    if mixed.limit(1).count():
        shared = content.join(mixed, "hash", "left_semi")
        names = _numbered(plain.unionByName(shared.select("hash", "block").distinct()), "hash", "block")
        apart = shared.join(names.where("block IS NOT NULL"), ["hash", "block"]).join(head.select("row", "file", "at"), ["file", "at"])
        apart = written(apart.select("row", "i", "name"))
        simple = hashes.join(names.where("block IS NULL").select("hash", "name"), "hash").select("row", "n", "i", "name")
        level = written(simple.unionByName(hashes.select("row", "n", "i").join(apart, ["row", "i"])))
    else:
        names = _numbered(plain.select("hash"), "hash")
        level = written(hashes.join(names, "hash").select("row", "n", "i", "name"))

    done, k = [], 0
    while True:
        done.append(level.where("n = 1").select("row", F.lit(k).alias("level"), "name"))
        more = level.where("n > 1")
        if not more.limit(1).count():
            break
        half = F.expr("i div 2").alias("i")
        name_at = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
        pairs = more.groupBy("row", ((F.col("n") + 1) / 2).cast("int").alias("n"), half).agg(name_at(0).alias("a"), F.coalesce(name_at(1), F.lit(-1)).alias("b"))
        pairs = written(pairs)
        names = _numbered(pairs.select("a", "b").distinct(), "a", "b")
        level, k = written(pairs.join(names, ["a", "b"]).select("row", "n", "i", "name")), k + 1
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    return head.drop("hashes").join(found, "row")


def _judged(docs: DataFrame, size: int) -> DataFrame:
    members = written(identities(docs, size))
    best = F.max(F.struct("n_points", -F.col("doc_id"), -F.col("row")))
    groups = members.groupBy("level", "name").agg(best.alias("b"), F.count("*").alias("group_size"))
    groups = written(groups.select("level", "name", "group_size", (-F.col("b.col2")).alias("keep_id"), (-F.col("b.col3")).alias("keep_row")))
    return members.join(groups, ["level", "name"]).withColumn("kept", F.col("row") == F.col("keep_row"))


def exact_duplicates(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without the white space of the contracts; null counts
    as empty, and empty texts are equal. Of a group the row with the most code points stays,
    then the smallest doc_id (null last), then the first row, so repeated rows leave one; rows of
    a file that is read twice are repeated rows. Extra columns are ignored, whatever their names; an empty table gives none.
    """
    return _judged(stable(docs), size).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_one(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one that ``exact_duplicates`` keeps; its columns unchanged.

    Null and empty texts are one group; of repeated rows, also those of a file that is read twice, one stays. Any names of columns are fine; an empty table stays empty.
    """
    docs = stable(docs)
    gone = _judged(docs, size).where("NOT kept").select("file", "at")
    return whole(docs).join(gone, ["file", "at"], "left_anti").select("doc.*")
