"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

The words of a source form one stream, its documents in the order of a seeded hash, cut into
blocks of equally many words. Seats are blocks: highest quotients give each source an integer
quota of blocks for its target, then each shard of a source (a run of blocks) its part of the
quota. A shard takes all its blocks as often as the quota holds them, and the rest as one run of
blocks that begins at a seeded place and goes round the shard's end. So nearly all documents
are taken whole or not at all, and those at the ends of a run as one contiguous part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import SPACES, let, place, retexted, running, stable, whole, written

SEED = "mix-1"
WEIGHTS = (5, 2, 1)
#: Times a source, and so a document, is used at most.
MOST_REPEATS = 3
BLOCK_WORDS = 8
#: A shard has so many blocks, or more where a source would else have more shards than SHARDS.
SHARD_BLOCKS, SHARDS = 1 << 15, 4096


def word_count(text: Column) -> Column:
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.coalesce(F.size(F.array_remove(F.split(text, " "), "")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (key, source_size) with weight and target; keys in sort order take the weights in turn.

    Targets share the whole size by weight and stop at MOST_REPEATS times a source's size. In
    order of size by weight the capped sources come first, so the common level is found from
    running sums over the sources.
    """
    sources = written(sources)
    n = sources.count()
    ranked = running(sources, ["key"], [], n)
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS)).cast("int"))
    s = ranked.select("key", "source_size", weight.cast("long").alias("weight"), (MOST_REPEATS * F.col("source_size")).alias("cap"))
    s = written(s.withColumn("ratio", F.col("cap") / F.col("weight")))
    all_ = s.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weights = all_[0] or 0, all_[1] or 0
    s = written(running(s, ["ratio", "key"], ["cap", "weight"], n))
    level = (F.lit(total) - F.col("before_cap")).cast("double") / (F.lit(weights) - F.col("before_weight"))
    free = F.col("cap") > level * F.col("weight")
    found = s.agg(F.min(F.when(free, F.struct("ratio", "key", level.alias("level")))).alias("x")).first()["x"]
    if found is None:
        target = F.col("cap").cast("double")
    else:
        shared = F.lit(found["level"]) * F.col("weight")
        target = F.when(F.col("cap") <= shared, F.col("cap").cast("double")).otherwise(shared)
    return s.select("key", "source_size", "weight", target.alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """``parties`` with quota: seats of each group by highest quotients votes / (2 k - 1), ties by party.

    Rounding votes at the mean divisor is off by at most half a seat a party. Only quotients
    near that level are then ranked, about four a party, instead of one for each seat. Groups are
    ranked in a task each; without a group all parties are, in two steps.
    """
    number = F.col(votes).cast("double")
    if group:
        sums = parties.groupBy(*group).agg(F.sum(number).alias("_v"), F.count("*").alias("_p"))
        p = parties.join(sums, group)
    else:
        sums = parties.agg(F.sum(number), F.count("*")).first()
        p = parties.withColumn("_v", F.lit(sums[0]).cast("double")).withColumn("_p", F.lit(sums[1]).cast("long"))
    # products of doubles: as longs they overflow from 2e11 blocks on
    fair = F.when(F.col("_v") > 0, F.floor(number * F.col(seats) / F.col("_v") + 0.5)).otherwise(0)
    p = p.withColumn("_c", fair.cast("long"))
    if group:
        p = p.join(p.groupBy(*group).agg(F.sum("_c").alias("_given")), group)
    else:
        p = written(p)
        p = p.withColumn("_given", F.lit(p.agg(F.sum("_c")).first()[0]).cast("long"))
    p = written(p.withColumn("_d", F.when(F.col("_v") > 0, F.col(seats) - F.col("_given")).otherwise(0).cast("long")).drop("_given"))
    reach = (F.floor(number * (F.abs("_d") + F.col("_p")) / F.col("_v")) + 2).cast("long")
    up = F.transform(F.sequence(F.lit(1).cast("long"), reach), lambda k: F.col("_c") + k)
    down = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), reach), lambda k: F.col("_c") - k), lambda k: k > 0)
    near = p.where("_d <> 0").select(*group, party, "_d", F.explode(F.when(F.col("_d") > 0, up).otherwise(down)).alias("_k"), number.alias("_n"))
    # the next seats go to the highest quotients, the last party and seat of equal ones loses first
    near = near.withColumn("_q", F.signum("_d") * -F.col("_n") / (2 * F.col("_k") - 1)).withColumn("_t", F.signum("_d") * F.col("_k"))
    if group:
        ahead = F.when(F.col("_d") > 0, F.col(party)), F.when(F.col("_d") < 0, F.col(party)).desc()
        near = near.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("_q", *ahead, "_t")))
    else:
        near = written(near)
        count = near.count()
        # both orders by ascending columns: parties by their rank, turned round where seats are taken back
        names = running(parties.select(party), [party], [], sums[1]).withColumnRenamed("rank", "_a")
        near = near.join(names, party).withColumn("_a", F.col("_a") * F.signum("_d"))
        near = running(near, ["_q", "_a", "_t"], [], count).withColumnRenamed("rank", "_r")
    change = near.where(F.col("_r") <= F.abs("_d")).groupBy(*group, party).agg(F.sum(F.signum("_d")).cast("long").alias("_change"))
    return p.join(change, [*group, party], "left").withColumn("quota", F.col("_c") + F.coalesce("_change", F.lit(0))).drop("_v", "_p", "_c", "_d", "_change")


def _placed(docs: DataFrame) -> DataFrame:
    """file, at, doc_id, key, size and start (words of the source's stream before the document) of each row of a ``stable`` table."""
    key = F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1"))  # in code point order, null last
    order = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.select("doc_id", key.alias("key"), word_count(F.col("text")).alias("size"), order.alias("order"), *place(docs))
    sized = written(sized.withColumn("bucket", F.substring("order", 1, 3)))
    sums = sized.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 buckets a source
    bases = sums.select("key", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "bucket").orderBy("order", "size", "file", "at").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["key", "bucket"])
    return placed.select("file", "at", "doc_id", "key", "size", (F.col("base") + F.col("inside")).alias("start"))


def quotas(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (key, size): sources with target and quota of blocks; shards with blocks and quota."""
    t = written(targets(sizes.groupBy("key").agg(F.sum("size").alias("source_size"))))
    seats = round((t.agg(F.sum("source_size")).first()[0] or 0) / BLOCK_WORDS)
    t = t.withColumn("seats", F.lit(seats).cast("long"))
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK_WORDS).cast("long"))
    t = sainte_lague(t, [], "key", "target", "seats")
    t = t.withColumn("quota", F.least("quota", MOST_REPEATS * F.col("blocks")))
    t = written(t.withColumn("shard_blocks", F.greatest(F.lit(SHARD_BLOCKS), F.ceil(F.col("blocks") / SHARDS)).cast("long")))
    shards = t.where("blocks > 0").select("key", "blocks", "shard_blocks", F.col("quota").alias("seats"), F.explode(F.expr("sequence(0L, (blocks - 1) div shard_blocks)")).alias("shard"))
    shards = shards.withColumn("n", F.least("shard_blocks", F.col("blocks") - F.col("shard") * F.col("shard_blocks")))
    shards = sainte_lague(shards, ["key"], "shard", "n", "seats")
    shards = shards.withColumn("quota", F.least("quota", MOST_REPEATS * F.col("n")))
    turn = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), "key", F.lit(":"), F.col("shard").cast("string"))), 1, 12), 16, 10).cast("long")
    shards = shards.select("key", "shard", "n", F.expr("quota div n").alias("full"), (F.col("quota") % F.col("n")).alias("rest"), (turn % F.col("n")).alias("turn"))
    return t, written(shards)


def _parts(placed: DataFrame, sources: DataFrame, shards: DataFrame) -> DataFrame:
    """file, at, parts: for each document and shard it lies in, its words as runs (begin, end, copies), first word 0."""
    b = BLOCK_WORDS
    d = placed.where("size > 0").join(sources.select("key", "shard_blocks"), "key")
    d = d.withColumn("shard", F.explode(F.expr(f"sequence((start div {b}) div shard_blocks, ((start + size - 1) div {b}) div shard_blocks)")))
    d = d.join(shards, ["key", "shard"])
    # in words from the document's first: its share of the shard, and the run of blocks taken once more, which may go round the end
    base = F.col("shard") * F.col("shard_blocks") * b - F.col("start")
    inside = lambda x: F.least(F.greatest(x, F.lit(0).cast("long"), base), F.col("size"), base + F.col("n") * b)
    over = F.greatest(F.lit(0).cast("long"), F.col("turn") + F.col("rest") - F.col("n"))
    cuts = [base, base + over * b, base + F.col("turn") * b, base + F.least("n", F.col("turn") + F.col("rest")) * b, base + F.col("n") * b]
    cuts = [inside(c) for c in cuts]
    more = [F.col("full") + 1, F.col("full"), F.col("full") + 1, F.col("full")]
    runs = [F.struct(x.alias("begin"), y.alias("end"), k.cast("long").alias("copies")) for x, y, k in zip(cuts, cuts[1:], more, strict=False)]
    return d.select("file", "at", F.filter(F.array(*runs), lambda r: r["begin"] < r["end"]).alias("parts"))


def mix(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, source, ...): doc_id, size, source_size, target, taken.

    ``taken`` counts the words of the document in the mix, repeats included, at most three
    times its size. Null and wordless texts have size 0 and give nothing; null is a source of its own, last in
    order. An empty table gives none; extra columns are ignored, whatever their names; repeated
    rows, also those of a file that is read twice, are documents of their own. Equal quotients go to the first source in order. The choice
    depends on the seed and the rows only, and for rows that share doc_id and size on their places in the files.
    """
    placed = written(_placed(stable(docs)))
    sources, shards = quotas(placed)
    words = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["begin"]) * x["copies"])
    taken = _parts(placed, sources, shards).groupBy("file", "at").agg(F.sum(words).alias("taken"))
    out = placed.join(taken, ["file", "at"], "left").join(sources.select("key", "source_size", "target"), "key")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each row is a contiguous part of its document, nearly always the whole text.

    A document's words taken k times give k rows. Where a run of blocks begins or ends inside
    a document, the row has its words from there or up to there, and n_chars follows the text. Rows,
    nulls, ties and repeated rows are those of ``mix``; any names of columns are fine; an empty table stays empty.
    """
    docs = stable(docs)
    placed = written(_placed(docs))
    sources, shards = quotas(placed)
    parts = _parts(placed, sources, shards).groupBy("file", "at").agg(F.sort_array(F.flatten(F.collect_list("parts"))).alias("parts"))
    parts = parts.join(placed.select("file", "at", "size"), ["file", "at"]).withColumn("most", F.array_max(F.transform("parts", lambda x: x["copies"]))).where("most > 0")

    def runs(k: Column) -> Column:
        """The maximal runs of words that are taken k times or more."""
        there = F.filter("parts", lambda x: x["copies"] >= k)
        edge = lambda p, q, one: F.filter(F.transform(there, lambda x: x[one]), lambda v: ~F.exists(there, lambda y: y[q] == v))
        return F.zip_with(edge("begin", "end", "begin"), edge("end", "begin", "end"), lambda x, y: F.struct(x.alias("begin"), y.alias("end")))

    parts = parts.select("file", "at", "size", F.flatten(F.transform(F.sequence(F.lit(1).cast("long"), F.col("most")), runs)).alias("runs"))
    rows = whole(docs).join(written(parts), ["file", "at"]).select("doc", "size", F.explode("runs").alias("run"))
    pieces = F.regexp_extract_all(F.col("doc.text"), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    begin, end = F.col("run.begin"), F.col("run.end")
    cut = F.array_join(F.slice(pieces, (begin + 1).cast("int"), (end - begin).cast("int")), "")
    text = F.when((begin == 0) & (end == F.col("size")), F.col("doc.text")).otherwise(cut)
    return retexted(rows.select("doc", text.alias("text")), docs)
