"""How often texts move, and what a task of the index holds."""

import random

from pyspark.sql import functions as F

from pagewright.operators import index as I
from pagewright.operators import retrieval as R
from pagewright.plans import binding as B
from pagewright.sources import tables as T

LIMITS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


def test_texts_move_once_to_their_places(spark, small):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        df = B._book_pages(spark, small)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert sum("Exchange hashpartitioning(_file" in x for x in plan.split("\n")) == 2  # texts, places


def test_context_moves_ranks_and_not_texts(spark, tmp_path):
    spark.range(3000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk"), F.sha2(F.col("id").cast("string"), 512).alias("text")).write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    ranked = spark.range(100_000).where("id < 3").select(F.lit(1).alias("query_id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk"), (F.col("id") + 1).alias("rank"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
        got = R.context(ranked, chunks)
        rows = got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    texts = dict(map(tuple, chunks.collect()))
    assert [tuple(r) for r in rows] == [(1, "\n\n".join(texts[f"c{i}"] for i in range(3)))]
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_tasks_of_the_index_are_small_and_limits_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "TASK_BYTES", 1 << 15, raising=False)
    monkeypatch.setattr(T, "FILE_COST", 1, raising=False)
    monkeypatch.setattr(I, "GROUP_BYTES", 1 << 16, raising=False)
    r = random.Random(2)
    rows = [("a", f"a/{i:05d}", i, 0, " ".join(f"w{r.randrange(5000)}" for _ in range(60))) for i in range(3000)]
    chunks = spark.createDataFrame(rows, "book string, chunk string, pdf_index int, chapter_id int, text string")
    before = [spark.conf.get(c) for c in LIMITS]
    index = I.KeptIndex(spark, str(tmp_path / "i"))
    index.ingest(chunks.coalesce(1))
    assert [spark.conf.get(c) for c in LIMITS] == before
    posts = index.open().postings
    held = posts.groupBy(F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1).alias("task")).agg(F.count("*").alias("n")).collect()
    total = sum(x.n for x in held)
    assert len(held) >= 4 and max(x.n for x in held) < total / 2
    assert total == sum(len(set(x[4].split())) for x in rows)
    assert posts.where("chunk = 'a/00007'").count() == len(set(rows[7][4].split()))


def test_the_limits_of_tasks_nest(spark):
    before = [spark.conf.get(c) for c in LIMITS]
    with T.small_tasks(spark):
        with T.small_tasks(spark):
            assert [spark.conf.get(c) for c in LIMITS] == [str(T.TASK_BYTES), str(T.FILE_COST)]
        assert [spark.conf.get(c) for c in LIMITS] == [str(T.TASK_BYTES), str(T.FILE_COST)]
        spark.range(1).count()
    assert [spark.conf.get(c) for c in LIMITS] == before
    try:
        spark.conf.set(LIMITS[0], "1m")
        with T.small_tasks(spark):
            assert spark.conf.get(LIMITS[0]) == "1m"
    finally:
        for c, was in zip(LIMITS, before, strict=True):
            spark.conf.set(c, was)
