"""What Python workers get at once, and how often."""

import pytest
from pyspark.sql import functions as F

from pagewright.operators import chunks as C
from pagewright.operators import retrieval as R
from pagewright.sources import tables as T

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
PAGE = "book string, pdf_index int, printed_page string, is_front_matter boolean, is_index boolean, chapter_id int, lines array<string>"


@pytest.fixture
def usual(spark):
    spark.conf.unset(LIMIT)
    yield spark
    spark.conf.unset(LIMIT)


def pages(spark, n=3):
    return spark.createDataFrame([("a", i, str(i), False, False, 0, lines) for i, lines in enumerate([["one two", None], [], None, ["x"] * 40][: n + 1])], PAGE)


def evaluated(df, name):
    return sum(f"{name}(" in x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "ArrowEvalPython" in x)


def test_a_page_is_cut_and_a_chunk_counted_once(usual):
    cut = C.chunk(pages(usual))
    assert evaluated(cut, "cut") == 1
    assert sorted((r.pdf_index, r.line_start, r.line_end, r.body) for r in cut.collect()) == [(0, 1, 2, "one two\n"), (3, 1, 40, "\n".join(["x"] * 40))]
    texts = usual.createDataFrame([("a", "c1", 2, "red Red blue"), ("a", "c2", 0, "--"), ("a", "c3", 0, None)], "book string, chunk string, dl int, text string")
    posts = R.postings(R.counted(texts))
    assert evaluated(posts, "_counted") == 1
    assert sorted(map(tuple, posts.collect())) == [("a", "c1", 2, "blue", 1), ("a", "c1", 2, "red", 2)]


def test_batches_are_bounded_by_bytes_and_a_smaller_limit_stays(usual):
    assert usual.conf.get(LIMIT) == "67108864b"
    C.chunk(pages(usual))
    assert usual.conf.get(LIMIT) == str(T.BATCH_BYTES)
    for limit, then in (("1m", "1m"), ("4096k", "4096k"), ("1g", str(T.BATCH_BYTES)), ("5000000", str(T.BATCH_BYTES))):
        usual.conf.set(LIMIT, limit)
        T.small_batches(usual.range(1))
        assert usual.conf.get(LIMIT) == then


def test_a_task_of_many_bytes_is_many_batches(usual):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    rows = usual.range(0, 800, numPartitions=1).select(F.repeat(F.lit("x"), 50_000).alias("text"))
    seen = [r.n for r in T.small_batches(rows).mapInArrow(sizes, "n long").collect()]
    assert sum(seen) >= 40_000_000 and max(seen) < 2 * T.BATCH_BYTES
