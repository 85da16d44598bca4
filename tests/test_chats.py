"""Session state over a stream: equal to the table, through restarts, errors and exchanges sent twice."""

import random

import pytest

from pagewright.streaming import chats

SCHEMA = "session string, book string, seq long, question string, answer string, error string"


def exchanges(n):
    r = random.Random(4)
    return [(f"s{r.randrange(3)}", f"b{r.randrange(2)}", i, f"q{i}", f"a{i}", r.choice([None, None, None, "429 broken"])) for i in range(n)]


def plain(rows, last):
    held, out = {}, {}
    for session, book, seq, q, a, error in sorted(rows, key=lambda r: r[2]):
        h = held.setdefault((session, book), [])
        if error is None:
            for turn in (("user", q), ("assistant", a)):
                h.append(turn)
                while len(h) > last:
                    h.pop(0)
        out[session, book, seq] = list(h)
    return out


def of(df):
    return {(r.session, r.book, r.seq): [tuple(t) for t in r.history] for r in df.collect()}


@pytest.mark.parametrize("last", [12, 5])
def test_table_equals_a_loop(spark, last):
    rows = exchanges(120)
    df = spark.createDataFrame([*rows, ("s0", "b0", None, "x", "y", None)], SCHEMA)
    assert of(chats.histories_of_table(df, last)) == plain(rows, last)


@pytest.fixture
def data_batches_only(spark):
    """A stream with time-outs runs batches without data for ever, unless this is set; time-outs are then met by the next data."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_stream_equals_the_table_through_restarts(spark, data_batches_only, tmp_path):
    rows = exchanges(90)
    for k in range(3):
        part = rows[30 * k : 30 * k + 30]
        again = rows[30 * k - 4 : 30 * k] if k else []  # sent twice
        spark.createDataFrame(part + again, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        # a new query from the checkpoint each time: a restart
        q = chats.histories(source).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
        assert q.awaitTermination(60) and q.exception() is None
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 90 and of(out) == plain(rows, 12)
    last = {(r.session, r.book): [tuple(t) for t in r.history] for r in chats.latest(out).collect()}
    want = {}
    for (s, b, n), h in sorted(plain(rows, 12).items(), key=lambda x: x[0][2]):
        want[s, b] = h
    assert last == want
