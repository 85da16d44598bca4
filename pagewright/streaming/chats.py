"""Conversations over a stream: what each session has said about each book, held as keyed state.

State is the last turns of a (session, book), never more than ``last``, and the number of the last exchange. It
outlives restarts in the stream's checkpoint, and goes when a session has been silent for longer than its time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewright.functions import patterns as P

#: A day.
TIME_TO_LIVE_MS = 86_400_000

SCHEMA = "session string, book string, seq long, history array<struct<role: string, content: string>>"


def histories(exchanges: DataFrame, last: int = P.CLIENT_TURNS, ttl_ms: int = TIME_TO_LIVE_MS) -> DataFrame:
    """(session, book, seq, history) of a stream (session, book, seq, question, answer, error): a row for each exchange, with what the session has said about the book after it.

    An exchange without an error adds the question and then the answer; one with an error adds nothing. Of a
    session the last ``last`` turns stay. Exchanges of a batch are taken in order of seq; one that isn't above the last (one sent twice) or has no seq
    has no row. Books of one session don't mix. A session silent for ``ttl_ms`` begins anew. With the default trigger Spark looks for such
    sessions in batches without data, one after the other; a trigger of some seconds, or spark.sql.streaming.noDataMicroBatches.enabled=false, spares that.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, roles, said = state.get if state.exists else (None, [], [])
        turns = list(zip(roles, said, strict=True))
        out = []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples():
            if seen is not None and r.seq <= seen:
                continue
            seen = int(r.seq)
            if r.error is None or r.error != r.error:
                turns = [*turns, ("user", r.question), ("assistant", r.answer)][-last:]
            out.append((key[0], key[1], seen, [{"role": a, "content": b} for a, b in turns]))
        state.update((seen, [a for a, _ in turns], [b for _, b in turns]))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["session", "book", "seq", "history"])

    rows = exchanges.select("session", "book", F.col("seq").cast("long").alias("seq"), "question", "answer", "error").where("seq IS NOT NULL")
    return rows.groupBy("session", "book").applyInPandasWithState(step, SCHEMA, "seq long, roles array<string>, said array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def histories_of_table(exchanges: DataFrame, last: int = P.CLIENT_TURNS) -> DataFrame:
    """The same rows from a table, of which a seq comes once a session and book."""
    rows = exchanges.where("seq IS NOT NULL").select("session", "book", F.col("seq").cast("long").alias("seq"), "error", F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))).alias("pair"))
    good = F.when(F.col("error").isNull(), F.col("pair"))
    held = Window.partitionBy("session", "book").orderBy("n").rangeBetween(-(-(-last // 2)) + 1, 0)
    n = F.count_if(F.col("error").isNull()).over(Window.partitionBy("session", "book").orderBy("seq"))
    said = rows.withColumn("n", n).withColumn("history", F.flatten(F.transform(F.sort_array(F.collect_list(F.when(good.isNotNull(), F.struct("seq", "pair"))).over(held)), lambda x: x["pair"])))
    return said.select("session", "book", "seq", F.slice("history", F.greatest(F.lit(1), F.size("history") - last + 1), last).alias("history"))


def latest(histories_: DataFrame) -> DataFrame:
    """What a session was left with for each book: a switch of books restores this."""
    return histories_.groupBy("session", "book").agg(F.max_by("history", "seq").alias("history"))
