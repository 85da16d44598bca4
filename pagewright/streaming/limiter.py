"""The token bucket over a stream: the same running maximum, kept by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def token_bucket(requests: DataFrame, per_minute: int, capacity: int = 1) -> DataFrame:
    """Grants of a stream (key, seq, arrival in microseconds).

    State is two numbers a key: the requests so far and the largest arrival less its place.
    Requests of a batch are taken in order of arrival; over batches the stream's order counts,
    so batch and stream agree for input in order.
    """
    spacing = 60_000_000 // per_minute

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, ahead = state.get if state.exists else (0, None)
        rows = pd.concat(list(parts)).sort_values(["arrival", "seq"])
        a = rows["arrival"].to_numpy(dtype=np.int64)
        i = seen + np.arange(len(a), dtype=np.int64)
        slack = a - i * spacing
        first = slack[:1] if ahead is None else np.array([ahead], dtype=np.int64)
        before = np.maximum.accumulate(np.concatenate([first, slack[:-1]]))
        granted = np.maximum(a, i * spacing + before - (capacity - 1) * spacing)
        state.update((int(seen + len(a)), int(max(before[-1], slack[-1]))))
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"].to_numpy(), "granted": granted, "wait": granted - a})

    kind = requests.schema["key"].dataType.simpleString()
    return requests.groupBy("key").applyInPandasWithState(step, f"key {kind}, seq long, granted long, wait long", "seen long, ahead long", "append", GroupStateTimeout.NoTimeout)
