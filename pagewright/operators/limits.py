"""The token bucket as a window, and what callers report about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import patterns as P


def effective_rate(rpm: int = P.LLM_RPM, safety: float = P.RATE_SAFETY) -> int:
    return max(1, int(rpm * safety))


def token_bucket(requests: DataFrame, per_minute: int, capacity: int = 1) -> DataFrame:
    """``requests`` (key, seq, arrival in microseconds) with the microsecond of each grant, in order of arrival.

    With spacing S and place i, a grant is the later of the arrival and i S plus the largest
    earlier arrival less its own place times S, less (capacity - 1) S: a running maximum. It is taken
    inside at most 4,097 ranges of time and then over the ranges of a key, so one key may hold all requests.
    """
    spacing = 60_000_000 // per_minute
    ends = requests.agg(F.min("arrival"), F.max("arrival")).first()
    width = 1 if ends[0] is None else (ends[1] - ends[0]) // 4096 + 1
    own = Window.partitionBy("key", "_r").orderBy("arrival", "seq")
    rows = requests.withColumn("_r", F.expr(f"arrival div {width}L")).withColumn("_i", (F.row_number().over(own) - 1).cast("long"))
    rows = rows.withColumn("_v", F.col("arrival") - F.col("_i") * spacing).withColumn("_m", F.max("_v").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    ahead = Window.partitionBy("key").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("key", "_r").agg(F.count("*").alias("n"), F.max("_v").alias("v")).withColumn("_base", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    ranges = ranges.withColumn("_before", F.max(F.col("v") - F.col("_base") * spacing).over(ahead)).select(F.col("key").alias("_key"), F.col("_r").alias("_range"), "_base", "_before")
    placed = rows.join(ranges, F.col("key").eqNullSafe(F.col("_key")) & F.col("_r").eqNullSafe(F.col("_range")))
    most = F.greatest(F.col("_m") - F.col("_base") * spacing, F.col("_before"))
    granted = F.greatest(F.col("arrival"), (F.col("_i") + F.col("_base") - (capacity - 1)) * spacing + most)
    out = placed.withColumn("granted", F.coalesce(granted, F.col("arrival"))).withColumn("wait", F.col("granted") - F.col("arrival"))
    return out.select(*requests.columns, "granted", "wait")


def stats(granted: DataFrame) -> DataFrame:
    """What each key did: requests, those that waited, microseconds waited in all, and, where ``granted`` has an ``error`` column, quota errors."""
    quota = [F.count_if(is_quota(F.col("error"))).alias("quota_errors")] if "error" in granted.columns else []
    return granted.groupBy("key").agg(F.count("*").alias("requests"), F.count_if(F.col("wait") > 0).alias("throttled"), F.sum("wait").alias("total_wait"), *quota)


def is_quota(message: Column) -> Column:
    return F.contains(message, F.lit(P.QUOTA_MARKS[0])) | F.contains(message, F.lit(P.QUOTA_MARKS[1]))


def retry_delay(message: Column, attempt: Column) -> Column:
    """Seconds to wait after a quota error: what the message asks plus one, else 5 * 2**attempt, at most 65; null for other errors."""
    told = F.coalesce(*[F.nullif(F.regexp_extract(message, p, 1), F.lit("")).cast("double") for p in P.RETRY_DELAYS])
    return F.when(is_quota(message), F.least(F.coalesce(told + 1, 5 * F.pow(F.lit(2.0), attempt)), F.lit(65.0)))
