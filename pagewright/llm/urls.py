"""URL filters: rules on host and path, and a Bloom filter cascade for the hosts that no rule fits.

The list is a table of keys. A cascade is exact for every key of the universe it was built over. Its first level encodes the
listed keys, the next the other keys that the first lets through by mistake, the next the listed
keys that this one lets through, and so on until nobody passes by mistake. The universe here is
every host of the corpus, so a verdict needs no join with the list.

Keys are dealt over shards of a bounded number of keys; a shard's cascade is built in one
task. Cascades are broadcast in passes of bounded size, and each pass judges the rows of its shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import written

#: Keys of a shard on average; about 200 KB of cascade at most.
SHARD_KEYS = 100_000
#: Bytes of cascades that are broadcast at a time.
PASS_BYTES = 64 << 20
#: A false positive's chance at the first level and at the others.
FIRST_RATE, RATE = 1 / 16, 1 / 2
LEVELS = 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_verdict(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host/path) that fits, else nulls."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host_ == name) | F.endswith(host_, F.lit("." + name))) & F.startswith(path_, F.lit(slash + rest))
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    return rule, verdict


def _places(h1: np.ndarray, h2: np.ndarray, level: int, hashes: int, size: int) -> np.ndarray:
    """Bits of each key at a level, a row for each key. Levels mix the hashes anew."""
    with np.errstate(over="ignore"):
        a = (h1.astype(np.uint64) + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        a ^= a >> np.uint64(32)
        b = ((h2.astype(np.uint64) ^ np.uint64(level) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        b ^= (b >> np.uint64(29)) << np.uint64(1)
        return (a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(size)


def build_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Levels (hashes, bits, packed bits) over a universe of keys, each given by two hashes."""
    levels, inside, outside = [], np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(inside):
        if len(levels) == LEVELS:
            raise ValueError("two keys share both hashes; a cascade can't tell them apart")
        rate = RATE if levels else FIRST_RATE
        hashes = max(1, round(-np.log2(rate)))
        size = max(64, int(np.ceil(1.44 * len(inside) * -np.log2(rate))))
        bits = np.zeros(size, dtype=bool)
        bits[_places(h1[inside], h2[inside], len(levels), hashes, size).ravel()] = True
        passed = bits[_places(h1[outside], h2[outside], len(levels), hashes, size)].all(axis=1) if len(outside) else np.zeros(0, dtype=bool)
        levels.append((hashes, size, np.packbits(bits).tobytes()))
        inside, outside = outside[passed], inside
    return levels


def member(levels: list[tuple[int, int, np.ndarray]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed: the first level that rejects it says by its number."""
    out, open_ = np.zeros(len(h1), dtype=bool), np.arange(len(h1))
    for i, (hashes, size, bits) in enumerate(levels):
        inside = bits[_places(h1[open_], h2[open_], i, hashes, size)].all(axis=1)
        out[open_[~inside]] = i % 2 == 1
        open_ = open_[inside]
    out[open_] = len(levels) % 2 == 1
    return out


def _hashed(df: DataFrame, shards: int) -> DataFrame:
    df = df.withColumn("h1", F.xxhash64("key")).withColumn("h2", F.xxhash64(F.lit(7), "key"))
    return df.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))


def cascades(universe: DataFrame, shards: int) -> DataFrame:
    """shard, level, hashes, size, bits over ``universe`` (distinct key, listed)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = build_levels(pdf.h1.to_numpy(), pdf.h2.to_numpy(), pdf.listed.to_numpy(dtype=bool))
        return pd.DataFrame([(pdf.shard.iloc[0], i, *x) for i, x in enumerate(levels)], columns=["shard", "level", "hashes", "size", "bits"])

    return _hashed(universe, shards).select("shard", "h1", "h2", "listed").groupBy("shard").applyInPandas(build, "shard int, level int, hashes int, size long, bits binary")


def with_membership(rows: DataFrame, key: str, listed: DataFrame, shard_keys: int = SHARD_KEYS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``rows`` with a boolean ``listed``: whether the string ``key`` is among those of ``listed``, a table of one column.

    The list is joined once, with the distinct keys, when cascades are built; rows meet cascades
    only, a pass of at most ``pass_bytes`` at a time, whose result is written before the next is loaded. Null is never
    listed, repeated rows and listed keys that no row has change nothing, an empty table gives none. Columns
    come back unchanged whatever their names, but for one named listed, which is replaced.
    """
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c != "listed"]
    rows = rows.select(F.struct(*[rows[f"`{c}`"] for c in columns]).alias("item"), rows[f"`{key}`"].alias("key"))
    names = listed.select(listed[f"`{listed.columns[0]}`"].alias("key")).where("key IS NOT NULL").distinct().withColumn("listed", F.lit(True))
    universe = rows.where("key IS NOT NULL").select("key").distinct().join(names, "key", "left")
    universe = written(universe.select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
    shards = max(1, -(-universe.count() // shard_keys))
    made = written(cascades(universe, shards))
    sizes = {r[0]: r[1] for r in made.groupBy("shard").agg(F.sum(F.octet_length("bits")).alias("b")).collect()}
    passes, held = [[0, 0]], 0
    for s in range(shards):
        if held and held + sizes.get(s, 0) > pass_bytes:
            passes.append([s, s])
            held = 0
        passes[-1][1], held = s + 1, held + sizes.get(s, 0)
    # rows without a key go with the first shard
    hashed = _hashed(rows, shards).withColumn("shard", F.when(F.col("key").isNull(), 0).otherwise(F.col("shard")))
    if len(passes) > 1:
        hashed = written(hashed)
    schema = f"item {hashed.schema['item'].dataType.simpleString()}, listed boolean"
    out = None
    for a, b in passes:
        part = made.where(F.col("shard").between(a, b - 1)).orderBy("shard", "level").collect()  # at most pass_bytes
        levels: dict[int, list] = {}
        for r in part:
            levels.setdefault(r["shard"], []).append((r["hashes"], r["size"], bytes(r["bits"])))
        sent = spark.sparkContext.broadcast(levels)

        def judge(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ready = {s: [(k, n, np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)) for k, n, x in v] for s, v in sent.value.items()}
            for batch in batches:
                shard, h1, h2 = (batch.column(c).to_numpy() for c in ("shard", "h1", "h2"))
                found = np.zeros(batch.num_rows, dtype=bool)
                for s in np.unique(shard):
                    at = np.flatnonzero(shard == s)
                    found[at] = member(ready.get(int(s), []), h1[at], h2[at])
                found &= ~batch.column("key").is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(found)], names=["item", "listed"])

        done = hashed.where(F.col("shard").between(a, b - 1)).mapInArrow(judge, schema)
        if len(passes) > 1:
            done = written(done)
            sent.unpersist()
        out = done if out is None else out.unionByName(done)
    return out.select("item.*", "listed")


def judge(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages`` (page_id, url, ...).

    A null url and one without ``://`` have empty host and path, which no rule fits. ``listed``
    is a table of hosts. Extra columns are ignored, whatever their names, repeated rows are judged
    alike, and an empty table gives none. Of rules that fit, the longest wins.
    """
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    judged = with_membership(parsed, "host", listed)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
