"""Best-fit-decreasing packing of documents into sequences of a fixed number of tokens.

Lengths are integers up to the capacity, so best fit decreasing needs no list of documents:
a histogram of lengths says it all. The driver packs the histogram with a segment tree over
remaining capacities; what it makes is a short plan of intervals ("the pieces of length 300
with ranks 0 to 9,999 go three each into bins 40 to 3,372 from place 100"). Executors then
rank the pieces of each length and look their places up. The packing is the one that a single
pass over all pieces would make, while no task ever holds all pieces of a length.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import written
from pagewright.llm.tokens import encoder, rounds

#: Pieces in one rank group on average; groups of a length are split over shards of the ids.
PIECES_PER_SHARD = 1_000_000
LEAST_SHARDS = 64


class CapacityTree:
    """Segment tree over remaining capacities 0..C; a leaf counts the open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least ``least`` with an open bin, else -1."""
        i = least + self.size
        if self.count[i]:
            return least
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, items in a bin, first bin, place of a bin's first item), by length and rank.

    Equal items go one after another into the tightest bin while it has room, so all bins of a
    capacity, and all items of a length, can be dealt with at once.
    """
    tree, bins, rows, made = CapacityTree(capacity), {}, [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            bins.setdefault(left, []).append((first, n))
            tree.add(left, n)

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            left = tree.tightest(length)
            if left < 0:
                left, n = capacity, -(-todo // (capacity // length))
                first, made = made, made + n
            else:
                first, n = bins[left].pop()
                tree.add(left, -n)
            each = left // length
            full = min(n, todo // each)
            if full:
                rows.append((length, rank, each, first, capacity - left))
                put(left - each * length, first, full)
                rank, todo = rank + full * each, todo - full * each
            if full < n and todo:
                rows.append((length, rank, each, first + full, capacity - left))
                put(left - todo * length, first + full, 1)
                put(left, first + full + 1, n - full - 1)
                todo = 0
            elif full < n:
                put(left, first + full, n - full)
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Tokens of each document with an end id, cut where it is longer than ``capacity``.

    A null text counts as empty: one piece that holds the end id. The first piece of a cut
    document takes the odd length. Other columns of ``docs`` aren't read; repeated rows are
    documents of their own; an empty table gives none. Columns: doc_id,
    piece, start, length, ids_crc32 and, if asked for, ids.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    arrow = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    arrow = pa.schema(arrow + [("ids", pa.list_(pa.int32()))] * with_ids)
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in rounds(batches):
            rows = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids += end
                n = len(ids) // 4
                at, k = 0, (n - 1) % capacity + 1
                for piece in range(-(-n // capacity)):
                    part = ids[4 * at : 4 * (at + k)]
                    rows.append((doc_id, piece, at, k, crc32(part), *[np.frombuffer(part, "<i4")] * with_ids))
                    at, k = at + k, capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(items: DataFrame, capacity: int = 1024) -> DataFrame:
    """``items`` (doc_id, piece, length, ...) with sequence_id and offset; lengths from 1 to the capacity.

    Extra columns are kept, whatever their names; only a sequence_id or offset of the input is
    replaced. Repeated rows are pieces of their own, pieces of one length are ranked by doc_id and piece,
    null first. An empty table gives none.
    """
    spark = items.sparkSession
    items = written(items)
    shards = max(LEAST_SHARDS, -(-items.count() // PIECES_PER_SHARD))
    # one column for the row itself, so that no name in it clashes with those used here
    row = F.struct(*[items[f"`{c}`"] for c in items.columns if c not in ("sequence_id", "offset")]).alias("item")
    shard = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int").alias("shard")
    items = items.select(row, F.col("length").cast("long").alias("length"), "doc_id", "piece", shard)
    counts = items.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # at most `capacity` rows come to the driver, whatever the number of pieces
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = spark.sparkContext.broadcast(plan(histogram, capacity))  # bounded by the capacity, not by the pieces
    rank = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece")) - 1
    ranked = items.withColumn("rank", rank).join(bases, ["length", "shard"]).select("item", "length", (F.col("rank") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = steps.value
        keys = p[:, 0] << 44 | p[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            step = p[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            i = rank - step[:, 1]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(step[:, 3] + i // step[:, 2]), pa.array(step[:, 4] + i % step[:, 2] * length)], names=["item", "sequence_id", "offset"])

    schema = f"item {ranked.schema['item'].dataType.simpleString()}, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).select("item.*", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed rows (with ids) as sequences: sequence_id, ids. A group holds one capacity at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
