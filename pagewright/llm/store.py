"""A content-addressed store of token ids.

A gear hash over the ids cuts each document's stream into chunks at places that depend on
nearby ids only, so an insertion moves a few cuts and equal passages give equal chunks. A
chunk's name is the SHA-256 of its ids; each chunk is stored once. A document's recipe lists
its chunks and the Merkle root over their names; the manifest has the root of each shard of
recipes. Reading back holds every chunk against its name and every recipe against its root.

Files below the store's folder (Parquet with zstd):
  chunks    digest, doc_id, row, seq, n; data is set in one row of each digest and null elsewhere
  recipes   shard, doc_id, row, start, n_tokens, digests, lengths, root,
            after (ids behind each chunk); ascending by doc_id
  manifest  shard, documents, tokens, root
Ids are unsigned little-endian of ``width`` bytes, 2 if the vocabulary allows it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import stable
from pagewright.llm.tokens import encoder, rounds

MEAN_CHUNK, LEAST_CHUNK, MOST_CHUNK = 512, 128, 4096
#: Ids that a cut depends on.
SPAN = 32
#: Rows of chunks without data are dealt over so many salts, as one chunk may be in a third of all documents.
SALTS = 64


def _gear(ids: np.ndarray) -> np.ndarray:
    """For each id a mixed hash of it and the SPAN - 1 ids before: doubled sums of shifted terms."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    k = 1
    while k < SPAN:
        later = h.copy()
        later[k:] += h[:-k] << np.uint64(k) if k < len(h) else np.uint64(0)
        h, k = later, 2 * k
    return h


def cuts(ids: np.ndarray, mean: int = MEAN_CHUNK, least: int = LEAST_CHUNK, most: int = MOST_CHUNK) -> list[int]:
    """Ends of the chunks; the last is len(ids)."""
    bits = max(1, (mean - least).bit_length() - 1)
    marks = np.flatnonzero(_gear(ids) >> np.uint64(64 - bits) == 0) + 1 if len(ids) > least else []
    ends, at = [], 0
    for m in [*(int(x) for x in marks), len(ids)]:
        while m - at > most:
            at += most
            ends.append(at)
        if m - at >= least and m < len(ids):
            at = m
            ends.append(at)
    if at < len(ids):
        ends.append(len(ids))
    return ends


def merkle(names: list[bytes]) -> bytes:
    """Root over leaf hashes; leaves and inner nodes are told apart, an odd node goes up as it is."""
    level = [sha256(b"\0" + x).digest() for x in names]
    while len(level) > 1:
        level = [sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else sha256(b"").digest()


def chunks(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """A row for each chunk of each document; data only where this task sees the digest first."""
    schema = "doc_id long, row long, seq int, n int, digest binary, salt int, data binary"
    arrow = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("seq", pa.int32()), ("n", pa.int32()), ("digest", pa.binary()), ("salt", pa.int32()), ("data", pa.binary())])
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(tokenizer).encode, set()
        for batch in rounds(batches):
            rows = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if len(seen) > 500_000:
                seen.clear()  # a digest is then sent again; the store still keeps one
            for doc_id, row, ids in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), encode(texts), strict=True):
                ids = np.frombuffer(ids + end, "<u4")
                narrow, at = ids.astype(f"<u{width}").tobytes(), 0
                for seq, to in enumerate(cuts(ids)):
                    data = narrow[width * at : width * to]
                    digest = sha256(data).digest()
                    known = digest in seen
                    seen.add(digest)
                    rows.append((doc_id, row, seq, to - at, digest, 1 + row % SALTS if known else 0, None if known else data))
                    at = to
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    # the scan's own row number: the same in each attempt at a task over a ``stable`` table
    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(cut, schema)


def _with_roots(recipes: DataFrame) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in recipes.schema) + ", root binary, after array<long>"

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            root = pa.array([merkle(x) for x in b.column("digests").to_pylist()], pa.binary())
            ends = [np.cumsum(x, dtype=np.int64) for x in b.column("lengths").to_pylist()]
            after = pa.array([x[-1] - x for x in ends], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, root, after], names=[*b.schema.names, "root", "after"])

    return recipes.mapInArrow(roots, schema)


def write(docs: DataFrame, at: str, tokenizer: str, end_id: int, width: int = 2) -> None:
    """Write chunks, recipes and manifest below ``at``.

    Null texts count as empty, so each document has at least the end id. Repeated rows are
    documents of their own, told apart by ``row``. Other columns of ``docs`` aren't read.
    """
    spark = docs.sparkSession
    # numbered in a scan of files, so that a task that is tried again gives its rows the same numbers
    docs = stable(docs, moved=False)
    every = chunks(docs, tokenizer, end_id, width).repartition("digest", "salt")
    first = F.row_number().over(Window.partitionBy("digest", "salt").orderBy("doc_id", "row", "seq")) == 1
    every.withColumn("data", F.when(first, F.col("data"))).drop("salt").write.option("compression", "zstd").parquet(f"{at}/chunks")

    listed = spark.read.parquet(f"{at}/chunks").select("doc_id", "row", "seq", "n", "digest")
    parts = F.sort_array(F.collect_list(F.struct("seq", "n", "digest")))
    docs_ = listed.groupBy("doc_id", "row").agg(parts.alias("p"), F.sum("n").alias("n_tokens"))
    docs_ = docs_.select("doc_id", "row", "n_tokens", F.col("p.digest").alias("digests"), F.col("p.n").alias("lengths"))
    ranged = docs_.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").withColumn("shard", F.spark_partition_id())
    _with_roots(ranged).write.option("compression", "zstd").parquet(f"{at}/unplaced")

    placed = spark.read.parquet(f"{at}/unplaced")
    totals = placed.groupBy("shard").agg(F.sum("n_tokens").alias("t"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, not for each document
    bases = totals.select("shard", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    recipes = placed.withColumn("inside", inside).join(bases, "shard").withColumn("start", F.col("base") + F.col("inside")).drop("inside", "base")
    recipes.write.option("compression", "zstd").parquet(f"{at}/recipes")

    # a shard's root is folded from its documents' roots in order, in one pass with constant memory
    back = spark.read.parquet(f"{at}/recipes").select("shard", "doc_id", "row", "n_tokens", "root")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, shard, documents, tokens = sha256(), None, 0, 0
        for b in batches:
            for s, n, root in zip(b.column("shard").to_pylist(), b.column("n_tokens").to_pylist(), b.column("root").to_pylist(), strict=True):
                if s != shard and shard is not None:
                    yield _manifest_row(shard, documents, tokens, h.digest())
                    h, documents, tokens = sha256(), 0, 0
                shard, documents, tokens = s, documents + 1, tokens + n
                h.update(root)
        if shard is not None:
            yield _manifest_row(shard, documents, tokens, h.digest())

    folded = back.repartition("shard").sortWithinPartitions("shard", "doc_id", "row").drop("doc_id", "row")
    folded.mapInArrow(fold, "shard int, documents long, tokens long, root binary").write.parquet(f"{at}/manifest")


def _manifest_row(shard: int, documents: int, tokens: int, root: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([documents], pa.int64()), pa.array([tokens], pa.int64()), pa.array([root], pa.binary())], names=["shard", "documents", "tokens", "root"])


def recipes(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.parquet(f"{at}/recipes")


def _stored(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.parquet(f"{at}/chunks").where("data IS NOT NULL").select("digest", "data")


def read_ids(spark: SparkSession, at: str, width: int = 2) -> DataFrame:
    """The documents rebuilt from recipes and chunks: doc_id, row, data (ids of ``width`` bytes)."""
    wanted = recipes(spark, at).select("doc_id", "row", F.posexplode("digests").alias("seq", "digest"))
    parts = F.sort_array(F.collect_list(F.struct("seq", "data")))
    return wanted.join(_stored(spark, at), "digest").groupBy("doc_id", "row").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("data"))


def _crc_tables() -> np.ndarray:
    """tables[k][j][b]: the register byte ``b`` at place ``j`` after 2**k zero bytes (CRC-32, reflected)."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1)
    step = lambda x: one[x & 255] ^ x >> np.uint32(8)
    tables = [np.array([step(np.arange(256, dtype=np.uint32) << np.uint32(8 * j)) for j in range(4)])]
    for _ in range(39):
        tables.append(_through(tables[-1], tables[-1]))
    return np.array(tables)


def _through(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][x >> np.uint32(8) & 255] ^ table[2][x >> np.uint32(16) & 255] ^ table[3][x >> np.uint32(24)]


def advance(crc: np.ndarray, zeros: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """CRCs carried over so many bytes: crc(a + b) == advance(crc(a), len(b)) ^ crc(b)."""
    out = crc.astype(np.uint32)
    for k in range(int(zeros.max(initial=0)).bit_length()):
        out = np.where(zeros >> k & 1, _through(tables[k], out), out)
    return out


def verify(spark: SparkSession, at: str, width: int = 2) -> DataFrame:
    """What the files hold for each document: doc_id, row, start, n_tokens, ids_crc32, verified.

    Each stored chunk is read once where it lies: its ids give its digest and CRC. Documents are
    put together from these by recipe, so no ids move. ``verified`` says that all chunks exist,
    are what they are called, and give the recipe's Merkle root.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, data = b.column("digest").to_pylist(), b.column("data").to_pylist()
            crc = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()) for x in data]
            good = [sha256(x).digest() == d for x, d in zip(data, digests, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(crc, pa.int64()), pa.array([len(x) // width for x in data], pa.int32()), pa.array(good)], names=["digest", "crc", "n", "good"])

    have = _stored(spark, at).mapInArrow(measure, "digest binary, crc long, n int, good boolean")
    listed = recipes(spark, at).select("doc_id", "row", F.inline(F.arrays_zip("digests", "lengths", "after")))
    listed = listed.withColumnsRenamed({"digests": "digest", "lengths": "length"})
    found = listed.join(have, "digest", "left")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _crc_tables()
        for b in batches:
            crc = b.column("crc").fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint32)
            after = b.column("after").to_numpy(zero_copy_only=False).astype(np.int64) * 4
            good = [bool(g) and n == m for g, n, m in zip(b.column("good").to_pylist(), b.column("n").to_pylist(), b.column("length").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(advance(crc, after, tables).astype(np.int64)), pa.array(good)], names=["doc_id", "row", "part", "good"])

    sums = found.mapInArrow(carry, "doc_id long, row long, part long, good boolean").groupBy("row").agg(F.bit_xor("part").alias("ids_crc32"), F.min("good").alias("chunks_good"))

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [merkle(d) == r for d, r in zip(b.column("digests").to_pylist(), b.column("root").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "row", "start", "n_tokens")), pa.array(good)], names=["doc_id", "row", "start", "n_tokens", "root_good"])

    heads = recipes(spark, at).select("doc_id", "row", "start", "n_tokens", "digests", "root").mapInArrow(rooted, "doc_id long, row long, start long, n_tokens long, root_good boolean")
    return heads.join(sums, "row").select("doc_id", "row", "start", "n_tokens", "ids_crc32", (F.col("root_good") & F.col("chunks_good")).alias("verified"))
