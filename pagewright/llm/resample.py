"""Importance resampling to a target distribution over a written sparse count matrix.

Documents by hashed features are a matrix of counts, written as blocks in compressed sparse
rows: the documents of a block, where each one's entries begin, and the entries' buckets and
counts. Sums of columns give the distribution of the corpus, and likewise that of the target;
their log ratios are gains, and the product of the matrix with them weighs each document.
Texts are read once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import running, written
from pagewright.llm.tokens import rounds

BUCKETS, LONGEST_RUN = 10_000, 1
SEED, LEAST_WORDS, PERCENT = "2024", 20, 10
#: Rows that one task ranks at most, about.
RANKED = 1 << 15

#: What makes words out of bytes: A-Z become a-z, all of ASCII but letters and digits a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """The words of a text in UTF-8: runs of ASCII letters and digits, lower-cased, and all characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def buckets_of(found: list[bytes], longest: int, buckets: int) -> np.ndarray:
    """The bucket of each run of 1 to ``longest`` words, joined by blanks."""
    parts = [np.fromiter(map(crc32, found), np.uint32, len(found))]
    for n in range(2, longest + 1):
        runs = [b" ".join(found[i : i + n]) for i in range(len(found) - n + 1)]
        parts.append(np.fromiter(map(crc32, runs), np.uint32, len(runs)))
    return np.concatenate(parts) % buckets


#: Text of a block, about, and its most documents. A Parquet reader decodes 4,096 rows at once, so blocks are no larger than a few documents.
BLOCK_BYTES, BLOCK_DOCS = 1 << 14, 32


def _lists(x: np.ndarray | pa.Array, ends: list[int]) -> pa.ListArray:
    """``x`` as lists that end at ``ends``."""
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), x)


def _bytes(x: np.ndarray, ends: list[int]) -> pa.BinaryArray:
    """``x``, of 4 bytes each, as binaries that end at ``ends``."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(4 * np.array([0, *ends], np.int32)), pa.py_buffer(x)])


def _ints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the binaries that ``_bytes`` made, and how many each has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.int32) if data else np.zeros(0, np.int32), np.diff(ends) // 4


def matrix(docs: DataFrame, key: str = "doc_id", longest: int = LONGEST_RUN, buckets: int = BUCKETS, packed: bool = False) -> DataFrame:
    """Blocks of the count matrix of ``docs`` (``key``, text): keys, n_words, begin (of each row, and the end), bucket and n of each entry.

    ``packed`` bucket and n are binaries of 4 bytes an entry: a reader holds levels and nulls beside each element of a list, and so several times as much.
    """
    entry = _bytes if packed else _lists

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rounds(batches):
            if not b.num_rows:
                continue
            n_words, begin, at, counts = [], [0], [], []
            docs_to, begins_to, entries_to, held, entries = [], [], [], 0, 0
            texts = b.column("text").to_pylist()
            for i, text in enumerate(texts, 1):
                found = words(text or "")
                bucket, n = np.unique(buckets_of(found, longest, buckets), return_counts=True)
                n_words.append(len(found))
                begin.append(begin[-1] + len(bucket))
                at.append(bucket.astype(np.int32))
                counts.append(n.astype(np.int32))
                held, entries = held + len(text or ""), entries + len(bucket)
                if held >= BLOCK_BYTES or i - (docs_to[-1] if docs_to else 0) >= BLOCK_DOCS or i == len(texts):
                    docs_to.append(i)
                    begins_to.append(len(begin))
                    entries_to.append(entries)
                    if i < len(texts):
                        begin.append(0)
                    held = 0
            yield pa.RecordBatch.from_arrays(
                [
                    _lists(b.column("key"), docs_to), _lists(pa.array(n_words, pa.int64()), docs_to), _lists(pa.array(begin, pa.int64()), begins_to),
                    entry(np.concatenate(at), entries_to), entry(np.concatenate(counts), entries_to),
                ],
                names=["keys", "n_words", "begin", "bucket", "n"],
            )

    return docs.select(F.col(key).cast("long").alias("key"), "text").mapInArrow(each, "keys array<long>, n_words array<long>, begin array<long>, " + ("bucket binary, n binary" if packed else "bucket array<int>, n array<int>"))


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The features of each bucket of packed ``blocks``; a task sends a row a bucket, and no more than ``buckets`` of them reach the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            np.add.at(sums, _ints(b.column("bucket"))[0], _ints(b.column("n"))[0])
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["bucket", "n"])

    rows = blocks.select("bucket", "n").mapInArrow(each, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to source share of each bucket, one feature added to each; rounded down."""
    k, (big_s, big_t) = len(source), (float(source.sum()), float(target.sum()))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (big_s + k) / ((s + 1.0) * (big_t + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the matrix, in packed ``blocks``, times ``gain``, an array of one long a bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            (bucket, sizes), (n, _) = _ints(b.column("bucket")), _ints(b.column("n"))
            begin, rows = np.asarray(b.column("begin").flatten()), np.asarray(pc.list_value_length(b.column("keys")), dtype=np.int64)
            # where each document's entries begin in the whole batch, and where they end
            begin = begin + np.repeat(np.cumsum(sizes, dtype=np.int64) - sizes, rows + 1)
            last = np.cumsum(rows + 1) - 1
            starts, ends = np.delete(begin, last), np.delete(begin, last - rows)
            sums = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[np.stack([starts, ends])], axis=0)[0])
            yield pa.RecordBatch.from_arrays([b.column("keys").flatten(), b.column("n_words").flatten(), sums(n.astype(np.int64)), sums(n * gain[bucket])], names=["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(each, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of ``docs`` (doc_id, text, ...), drawn towards the texts of ``target`` (text, ...).

    The score is the weight and Gumbel noise from the seed and the id, so the highest scores are a draw without
    replacement by weight. Of the documents with ``least_words`` words, ``percent`` in a hundred are drawn and ranked from 1, equal
    scores by smaller id (null first), then by fewer features; all others have no rank. Null and empty texts have no
    feature and weight 0. Repeated rows are documents of their own; extra columns are ignored, whatever their
    names; an empty table gives none, and an empty target makes all features of the corpus alike rare.
    """
    blocks = written(matrix(docs, "doc_id", longest, buckets, True))
    aim = written(matrix(target.select("text", F.lit(0).alias("doc_id")), "doc_id", longest, buckets, True))
    gain = gains(column_sums(blocks, buckets), column_sums(aim, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = written(weights(blocks, gain).withColumn("score", F.col("weight") + noise).withColumn("low", -F.col("score")))
    fits = scored.where(F.col("n_words") >= least_words)
    n = fits.count()
    ranked = running(fits, ["low", "doc_id", "n_features"], [], n, RANKED)
    drawn = F.when(F.col("rank") <= percent * n // 100, F.col("rank"))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", drawn).unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
