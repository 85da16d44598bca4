"""Exact nearest vectors by inner product, with whole cells left out.

Vectors lie in cells around centers that were fitted on a bounded sample; every vector is in a cell. A cell is a ball, and
no vector in it scores above query * center + |query| * radius. The cells with the best bounds are read first; the k-th score found
there tells which of the others can still matter, and only those are read. So the result is that of comparing all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pagewright.functions import patterns as P
from pagewright.operators import retrieval as R
from pagewright.sources.tables import added, kept, small_batches

#: Cells, vectors of the sample that their centers are fitted on, and rounds of the fit.
CELLS, SAMPLE, ROUNDS = 64, 20_000, 8
#: What rounding scores to six places and summing in doubles can move a score by.
SLACK = 2e-6


def centers(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> np.ndarray:
    """Centers of at most ``cells`` cells, from the ``sample`` vectors (chunk, vector) with the smallest hashes of their names."""
    rows = vectors.where("vector IS NOT NULL").select("chunk", "vector", F.xxhash64("chunk").alias("h")).orderBy("h", "chunk").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    width = len(rows[0]["vector"])
    x = np.nan_to_num(np.array([r["vector"] for r in rows if len(r["vector"]) == width], dtype=float).reshape(-1, width))
    c = np.unique(x[:: max(1, len(x) // cells)][:cells], axis=0)
    for _ in range(ROUNDS):
        near = (-2 * x @ c.T + (c * c).sum(axis=1)).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, weights=x[:, j], minlength=len(c)) for j in range(width)], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


@dataclass
class Report:
    """How many pairs of a query and a cell there were, and how many were read."""

    pairs: int = 0
    read: int = 0


class Cells:
    """Vectors in cells, written at ``at``."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")

    def write(self, vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> Cells:
        """All ``vectors`` (chunk, vector) by cell; those of another width than the sample's first have no score and are left out. Null components are 0."""
        fitted = centers(vectors, cells, sample)
        kind = vectors.schema["chunk"].dataType.simpleString()
        held = self.spark.sparkContext.broadcast(fitted)  # cells times components

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = held.value
            for b in batches:
                x = np.nan_to_num(np.asarray(b.column("vector").flatten(), dtype=float)).reshape(-1, c.shape[1])
                cell = (-2 * x @ c.T + (c * c).sum(axis=1)).argmin(axis=1).astype(np.int32)
                far = np.sqrt(((x - c[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("vector"), pa.array(far), pa.array(cell)], names=["chunk", "vector", "far", "cell"])

        width = fitted.shape[1] if len(fitted) else -1
        fits = small_batches(vectors).select("chunk", F.col("vector").cast("array<double>").alias("vector")).where(F.size("vector") == width)
        placed = fits.mapInArrow(place, f"chunk {kind}, vector array<double>, far double, cell int")
        # ranges that end inside a cell too, so no task writes all of a large one
        placed.repartitionByRange("cell", "chunk").write.partitionBy("cell").parquet(f"{self.at}/vectors")
        if not len(fitted):
            self.spark.createDataFrame([], f"cell int, n long, radius double, center array<double>, chunk {kind}").write.parquet(f"{self.at}/balls")
            return self
        balls = self.vectors().groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
        rows = [(i, [float(v) for v in c]) for i, c in enumerate(fitted)]
        balls.join(self.spark.createDataFrame(rows, "cell int, center array<double>"), "cell").withColumn("chunk", F.lit(None).cast(kind)).write.parquet(f"{self.at}/balls")
        return self

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/vectors")

    def topk(self, queries: DataFrame, k: int = P.CANDIDATE_K) -> tuple[DataFrame, Report]:
        """The same rows as ``retrieval.dense_topk`` of ``queries`` (query_id, vector) without a scope, and what was read for them.

        Queries are a stated set that is taken in blocks, as there; a block's bounds and k-th scores are at the driver.
        """
        table = self.spark.read.parquet(f"{self.at}/balls")
        balls = table.orderBy("cell").collect()  # a row a cell
        queries = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
        if not balls:
            return table.select("chunk").join(queries.select("query_id"), F.lit(False)).withColumns({"score": F.lit(0.0), "rank": F.lit(0)}), Report()
        report, done = Report(), None
        first = queries.limit(R.QUERY_BLOCK + 1).collect()
        if len(first) <= R.QUERY_BLOCK:
            return self._block(first, queries.schema, balls, k, report), report
        asked = kept(queries)
        n = -(-asked.count() // (R.QUERY_BLOCK // 2))
        for i in range(n):
            block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).collect()
            if block:
                found = self._block(block, asked.schema, balls, k, report)
                done = kept(found) if done is None else added(found, done)
        return done, report

    def _block(self, block: list, schema: StructType, balls: list, k: int, report: Report) -> DataFrame:
        names = self.spark.createDataFrame([(i, q["query_id"]) for i, q in enumerate(block)], StructType([StructField("_q", IntegerType()), schema["query_id"]]))
        width = len(balls[0]["center"])
        fits = np.array([i for i, q in enumerate(block) if len(q["vector"]) == width], dtype=int)
        asked = np.zeros((len(block), width))
        for i in fits:
            asked[i] = np.nan_to_num(np.array(block[i]["vector"], dtype=float))
        center, radius, size = np.array([b["center"] for b in balls]).reshape(len(balls), -1), np.array([b["radius"] for b in balls]), np.array([b["n"] for b in balls])
        bound = np.full((len(block), len(balls)), -np.inf)
        if len(fits):
            bound[fits] = asked[fits] @ center.T + np.linalg.norm(asked[fits], axis=1)[:, None] * radius + SLACK
        order = np.argsort(-bound, axis=1, kind="stable")
        # first the best bounds that together hold k vectors
        ahead = np.cumsum(size[order], axis=1) - size[order] < k
        near = np.zeros_like(bound, dtype=bool)
        np.put_along_axis(near, order, ahead, axis=1)
        near &= np.isfinite(bound)
        rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), "chunk"))
        found = kept(self._scored(asked, near, balls, k).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
        least = np.full(len(block), -np.inf)
        for r in found.groupBy("_q").agg(F.count("*").alias("n"), F.min("score").alias("s")).collect():  # a row a query of the block
            least[r["_q"]] = r["s"] if r["n"] >= k else -np.inf
        more = np.isfinite(bound) & ~near & (bound >= least[:, None])
        report.pairs += len(fits) * len(balls)
        report.read += int(near.sum() + more.sum())
        both = found.unionByName(self._scored(asked, more, balls, k)) if more.any() else found
        return both.withColumn("rank", rank).where(F.col("rank") <= k).join(names, "_q").select("chunk", "query_id", "score", "rank")

    def _scored(self, asked: np.ndarray, pairs: np.ndarray, balls: list, k: int) -> DataFrame:
        """(chunk, _q, score) of the vectors of each cell for the queries that ``pairs`` it with, the best k of some rows at a time. Only those cells' folders are read."""
        groups = {(b["cell"],): np.flatnonzero(pairs[:, j]) for j, b in enumerate(balls) if pairs[:, j].any()}
        return R.scored(self.vectors().where(F.col("cell").isin([c for c, in groups])), asked, groups, k, ("cell",))
