"""Centroid clustering by ball k-means, exact in integers.

A cluster is a ball: its centroid and a radius that holds its members. A centroid whose distance
from the ball's is more than twice the radius can't win a member, so it is no neighbour. The
distances to the neighbours cut the ball into a stable core, whose members stay without another
comparison, and annuli: a member of the k-th annulus is compared with the k nearest neighbours.
After a round a centroid has moved, so its ball is the old radius and the way it went.

Members with their clusters are a written table a round; the driver holds centroids and radii only.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import Tables, written

#: Components are held to this size, so that squared distances of up to 256 of them are longs.
MOST = 1 << 26
SEED = "1"


class Balls:
    """Centroids, and for each its neighbours by distance; without radii all are compared with all."""

    def __init__(self, centers: np.ndarray, radii: list[int] | None = None):
        self.centers = centers
        self.near: list[tuple[np.ndarray, np.ndarray]] | None = None
        if radii is not None:
            apart = ((centers[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
            self.near = []
            for i, r in enumerate(radii):
                order = np.argsort(apart[i], kind="stable")
                order = order[(order != i) & np.array([int(x) <= 4 * r * r for x in apart[i][order]], dtype=bool)]
                self.near.append((order, apart[i][order]))

    def distances(self, x: np.ndarray, j: int) -> np.ndarray:
        return ((x - self.centers[j]) ** 2).sum(axis=1)

    def assign(self, x: np.ndarray, old: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid (ties: smaller number), squared distance, and how many centroids each vector was compared with."""
        if self.near is None or old is None:
            best, cluster = self.distances(x, 0), np.zeros(len(x), dtype=np.int32)
            for j in range(1, len(self.centers)):
                d = self.distances(x, j)
                won = d < best
                best[won], cluster[won] = d[won], j
            return cluster, best, np.full(len(x), len(self.centers), dtype=np.int32)
        cluster, best, compared = old.astype(np.int32), np.zeros(len(x), dtype=np.int64), np.ones(len(x), dtype=np.int32)
        for i in np.unique(old):
            rows = np.flatnonzero(old == i)
            own = self.distances(x[rows], i)
            best[rows] = own
            neighbours, apart = self.near[i]
            # 0: the stable core, nearer to its centroid than half the way to any other; k: the k-th annulus
            ring = np.searchsorted(apart, 4 * own, side="right")
            compared[rows] += ring.astype(np.int32)
            for k in range(int(ring.max(initial=0))):
                j = neighbours[k]
                some = rows[ring > k]
                d = self.distances(x[some], j)
                won = (d < best[some]) | ((d == best[some]) & (j < cluster[some]))
                best[some[won]], cluster[some[won]] = d[won], j
        return cluster, best, compared


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, width)


def whole_numbers(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component x of the vectors with ``width`` components, none of them null or not finite."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column("embedding")), width), False))
            x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            fine = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):  # beyond doubles is beyond MOST
                q = np.clip(np.floor(scale * x[fine]), -MOST, MOST).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * width, pa.int32()), pa.array(q.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(fine)), lists], names=["vec_id", "q"])

    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(each, f"vec_id {id_type}, q array<int>")


def _assigned(state: DataFrame, balls: Balls, narrow: bool) -> DataFrame:
    """``state`` (vec_id, q, and cluster but in the first round) with cluster, distance and compared; ``narrow`` leaves out q."""
    width = balls.centers.shape[1]
    again = "cluster" in state.columns
    id_type = state.schema["vec_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = np.asarray(b.column("cluster")) if again else None
            found = [pa.array(c) for c in balls.assign(_matrix(b.column("q"), width), old)]
            kept = ["vec_id"] if narrow else ["vec_id", "q"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *found], names=[*kept, "cluster", "distance", "compared"])

    schema = f"vec_id {id_type}, {'' if narrow else 'q array<int>, '}cluster int, distance long, compared int"
    return state.select("vec_id", "q", *["cluster"] * again).mapInArrow(each, schema)


def _members(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Of each cluster the count, the greatest squared distance, and the sums of components; a task sends one row a cluster."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches:
            x, c = _matrix(b.column("q"), width), np.asarray(b.column("cluster"))
            n += np.bincount(c, minlength=k)
            np.maximum.at(far, c, np.asarray(b.column("distance")))
            for i in np.unique(c):
                sums[i] += x[c == i].sum(axis=0)
        some = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * width, pa.int32()), pa.array(sums[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(far[some]), lists], names=["cluster", "n", "far", "sums"])

    parts = state.select("q", "cluster", "distance").mapInArrow(each, "cluster int, n long, far long, sums array<long>")
    # clusters times components rows reach the driver, whatever the number of vectors and tasks
    rows = parts.select("cluster", "n", "far", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("far").alias("far")).collect()
    n, far, sums = np.zeros(k, np.int64), [0] * k, np.zeros((k, width), np.int64)
    for r in rows:
        n[r["cluster"]], far[r["cluster"]], sums[r["cluster"], r["i"]] = r["n"], r["far"], r["s"]
    return n, far, sums


def _up(square: int) -> int:
    """The root of ``square``, rounded up."""
    root = isqrt(square)
    return root + (root * root < square)


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and compared of the vectors that are kept.

    Kept are rows of ``vectors`` (vec_id, embedding, ...) with ``width`` components, none null or not finite; a component
    x becomes floor(scale * x), held to 2^26 either way. The first centroids are the ``k`` kept vectors with the smallest
    SHA-256 of "seed:vec_id" (a null id has no digits; ties by id, then components), or all where there are fewer.
    ``rounds`` times each vector goes to its nearest centroid (equal distances: the smaller number) and each centroid to
    the floor of its vectors' mean; empty ones stay. Then vectors are assigned once more. Repeated rows are vectors of
    their own, extra columns are ignored, whatever their names, and an empty table gives no rows. ``compared`` is the
    number of centroids the last assignment compared a vector with.
    """
    spark = vectors.sparkSession
    tables = Tables(spark)
    state = tables.written(whole_numbers(vectors, width, scale))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = state.select(order.alias("h"), "vec_id", "q").orderBy("h", "vec_id", "q").limit(k).collect()
    if not first:
        none = state.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"), F.lit(0).alias("compared"))
        return none
    balls = Balls(np.array([r["q"] for r in first], dtype=np.int64))
    for _ in range(rounds):
        now = Tables(spark)
        state = now.written(_assigned(state, balls, narrow=False))
        tables.drop()
        tables = now
        n, far, sums = _members(state, len(first), width)
        moved = balls.centers.copy()
        some = n > 0
        moved[some] = np.floor_divide(sums[some], n[some, None])
        shift = ((moved - balls.centers) ** 2).sum(axis=1)
        balls = Balls(moved, [_up(f) + _up(int(s)) for f, s in zip(far, shift, strict=True)])
    last = written(_assigned(state, balls, narrow=True))
    tables.drop()
    sums = {r["cluster"]: r["s"] for r in last.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [(i, sums.get(i, 0), sum(sums.values()), sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(balls.centers)]
    of = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")  # one row a cluster
