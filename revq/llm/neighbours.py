"""Nearest neighbours by collision counting over single projections.

Vectors are dealt into shards by a hash. A shard projects its vectors onto `projections`
random directions and keeps, for each direction, the sorted array of projections. A
query opens a window around its own projection in every array; vectors inside a window
collide with it. Windows widen step by step (virtual rehashing: a wider window is a
coarser hash function over the same array), and a vector that has collided in
`threshold` arrays is verified by its exact distance. A query ends when its k nearest
verified vectors lie within the radius that the windows stand for: a vector at that
radius falls into a window with probability 2 Phi(w / 2) - 1 = 0.82 (w = 2.7), above
the threshold's share of 0.72, one much farther out does not. If that never happens the
windows end up holding the whole shard, so nothing is cut off.

Every vector is indexed. Queries are a stated set; they meet the shards in portions,
each shard and portion in one task, and only the k nearest of each are merged.

Vectors that are null, zero, of another dimension than most, or that hold null or
non-finite components take no part, as query or candidate. A query is not its own
neighbour: candidates with its vec_id are left out. Ties go to the smaller vec_id.
Repeated rows are one vector. With fewer than k candidates all are returned; an empty
table gives an empty result. Further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 48
WIDTH = 2.7
THRESHOLD = 0.72
GROWTH = 1.3
SHARD_ROWS = 4096
PORTION_ROWS = 4096
QUERY_ROWS = 256  # queries whose counters are in memory at once

FOUND = "query_id long, vec_id long, score double"


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and components as doubles of the vectors that take part."""
    wide = vectors.where("vec_id IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")
    )
    infinite = float("inf")
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < infinite)) & F.exists("x", lambda v: v != 0)
    wide = wide.where(F.col("x").isNotNull() & fine)
    # One row per dimension that occurs; the most frequent one is kept.
    usual = wide.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).first()
    return wide.where(F.size("x") == (usual["d"] if usual else 0)).dropDuplicates(["vec_id", "x"])


class Shard:
    """Sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, projections: int, seed: int = 7):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.lines = np.random.default_rng(seed).standard_normal((projections, x.shape[1]))
        along = self.x @ self.lines.T
        self.order = np.argsort(along, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(along, self.order.T, axis=0).T.copy()
        # The first windows hold a small part of the shard, whatever the scale of the data.
        spread = np.median(self.sorted[:, -1] - self.sorted[:, 0])
        self.first_half = max(float(spread) / 24, float(np.abs(along).max()) * 1e-9, 1e-300)

    def search(self, own: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and distances of the k nearest for each query, which has the id `own`."""
        n, m = len(self.ids), len(self.lines)
        at = q @ self.lines.T
        low = np.stack([np.searchsorted(self.sorted[i], at[:, i]) for i in range(m)], axis=1)
        high, half, least = low.copy(), self.first_half, int(np.ceil(THRESHOLD * m))
        hits = np.zeros((len(q), n), np.int16)
        distance = np.full((len(q), n), np.inf)
        unseen = self.ids[None, :] != own[:, None]
        wanted = np.minimum(k, unseen.sum(axis=1))
        active = np.flatnonzero(wanted)
        while len(active):
            a, b = np.empty((len(active), m), np.int64), np.empty((len(active), m), np.int64)
            for i in range(m):
                a[:, i] = np.searchsorted(self.sorted[i], at[active, i] - half)
                b[:, i] = np.searchsorted(self.sorted[i], at[active, i] + half, side="right")
            a, b = np.minimum(a, low[active]), np.maximum(b, high[active])
            radius, open_ = 2 * half / WIDTH, []
            for j, row in enumerate(active):
                parts = [self.order[i, a[j, i] : low[row, i]] for i in range(m)]
                parts += [self.order[i, high[row, i] : b[j, i]] for i in range(m)]
                hits[row] += np.bincount(np.concatenate(parts), minlength=n).astype(np.int16)
                fresh = np.flatnonzero((hits[row] >= least) & unseen[row])
                unseen[row, fresh] = False
                distance[row, fresh] = np.sqrt(((self.x[fresh] - q[row]) ** 2).sum(axis=1))
                kth = np.partition(distance[row], wanted[row] - 1)[wanted[row] - 1]
                if not kth <= radius and unseen[row].any():
                    open_.append(row)
            low[active], high[active] = a, b
            active = np.array(open_, np.int64)
            half *= GROWTH
        near = [np.lexsort((self.ids, d))[:w] for d, w in zip(distance, wanted)]
        return [(self.ids[i], d[i]) for i, d in zip(near, distance)]


def search(vectors: DataFrame, queries: Column, k: int = 10, projections: int = PROJECTIONS) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each row that `queries` marks."""
    valid = valid_vectors(vectors)
    asked = valid.where(queries)
    rows, questions = valid.count(), asked.count()
    shards, portions = rows // SHARD_ROWS + 1, questions // PORTION_ROWS + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = valid.select(
        "vec_id", "x", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), every(portions).alias("portion")
    )
    asked = asked.select(
        F.col("vec_id").alias("query_id"), F.col("x").alias("q"),
        every(shards).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(portions)).cast("int").alias("portion"),
    )

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        flat = flat.flatten() if isinstance(flat, pa.ListArray) else flat
        return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def find(asked: pa.Table, index: pa.Table) -> pa.Table:
        found = ([], [], [])
        if len(asked) and len(index):
            shard = Shard(index["vec_id"].to_numpy(), matrix(index["x"]), projections)
            own, q = asked["query_id"].to_numpy(), matrix(asked["q"])
            for i in range(0, len(own), QUERY_ROWS):
                some = slice(i, i + QUERY_ROWS)
                for query, (ids, scores) in zip(own[some], shard.search(own[some], q[some], k)):
                    for out, values in zip(found, (np.full(len(ids), query), ids, scores)):
                        out.append(values)
        joined = [np.concatenate(f) if f else [] for f in found]
        return pa.table(
            {
                "query_id": pa.array(joined[0], pa.int64()),
                "vec_id": pa.array(joined[1], pa.int64()),
                "score": pa.array(joined[2], pa.float64()),
            }
        )

    keys = ["shard", "portion"]
    found = asked.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(lambda a, b: find(a, b), FOUND)
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
