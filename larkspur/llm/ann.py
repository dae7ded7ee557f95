"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Every vector is projected on PROJECTIONS random directions; each direction has the projections of a block of vectors in sorted order. For a query a
window centred on its own projection is widened step by step in all directions (virtual rehashing: no buckets are built anew), and the collisions of each
vector, that is the windows it lies in, are counted. A vector at distance r lies in a window of half-width h with the probability
p(h / r) that a normal deviate is within h / r. So where h is u times the k-th best distance found, a vector nearer than that has
PROJECTIONS * p(u) collisions or more in the mean; vectors that have at most MISSES standard deviations fewer are verified, that is their distance is computed
in double precision. The search of a block ends once u is REACH: vectors farther away are in fewer windows.

The first vectors to verify, of which the first k-th distance comes, are those with the most collisions in windows that hold a
small share of the block. Blocks get vectors by hash; each block's arrays are built once, and all queries pass them in batches, so that a vector is shuffled
once and a query once a block. The k best of all blocks are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 128
REACH = 1.0
MISSES = 1.4
#: The share of the block that the first windows hold, their growth, and how many vectors are verified first, as a multiple of k.
FIRST_SHARE = 0.4
GROWTH = 1.2
FIRST = 8
#: Vectors of a block: BLOCK_GROWTH times the root of all vectors, within these bounds; so blocks grow in number and in size.
BLOCK_GROWTH = 32
LEAST_BLOCK, MOST_BLOCK = 2_048, 65_536


def usable(vector: str) -> Column:
    """Not null, not empty, not zero, all components finite."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))


def threshold(reach: float) -> int:
    p = math.erf(min(reach, 9.0) / math.sqrt(2))
    return max(1, math.floor(PROJECTIONS * p - MISSES * math.sqrt(PROJECTIONS * p * (1 - p))))


class Block:
    """The sorted projections of vectors of one size."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.n, dim = x.shape
        self.directions = np.random.Generator(np.random.PCG64(dim)).normal(size=(dim, PROJECTIONS))
        projected = (x @ self.directions).T
        self.order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
        ordered = np.take_along_axis(projected, self.order, 1)
        # All directions in one ascending array, each moved beyond the one before it.
        self.reach = 2 * float(np.abs(ordered).max()) + 1
        self.moved = 2 * self.reach * np.arange(PROJECTIONS)
        self.ordered = (ordered + self.moved[:, None]).ravel()
        self.places = self.n * np.arange(PROJECTIONS)
        self.norms = (x * x).sum(1)
        self.repeated = len(np.unique(ids)) < self.n
        self.verified = 0

    def edges(self, centre: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of the window of each direction."""
        low, high = (np.searchsorted(self.ordered, np.clip(centre + side, -self.reach, self.reach) + self.moved) - self.places for side in (-half, half))
        return low, high

    def widen(self, counts: np.ndarray, low: np.ndarray, high: np.ndarray, old_low: np.ndarray, old_high: np.ndarray) -> None:
        """Adds the collisions of windows [low, high) that lie outside [old_low, old_high)."""
        parts = [self.order[d, a:b] for d, (a, b) in enumerate(zip(low.tolist(), old_low.tolist(), strict=True)) if a < b]
        parts += [self.order[d, a:b] for d, (a, b) in enumerate(zip(old_high.tolist(), high.tolist(), strict=True)) if a < b]
        if parts:
            counts += np.bincount(np.concatenate(parts), minlength=self.n)

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, distances) of the k nearest found; vectors of the query's own id don't count, and an id counts once, at the nearest of its vectors."""
        centre = q @ self.directions
        others = self.ids != own
        counts = np.zeros(self.n, np.int64)
        middle, _ = self.edges(centre, 0.0)
        side = max(1, int(FIRST_SHARE * self.n / 2))
        beside = [np.abs(self.ordered[self.places + np.clip(middle + way, 0, self.n - 1)] - self.moved - centre) for way in (-side, side)]
        half = max(float(np.median(np.maximum(*beside))), 1e-300)
        low = high = middle
        checked = ~others
        at, far = np.zeros(0, np.int64), np.zeros(0)
        most_wanted = max(FIRST * k, 16)
        while True:
            new_low, new_high = self.edges(centre, half)
            new_low, new_high = np.minimum(new_low, low), np.maximum(new_high, high)
            self.widen(counts, new_low, new_high, low, high)
            low, high = new_low, new_high
            if len(at) < k:  # no k-th distance yet: verify those with the most collisions
                open_ = np.flatnonzero(~checked)
                at, far = self.verify(q, k, at, far, open_ if len(open_) <= most_wanted else open_[np.argpartition(-counts[open_], most_wanted - 1)[:most_wanted]], checked)
                most_wanted *= 2
            if len(at) >= k:
                worst = float(far.max())
                at, far = self.verify(q, k, at, far, np.flatnonzero((counts >= threshold(max(REACH, half / worst) if worst else 9.0)) & ~checked), checked)
                if half >= REACH * float(far.max()):
                    break
            if checked.all():
                break
            half *= GROWTH
        return at, far

    def verify(self, q, k, at, far, fresh, checked) -> tuple[np.ndarray, np.ndarray]:
        checked[fresh] = True
        self.verified += len(fresh)
        return self.nearest(q, k, at, far, fresh) if len(fresh) else (at, far)

    def nearest(self, q, k, at, far, fresh) -> tuple[np.ndarray, np.ndarray]:
        # Dot products choose few; their distances are then computed as such.
        rough = self.norms[fresh] - 2 * (self.x[fresh] @ q)
        least = rough[nearest_of_each(self.ids[fresh], rough)] if self.repeated else rough
        if len(least) > k:
            slack = 1e-9 * (float(self.norms.max()) + float(q @ q))
            fresh = fresh[rough <= np.partition(least, k - 1)[k - 1] + slack]
        at = np.concatenate([at, fresh])
        far = np.concatenate([far, np.sqrt(((self.x[fresh] - q) ** 2).sum(1))])
        if self.repeated:
            once = nearest_of_each(self.ids[at], far)
            at, far = at[once], far[once]
        if len(at) > k:
            best = np.lexsort((self.ids[at], far))[:k]
            at, far = at[best], far[best]
        return at, far


def nearest_of_each(ids: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The place of the smallest distance of each id."""
    order = np.lexsort((far, ids))
    new = np.ones(len(order), bool)
    new[1:] = ids[order][1:] != ids[order][:-1]
    return order[new]


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


def searcher(k: int):
    """From rows in the order (block, size, is_query): a block's vectors, of which its arrays are built, then all queries, batch by batch."""

    def run(batches):
        key, block, x, ids = None, None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "size", "is_query")], 1)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1, [len(keys)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = (int(keys[a, 0]), int(keys[a, 1]))
                if own != key:
                    key, block, x, ids = own, None, [], []
                vectors, names = matrix(batch.column("vector").slice(a, b - a), own[1]), batch.column("id").slice(a, b - a).to_numpy()
                if not keys[a, 2]:
                    x.append(vectors)
                    ids.append(names)
                    continue
                if block is None:
                    if not x:
                        continue
                    block, x, ids = Block(np.concatenate(x), np.concatenate(ids)), [], []
                found = [block.search(v, i, k) for v, i in zip(vectors, names.tolist(), strict=True)]
                asked = np.repeat(names, [len(at) for at, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(block.ids[np.concatenate([at for at, _ in found])]), pa.array(np.concatenate([far for _, far in found]))], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query by Euclidean distance, ties to the smaller id.

    Rows with a null id, and vectors that are null, empty, zero or not finite, take no part. Vectors are compared with queries of their own number
    of components only. Rows that repeat an id count once, at their smallest distance; a query's own id never counts. With no
    queries or candidates there are no rows. Other columns are not read.
    """
    given = vectors.where(F.col(id_).isNotNull() & usable(vector)).select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # Repeated rows go before they are dealt: they would meet in one block.
    n = given.groupBy("id", F.xxhash64("vector")).agg(F.lit(1)).count()
    blocks = max(1, math.ceil(n / min(MOST_BLOCK, max(LEAST_BLOCK, BLOCK_GROWTH * math.sqrt(n)))))
    given = given.groupBy("id", "vector").agg(F.max("asks").alias("asks")).withColumn("size", F.size("vector"))
    stored = given.select("id", "vector", "size", F.lit(False).alias("is_query"), F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int").alias("block"))
    asked = given.where("asks").select("id", "vector", "size", F.lit(True).alias("is_query"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    met = stored.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "size", "is_query")
    found = met.mapInArrow(searcher(k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % 100 == 0)
