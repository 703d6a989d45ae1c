"""Operator 6: approximate nearest neighbours by collision counting.

Rows are indexed in blocks. A block keeps, for each random projection, its rows in
sorted order. A query opens a window around its own projection in every sorted
array; rounds of virtual rehashing widen all windows with the radius. A row seen in
at least LEAST windows is verified by its true distance. The search of a block ends
when the radius covers the k-th best distance found, or all rows are verified.

At distance r a projection differs by r times a normal number, so that a row at the
radius falls into a window with probability 2 Phi(HALF_WINDOW) - 1: LEAST follows from
that and from MISS, the share of rows at the very radius that may be missed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import scatter, tidy
from .embedding_dedup import matrix, usable

#: Projections; half window for radius 1; rows at the radius that may be missed;
#: least growth of the radius.
PROJECTIONS, HALF_WINDOW, MISS, GROWTH = 128, 1.36, 0.22, 1.05
#: Projections whose closest rows tell where the radius starts (at half their k-th
#: distance); these rows are not verified for it.
PROBES = 6
#: Rows indexed together, and queries searched together.
BLOCK_ROWS, QUERIES_AT_ONCE = 8192, 64
SEED = 6


def least_collisions(projections: int = PROJECTIONS, half_window: float = HALF_WINDOW, miss: float = MISS) -> int:
    """The most windows that a row at the radius falls into but for `miss` of the time."""
    p = math.erf(half_window / math.sqrt(2))
    below, least = 0.0, 0
    while (below := below + math.comb(projections, least) * p**least * (1 - p) ** (projections - least)) <= miss:
        least += 1
    return least


class Block:
    """Sorted projections of one block of rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.directions = np.random.default_rng([SEED, rows.shape[1]]).standard_normal((rows.shape[1], PROJECTIONS))
        self.scale = np.abs(rows).max()
        projected = np.ascontiguousarray(((rows / self.scale) @ self.directions).T)
        self.order = projected.argsort(1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order, 1)
        self.verified = 0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
        """The nearest rows found for each query: (distance, id), k at most."""
        m, n, least = len(query_ids), len(self.ids), least_collisions()
        centre = ((queries / self.scale) @ self.directions).T
        left = np.array([np.searchsorted(s, c) for s, c in zip(self.sorted, centre, strict=True)])
        right = left.copy()
        seen, done = np.zeros((m, n), np.int32), np.zeros((m, n), bool)
        best: list[list[tuple[float, int]]] = [[] for _ in range(m)]
        radius = np.array([self._start(query_ids[q], queries[q], left[:, q], k) for q in range(m)])
        active = np.arange(m)
        while len(active):
            reach = HALF_WINDOW * radius[active]
            a, b = np.empty((2, PROJECTIONS, len(active)), np.int64)
            for j in range(PROJECTIONS):
                a[j] = np.searchsorted(self.sorted[j], centre[j, active] - reach, "left")
                b[j] = np.searchsorted(self.sorted[j], centre[j, active] + reach, "right")
            a, b = np.minimum(a, left[:, active]), np.maximum(b, right[:, active])
            for at, q in enumerate(active.tolist()):
                pieces = [o[x:y] for o, x, y in zip(self.order, a[:, at].tolist(), left[:, q].tolist(), strict=True) if x < y]
                pieces += [o[x:y] for o, x, y in zip(self.order, right[:, q].tolist(), b[:, at].tolist(), strict=True) if x < y]
                if pieces:
                    seen[q] += np.bincount(np.concatenate(pieces), minlength=n)
                fresh = np.flatnonzero((seen[q] >= least) & ~done[q])
                done[q, fresh] = True
                best[q] = self._verify(int(query_ids[q]), queries[q], fresh, best[q], k)
            left[:, active], right[:, active] = a, b
            covered = np.array([done[q].all() or (len(best[q]) == k and best[q][-1][0] <= radius[q] * self.scale) for q in active])
            active = active[~covered]
            # far from LEAST the radius grows faster
            short = 1 - seen[active].max(1, initial=0) / least
            radius[active] *= np.maximum(GROWTH, 1 + short / 2)
        return best

    def _start(self, query_id: int, query: np.ndarray, at: np.ndarray, k: int) -> float:
        near = np.unique(np.concatenate([o[max(0, x - k) : x + k] for o, x in zip(self.order[:PROBES], at[:PROBES].tolist(), strict=True)]))
        near = near[self.ids[near] != query_id]
        spread = float(np.median(self.sorted[:, -1] - self.sorted[:, 0])) or 1.0
        distance = np.sort(self._distances(query, near))[: k + 1] / self.scale
        return max(distance[min(k, len(distance)) - 1] / 2 if len(distance) else spread, spread * 1e-9)

    def _distances(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        difference = self.rows[rows] - query
        with np.errstate(over="ignore"):
            distance = np.sqrt(np.einsum("ij,ij->i", difference, difference))
        odd = ~np.isfinite(distance) | (distance == 0)
        if odd.any():  # squares beyond the range of doubles
            top = np.abs(difference[odd]).max(1)
            distance[odd] = top * np.sqrt(((difference[odd] / np.where(top > 0, top, 1)[:, None]) ** 2).sum(1))
        return distance

    def _verify(self, query_id: int, query: np.ndarray, fresh: np.ndarray, best: list[tuple[float, int]], k: int) -> list[tuple[float, int]]:
        """`best` with the true distances of fresh rows merged in."""
        self.verified += len(fresh)
        fresh = fresh[self.ids[fresh] != query_id]
        if not len(fresh):
            return best
        distance = self._distances(query, fresh)
        if len(best) == k:
            near = distance <= best[-1][0]
            fresh, distance = fresh[near], distance[near]
        first = np.lexsort((self.ids[fresh], distance))[:k]
        return sorted(best + list(zip(distance[first].tolist(), self.ids[fresh[first]].tolist(), strict=True)))[:k]


def _search(k: int):
    """Over batches sorted by (block, size, is_query): a block's rows of one size are
    indexed, then its queries pass by, however many they are."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        block, now = None, None

        def found(ids: np.ndarray, queries: np.ndarray):
            for at in range(0, len(ids), QUERIES_AT_ONCE):
                some = ids[at : at + QUERIES_AT_ONCE]
                hits = [(int(q), i, d) for q, best in zip(some, block.search(some, queries[at : at + QUERIES_AT_ONCE], k), strict=True) for d, i in best]
                if hits:
                    q, i, d = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "size", "is_query")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part, here = batch.slice(a, b - a), (key[a][0], key[a][1])
                if here != now:
                    held, block, now = [], None, here
                ids, rows = part.column("vec_id").to_numpy(), matrix(part.column("v"))
                if not key[a][2]:
                    held.append((ids, rows))
                    continue
                if block is None and held:
                    block = Block(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                if block is not None:
                    yield from found(ids, rows)

    return run


def nearest_neighbours(embeddings: DataFrame, is_query: F.Column, k: int = 10) -> DataFrame:
    """The k nearest other rows found for each row where is_query holds: query_id,
    rank (from 1), vec_id, score (Euclidean distance in double precision), nearest
    first, ties to the smaller vec_id; fewer where there are fewer.

    Approximate: a row within the final radius is missed if it falls outside too
    many windows (recall is tested against brute force). Every row is indexed, and
    no candidate is capped. Vectors that are null, zero or hold null or non-finite
    components take no part, nor do rows without vec_id; vectors of another length
    are no candidates. Of repeated query rows one searches (the smallest vector); a
    row is no candidate of a query with the same vec_id. An empty table gives an
    empty result; further columns are not read. Which rows share a block follows from
    their ids, but for ids that hold very many rows.

    A copy of every query goes to every block: work and shuffle grow with queries
    times blocks, while no task holds more than one block and a batch of queries."""
    shaped = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(usable("v") & F.col("vec_id").isNotNull())
    rows = shaped(embeddings)
    n = rows.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    dealt = scatter(rows, "vec_id", blocks, n, SEED, "block").withColumn("is_query", F.lit(0))
    asked = shaped(embeddings.where(is_query)).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("is_query", F.lit(1))
    both = dealt.unionByName(asked).withColumn("size", F.size("v"))
    found = both.repartition(blocks, "block").sortWithinPartitions("block", "size", "is_query", "vec_id").mapInArrow(tidy(_search(k)), "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
