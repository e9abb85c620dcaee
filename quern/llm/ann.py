"""Operator 4: approximate nearest neighbours by collision counting over single projections, with virtual rehashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.vectors import Best, finite, scaled, search

PROJECTIONS = 48
MOST = 2.0
"""The distance of opposite vectors of length 1."""
WIDTH = 1.3
"""Half a window's width, for radius 1."""
GROWTH = 1.15
"""Each virtual rehashing widens the windows so many times."""
SLACK = 1.6
"""Standard deviations by which the collision threshold is below what a vector at the radius expects."""


def threshold(m: int, width: float, slack: float) -> int:
    """Collisions, of m, that make a vector a candidate: one at the radius has them with high probability.

    The projections of two vectors at distance d differ by d times a standard normal, so at d = radius one collides with
    p = P(|normal| <= width).
    """
    from math import erf, sqrt

    p = erf(width / sqrt(2))
    return max(1, int(m * p - slack * sqrt(m * p * (1 - p))))


def projections(dim: int, m: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(20120521).normal(size=(dim + 1, m))


def lifted(x: np.ndarray, top: float, longest: float) -> np.ndarray:
    """One more component makes all vectors equally long, so the largest inner product is the least distance.

    top: the largest absolute component of all vectors; longest: the largest length of vectors divided by it.
    """
    y = x / top / longest
    return np.column_stack([y, np.sqrt(np.maximum(0, 1 - (y**2).sum(1)))])


def make(top: float, longest: float):
    """build and scan for vectors with that largest component, of which the longest has that length times it."""

    def build(ids: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        """m arrays of the shard's vectors sorted by one projection each."""
        places = lifted(x, top, longest) @ projections(x.shape[1])
        order = np.argsort(places, axis=0, kind="stable").T
        return {"ids": ids, "x": x, "order": np.ascontiguousarray(order.astype(np.int32)), "places": np.ascontiguousarray(np.take_along_axis(places.T, order, 1))}

    def scan(shard: dict[str, np.ndarray], q: np.ndarray, best: Best) -> None:
        """Windows round each query grow until the radius reaches the distance of its k-th best, or hold everything.

        A vector is verified, by its inner product, once its collisions reach the threshold; no number of candidates
        ends the search early.
        """
        n, m = len(shard["ids"]), len(shard["order"])
        qs, size = scaled(q)
        norms = np.sqrt((qs**2).sum(1))  # 1 at least
        own = np.column_stack([qs / norms[:, None], np.zeros(len(q))]) @ projections(q.shape[1])
        least = threshold(m, WIDTH, SLACK)

        def distance(rows: np.ndarray) -> np.ndarray:
            """From a query to its k-th best, both as lifted vectors of length 1."""
            with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                cosine = best.floor[rows] / size[rows] / top / norms[rows] / longest
            return np.sqrt(np.maximum(0, 2 - 2 * np.clip(np.nan_to_num(cosine, nan=-1.0), -1, 1)))

        counts = np.zeros((len(q), n), np.uint8 if m < 256 else np.uint16)
        lo = np.stack([np.searchsorted(shard["places"][j], own[:, j]) for j in range(m)], 1)
        hi, active = lo.copy(), np.arange(len(q))
        radius = np.where(np.isfinite(best.floor), distance(active) / GROWTH, 0.5)
        while len(active):
            reach = np.where(radius[active] < MOST, WIDTH * radius[active], np.inf)  # nothing is further away than MOST
            left = np.stack([np.searchsorted(shard["places"][j], own[active, j] - reach) for j in range(m)], 1)
            right = np.stack([np.searchsorted(shard["places"][j], own[active, j] + reach, "right") for j in range(m)], 1)
            for i, a, b in zip(active.tolist(), left, right, strict=True):
                new = [shard["order"][j, s:e] for j in range(m) for s, e in ((a[j], lo[i, j]), (hi[i, j], b[j])) if e > s]
                if new:
                    more = np.bincount(np.concatenate(new), minlength=n)
                    before = counts[i] >= least
                    counts[i] += more.astype(counts.dtype)
                    found = np.flatnonzero((counts[i] >= least) & ~before)
                    if len(found):
                        best.offer(np.array([i]), (shard["x"][found] * q[i]).sum(1)[None, :], shard["ids"][found])
            lo[active], hi[active] = left, right
            whole = ((left == 0) & (right == n)).all(1)
            active = active[~whole & ~(np.isfinite(best.floor[active]) & (radius[active] >= distance(active)))]
            radius[active] *= GROWTH

    return build, scan


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query about the k vectors with the largest inner product.

    Scores are exact inner products in double precision. Every vector is in the index; a search ends by its radius, so a
    query whose vectors are all equally near verifies them all. On the vectors of the given tables the recall against
    brute force is in the README. How many balls and blocks there are goes by the number of queries, and what a search has
    verified when it ends by the floor it began with, so the few neighbours that are missed differ with the blocks; the
    scores of those found do not. Ties go to the smaller id; a query's own id is not its candidate; all candidates, if
    there are fewer than k. Null ids, null or zero vectors and vectors with a null or non-finite component take no part,
    nor do vectors of another length than the query's. Components of any finite size take part; a score that overflows
    is infinite, and one that is no number (infinities of both signs) is no find. Rows that are equal in id and vector
    count once; an id with several vectors has each of them as a candidate of other ids. Empty table: no rows.
    """
    usable = lambda df: df.where(F.col(key).isNotNull() & finite(F.col(vector)) & F.exists(vector, lambda x: x != 0)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    points = usable(vectors)
    top = float(points.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 1.0)
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / F.lit(top)) * (x / F.lit(top)))
    build, scan = make(top, float(np.sqrt(points.agg(F.max(squares)).first()[0] or 1.0)) * (1 + 1e-12))
    return search(points, usable(queries), k, build, scan, "double")
