"""Operator 1: exact top-k by inner product: a ball tree for each shard, searched by branch and bound."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.vectors import Best, search

LEAF = 128
"""Vectors in a leaf, at most."""


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond the range of a long, the nearest long."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if most < 2**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return np.clip(q.astype(object) @ x.astype(object).T, -(2**63 - 2), 2**63 - 1).astype(np.int64)


def build(ids: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """A ball tree: rows in leaf order; for each node its center, radius, rows [lo, hi), and children."""
    order, nodes, todo = np.arange(len(ids)), [], [(0, len(ids), -1)]
    y = x.astype(float)
    while todo:
        lo, hi, parent = todo.pop()
        part = y[order[lo:hi]]
        center = part.mean(0) if hi > lo else np.zeros(x.shape[1])
        radius = np.sqrt(((part - center) ** 2).sum(1).max(initial=0))
        leaf = hi - lo <= LEAF or not radius
        nodes.append((center, radius, lo, hi, parent, leaf))
        if not leaf:
            far = part[np.argmax(((part - center) ** 2).sum(1))]
            along = part @ (far - center)
            mid = (lo + hi) // 2
            order[lo:hi] = order[lo:hi][np.argsort(along, kind="stable")]
            todo += [(lo, mid, len(nodes) - 1), (mid, hi, len(nodes) - 1)]
    centers, radii, los, his, parents, leaves = (np.array(c) for c in zip(*nodes, strict=True))
    children = np.zeros((len(nodes), 2), np.int64)
    for node in range(len(nodes) - 1, 0, -1):  # a parent stands before its children
        children[parents[node]] = node, children[parents[node], 0]
    return {"ids": ids[order], "x": x[order], "centers": centers, "radii": radii, "lo": los, "hi": his, "children": children, "leaf": leaves}


def scan(tree: dict[str, np.ndarray], q: np.ndarray, best: Best) -> None:
    """Best first: each query takes, of the nodes it knows, the one with the greatest bound, until none reaches its k-th score.

    A node's bound is q . center + |q| radius, and no more than its parent's. Of an inner node its two children become
    known, with bounds that are only then computed; a leaf's vectors are scored, which raises the k-th score. Queries that
    take the same node in the same round are handled together.
    """
    q0 = q.astype(float)
    length = np.sqrt((q0**2).sum(1))

    def bound(rows: np.ndarray, node: int) -> np.ndarray:
        x = q0[rows] @ tree["centers"][node] + length[rows] * tree["radii"][node]
        return x + np.abs(x) * 1e-9 + 1e-6  # rounding never hides a node

    known = np.full((len(q), len(tree["leaf"])), -np.inf)
    active = np.arange(len(q))
    known[:, 0] = bound(active, 0)
    while len(active):
        node = known[active].argmax(1)
        top = known[active, node]
        reach = (top > -np.inf) & (np.maximum(top, best.low) >= best.floor[active])
        active, node, top = active[reach], node[reach], top[reach]
        known[active, node] = -np.inf
        by_node = np.argsort(node, kind="stable")
        for at in np.split(by_node, np.flatnonzero(np.diff(node[by_node])) + 1) if len(node) else ():
            rows, here = active[at], node[at[0]]
            if tree["leaf"][here]:
                lo, hi = tree["lo"][here], tree["hi"][here]
                best.offer(rows, exact(q[rows], tree["x"][lo:hi]), tree["ids"][lo:hi])
            else:
                for child in tree["children"][here]:
                    known[rows, child] = np.minimum(bound(rows, child), top[at])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, *, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k vectors with the largest inner product, exactly.

    vector: an array of long (sums beyond a long are the nearest long). Ties go to the smaller id; a vector with a query's own id is not its candidate; all
    candidates, if there are fewer than k. Null ids, null vectors and vectors with a null component take no part, nor do
    vectors of another length than the query's. Rows that are equal in id and vector count once; an id with several
    vectors has each of them as a candidate of other ids, and its queries' finds are ranked together. Vectors of any
    length are whole in one row. Empty table: no rows.
    """
    sides = (df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()) & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<bigint>").alias("vector")) for df in (vectors, queries))
    return search(*sides, k, build, scan, "long")
