"""Exact top-k by integer inner product, with a KD-tree in each shard.

Components become floor(256 * x). Trees split at the median of the widest dimension down to leaves of
`LEAF` rows; every node has the tight bounding box of its rows. Traversal is best first: each query keeps a frontier of
nodes and their bounds, sum of max(q * low, q * high), takes the largest, opens it or scores its leaf, and stops when
the largest lies below its kth score. The queries of a round take their steps together, so a leaf is scored for
all that reach it at once. Bounds equal to the kth score are visited, as ties go to smaller ids. The kth scores start
from the other queries of the round (they are candidates too) and are carried from shard to shard within a task.

Sums stay exact: float64 below 2^53, Python integers beyond. See `vectors` for the defined cases;
a result score that doesn't fit in 64 bits raises.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from keytide.llm.vectors import Best, searched, sharded, taking_part

LEAF = 256


@dataclass
class Tree:
    """Nodes in preorder: bounding boxes, the first child and the second (-1 for leaves), and the rows' span."""

    ids: np.ndarray
    x: np.ndarray
    low: np.ndarray
    high: np.ndarray
    children: np.ndarray
    span: np.ndarray


def quantised(x: np.ndarray) -> np.ndarray:
    return np.floor(256 * x)


def build(ids: np.ndarray, x: np.ndarray) -> Tree:
    x = quantised(x)
    order = np.arange(len(x))
    low, high, children, span = [], [], [], []

    def node(a: int, b: int) -> int:
        own, me = x[order[a:b]], len(low)
        low.append(own.min(0))
        high.append(own.max(0))
        children.append([-1, -1])
        span.append([a, b])
        widest = int(np.argmax(high[me] - low[me]))
        if b - a > LEAF and high[me][widest] > low[me][widest]:
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, widest], mid)]
            children[me] = [node(a, a + mid), node(a + mid, b)]
        return me

    node(0, len(x))
    return Tree(ids[order], x[order], np.array(low), np.array(high), np.array(children), np.array(span))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(u, v)) for v in x] for u in q], object)
    return exact.astype(np.int64).reshape(len(q), len(x))  # raises beyond 64 bits


def _bounds(up: np.ndarray, down: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest score that each box allows each query; a little more where floats round."""
    b = up @ high.T + down @ low.T
    slack = up @ np.abs(high).T - down @ np.abs(low).T
    return b + slack * (up.shape[1] * 2.0**-51)


def _floor(q: np.ndarray, k: int) -> np.ndarray:
    """For each query the kth score among the round's other queries."""
    floor = np.full(len(q), np.iinfo(np.int64).min)
    if len(q) > k:
        for a in range(0, len(q), 256):
            s = _products(q[a : a + 256], q)
            s[np.arange(len(s)), np.arange(a, a + len(s))] = np.iinfo(np.int64).min
            floor[a : a + 256] = np.partition(s, len(q) - k, axis=1)[:, len(q) - k]
    return floor


def search(ids: np.ndarray, x: np.ndarray, tree: Tree, best: Best) -> None:
    q = quantised(x)
    if not hasattr(best, "floor"):
        best.floor = _floor(q, best.k)
    bounds = _bounds(np.maximum(q, 0), np.minimum(q, 0), tree.low, tree.high)
    frontier = np.full(bounds.shape, -np.inf)
    frontier[:, 0] = bounds[:, 0]
    active = np.arange(len(q))
    while len(active):
        node = frontier[active].argmax(axis=1)
        go = frontier[active, node] >= np.maximum(best.score[active, -1], best.floor[active])
        active, node = active[go], node[go]
        frontier[active, node] = -np.inf
        inner = tree.children[node, 0] >= 0
        for side in (0, 1):
            child = tree.children[node[inner], side]
            frontier[active[inner], child] = bounds[active[inner], child]
        for leaf in np.unique(node[~inner]).tolist():
            own = active[node == leaf]
            a, b = tree.span[leaf]
            s = _products(q[own], tree.x[a:b])
            s[ids[own][:, None] == tree.ids[a:b][None, :]] = np.iinfo(np.int64).min
            best.offer(own, s, tree.ids[a:b])


def exact_topk(df: DataFrame, id_col: str, vector: str, queries: Column, *, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` (a condition on `id`) holds for, the k other rows of largest score."""
    rows = taking_part(df, id_col, vector)
    shards = sharded(rows, build, "kd-trees")
    return searched(shards, rows.where(queries), search, k, "bigint")
