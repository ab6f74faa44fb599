"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

All rows are indexed. `tables` hash tables, the same for all shards, map a unit vector to `width`-wide
slots of `hashes` Gaussian projections (2-stable, so projections keep Euclidean distance, which orders
unit vectors as the cosine does). A query looks up its own bucket in each table and perturbed ones: sets
of steps to neighbouring slots, in the order of the estimated success, a set's score being the sum of
the squared distances to the slots' edges that it crosses. A heap makes the sets once, by their expected scores;
each query then scores them by its own distances.

A row at distance d lies beyond edges of score s with a probability that falls as exp(-s / 2d^2). So
only sets (of at most `sets`) with s <= `reach` * d^2 are looked up, d being the distance of the kth row found so far;
it is measured by the exact cosine after the own bucket, again after a few sets, and at the end. A query amid
near neighbours stops early, one without any goes far. A query that has fewer than k rows after all this is compared with every row. Buckets have no cap.

Recall depends on `tables`, `hashes`, `width`, `sets` and `reach` and is measured against brute force in the
tests and the README. See `vectors` for the defined cases; zero vectors take no part either.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.llm.vectors import Best, searched, sharded, taking_part

SEED = 20
#: Sets that are looked up before the distance is measured again.
STAGES = (1, 9)
#: Queries that are looked up together.
TOGETHER = 64


@dataclass
class Index:
    ids: np.ndarray
    x: np.ndarray
    norm: np.ndarray
    #: of each table: the occupied buckets' keys in order, where their rows begin, and the rows by bucket
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


@cache
def projections(dim: int, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each table the directions, shifts, and the multipliers that make one key of the slots."""
    rng = np.random.default_rng([SEED, dim, tables, hashes])
    return rng.normal(size=(tables, dim, hashes)), rng.uniform(0, width, (tables, hashes)), rng.integers(1, 1 << 62, (tables, hashes))


@cache
def perturbations(hashes: int, number: int) -> np.ndarray:
    """(number, 2 * hashes) 0 or 1: the sets of steps, likeliest first. Column j is the step with the j-th smallest distance."""
    m = hashes
    j = np.arange(1, 2 * m + 1)
    # expected squared distances of the sorted steps, in slots, for uniform places
    expected = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)))
    out = [np.zeros(2 * m, np.int64)]
    heap = [(expected[0], (0,))]
    while heap and len(out) < number:
        score, steps = heapq.heappop(heap)
        # the j-th and the j-th last step are the two ways of one hash
        if len({min(s, 2 * m - 1 - s) for s in steps}) == len(steps):
            out.append(np.isin(np.arange(2 * m), steps).astype(np.int64))
        if (last := steps[-1]) + 1 < 2 * m:
            heapq.heappush(heap, (score - expected[last] + expected[last + 1], (*steps[:-1], last + 1)))
            heapq.heappush(heap, (score + expected[last + 1], (*steps, last + 1)))
    return np.array(out)


def build(ids: np.ndarray, x: np.ndarray, tables: int, hashes: int, width: float) -> Index:
    norm = np.linalg.norm(x, axis=1)
    a, shift, by = projections(x.shape[1], tables, hashes, width)
    out = []
    for t in range(tables):
        key = np.floor((x / norm[:, None] @ a[t] + shift[t]) / width).astype(np.int64) @ by[t]
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        out.append((keys, np.append(first, len(order)), order.astype(np.int32)))
    return Index(ids, x, norm, out)


def _probes(q: np.ndarray, tables: int, hashes: int, width: float, sets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each table, for unit queries: the keys of the buckets to visit, and their scores."""
    a, shift, by = projections(q.shape[1], tables, hashes, width)
    steps = perturbations(hashes, sets)
    out = []
    for t in range(tables):
        f = (q @ a[t] + shift[t]) / width
        slot = np.floor(f)
        away = np.concatenate([f - slot, slot + 1 - f], axis=1) ** 2 * width**2
        order = np.argsort(away, axis=1)
        step = np.take_along_axis(np.broadcast_to(np.concatenate([-by[t], by[t]]), away.shape), order, 1)
        out.append(((slot.astype(np.int64) @ by[t])[:, None] + step @ steps.T, np.take_along_axis(away, order, 1) @ steps.T))
    return out


def _visited(index: Index, probes: list[tuple[np.ndarray, np.ndarray]], wanted: list[np.ndarray]) -> np.ndarray:
    """(queries, rows): the rows of the wanted buckets."""
    seen = np.zeros((len(wanted[0]), len(index.ids)), bool)
    for (keys, first, order), (key, _), want in zip(index.tables, probes, wanted):
        q, s = np.nonzero(want)
        at = np.searchsorted(keys, key[q, s])
        at[at == len(keys)] = 0
        hit = keys[at] == key[q, s]
        q, at = q[hit], at[hit]
        size = first[at + 1] - first[at]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        seen[np.repeat(q, size), order[np.repeat(first[at], size) + inside]] = True
    return seen


def _ranked(index: Index, ids: np.ndarray, q: np.ndarray, rows: np.ndarray, seen: np.ndarray, best: Best) -> None:
    """Offers the seen rows by their cosine."""
    seen = seen & (index.ids[None, :] != ids[:, None])
    norm = np.linalg.norm(q, axis=1)
    if seen.mean() > 0.05:  # products of all are cheaper than gathering so many
        with np.errstate(invalid="ignore"):
            score = np.where(seen, (q @ index.x.T) / (index.norm[None, :] * norm[:, None]), -np.inf)
        # a few more than k, so that rounding can't change who is ranked by the exact measure
        m = min(best.k + 8, score.shape[1])
        top = np.argpartition(-score, m - 1, axis=1)[:, :m]
        seen = np.zeros_like(seen)
        np.put_along_axis(seen, top, np.take_along_axis(score, top, 1) > -np.inf, 1)
    for i in range(len(q)):
        at = np.flatnonzero(seen[i])
        if len(at):
            best.offer(rows[i : i + 1], (np.einsum("ij,j->i", index.x[at], q[i]) / (index.norm[at] * norm[i]))[None, :], index.ids[at])


def search(ids: np.ndarray, q: np.ndarray, index: Index, best: Best, tables: int, hashes: int, width: float, sets: int, reach: float) -> None:
    for lo in range(0, len(q), TOGETHER):
        rows = np.arange(lo, min(lo + TOGETHER, len(q)))
        own = q[rows]
        probes = _probes(own / np.linalg.norm(own, axis=1)[:, None], tables, hashes, width, sets)
        done = np.zeros((len(rows), len(index.ids)), bool)
        for low, high in zip((0, *STAGES), (*STAGES, sets)):
            # the squared distance of unit vectors with the kth cosine
            far = np.where(np.isfinite(best.score[rows, -1]), 2 - 2 * best.score[rows, -1], np.inf)
            rank = np.arange(probes[0][0].shape[1])[None, :]
            wanted = [(rank >= low) & (rank < high) & (score <= reach * far[:, None]) for _, score in probes]
            if any(w.any() for w in wanted):
                seen = _visited(index, probes, wanted) & ~done
                done |= seen
                _ranked(index, ids[rows], own, rows, seen, best)
        short = np.flatnonzero(~np.isfinite(best.score[rows, -1]))
        if len(short):
            _ranked(index, ids[rows[short]], own[short], rows[short], ~done[short], best)


def nearest(df: DataFrame, id_col: str, vector: str, queries: Column, *, k: int = 5, tables: int = 16, hashes: int = 12, width: float = 2.5, sets: int = 200, reach: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` (a condition on `id`) holds for, the k nearest other rows found."""
    rows = taking_part(df, id_col, vector).where(F.exists("x", lambda v: v != 0))
    shards = sharded(rows, lambda ids, x: build(ids, x, tables, hashes, width), "lsh")
    return searched(shards, rows.where(queries), lambda ids, q, index, best: search(ids, q, index, best, tables, hashes, width, sets, reach), k, "double")
