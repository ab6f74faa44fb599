from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from keytide.llm.ann import nearest
from keytide.llm.exact_topk import exact_topk


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 24))
    x[100:300] = x[100] + rng.normal(size=(200, 24)) * 1e-3  # a hot vector
    x[300:310] = x[50]  # exact ties
    data = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    odd = [(700, None, "c"), (750, [], "c"), (800, [1.0] * 23 + [None], "c"), (850, [1.0] * 23 + [float("nan")], "c"), (900, [float("inf")] * 24, "c"), (950, [0.0] * 24, "c"), (None, [1.0] * 24, "c"), (1000, [1.0, 2.0], "c"), (1001, [2.0, 1.0], "c"), (5, x[5].tolist(), "c")]
    df = spark.createDataFrame(data + odd, "vec_id bigint, embedding array<double>, score string")
    return df, {i: np.array(v) for i, v, _ in data}


def test_exact_topk_equals_brute_force(vectors):
    df, x = vectors
    q = {i: np.floor(256 * v).astype(np.int64) for i, v in x.items()} | {950: np.zeros(24, np.int64)}
    want = set()
    for i in q:
        if i % 50 == 0:
            best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:5]
            want |= {(i, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    want.add((1000, 1, 1001, 256 * 512 * 2))
    assert {tuple(r) for r in exact_topk(df, "vec_id", "embedding", F.col("id") % 50 == 0).collect()} == want
    assert exact_topk(df.where("false"), "vec_id", "embedding", F.col("id") % 50 == 0).count() == 0


def test_sums_beyond_doubles_are_exact(spark):
    df = spark.createDataFrame([(0, [3e5 + 0.01, 1.0]), (1, [3e5, 1.0]), (2, [3e5, 1.0 + 1 / 256])], "vec_id bigint, embedding array<double>")
    rows = exact_topk(df, "vec_id", "embedding", F.col("id") == 0).collect()
    a = [int(np.floor(256 * (3e5 + 0.01))), 256]
    assert [(r.vec_id, r.score) for r in rows] == [(2, a[0] * 76800000 + 256 * 257), (1, a[0] * 76800000 + 256 * 256)]


def test_neighbours_have_recall_and_exact_scores(vectors):
    df, x = vectors
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    hit = total = 0
    found: dict[int, list] = {}
    for r in nearest(df, "vec_id", "embedding", F.col("id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append(r)
    for i in x:
        if i % 20 == 0:
            own = sorted(found[i], key=lambda r: r["rank"])
            assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and all(r.score == pytest.approx(cos(x[i], x[r.vec_id]), abs=1e-12) for r in own)
            assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
            fifth = sorted((-cos(x[i], x[j]) for j in x if j != i))[4]
            hit += sum(-r.score <= fifth + 1e-12 for r in own)
            total += 5
    assert hit >= 0.9 * total
    assert [(r.vec_id) for r in nearest(df, "vec_id", "embedding", F.col("id") == 1000).collect()] == [1001]
    assert nearest(df.where("false"), "vec_id", "embedding", F.col("id") == 1).count() == 0


def test_many_rounds_and_shards_find_the_same(vectors, monkeypatch):
    from keytide.llm import vectors as v

    df, _ = vectors
    every = F.col("id") % 10 == 0
    want = {tuple(r) for r in exact_topk(df, "vec_id", "embedding", every).collect()}
    monkeypatch.setattr(v, "SHARD_ROWS", 150)
    monkeypatch.setattr(v, "ROUND_ROWS", 20)
    assert {tuple(r) for r in exact_topk(df, "vec_id", "embedding", every).collect()} == want
    found = nearest(df, "vec_id", "embedding", every).collect()
    assert {(r.query_id, r["rank"]) for r in found if r.query_id < 700} == {(i, k) for i in range(0, 700, 10) for k in range(1, 6)}


def test_probes_come_likeliest_first():
    from keytide.llm.ann import perturbations

    sets = perturbations(6, 200)
    assert not sets[0].any() and sets[1].tolist() == [1] + [0] * 11 and len({tuple(x) for x in sets.tolist()}) == len(sets)
    assert all(not (x[j] and x[11 - j]) for x in sets for j in range(6))


@pytest.mark.parametrize("spread, most", [(0.05, 0.05), (0.35, 0.35)])
def test_near_neighbours_are_found_in_few_rows(monkeypatch, spread, most):
    """Recall against brute force on 16,000 rows around 400 centres, and the share of rows that is ranked."""
    from keytide.llm import ann
    from keytide.llm.vectors import Best

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(400, 64))
    x = centres[rng.integers(0, 400, 16_000)] + spread * rng.normal(size=(16_000, 64))
    shape = dict(tables=16, hashes=12, width=2.5)
    index, ids, n, ranked = ann.build(np.arange(len(x)), x, **shape), np.arange(200), 200, []
    seen = ann._visited
    monkeypatch.setattr(ann, "_visited", lambda *a: ranked.append(seen(*a)) or ranked[-1])
    best = Best(n, 5)
    ann.search(ids, x[:n], index, best, **shape, sets=200, reach=1.0)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    c = u[:n] @ u.T
    c[ids, ids] = -2
    top = np.argsort(-c, axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(top.tolist(), best.id.tolist())]) >= 0.95
    assert sum(r.sum() for r in ranked) <= most * n * len(x)
