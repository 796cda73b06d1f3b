"""Dual-tree search against brute force: ties, repeats, few rows, odd vectors, blocks, pruning, and the query."""

import math
import time

import numpy as np
import pytest

from sampleweave.llm import cover_tree as ct


def brute(rows, asked, k=5):
    def code(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * float(x)) for x in v]

    points = [(i, code(v)) for i, v in rows if i is not None and code(v) is not None]
    out = []
    queries = {}
    for i, v in asked:
        if i is not None and code(v) is not None:
            queries[i] = min(queries.get(i, v), v)
    for q, v in queries.items():
        best = {}
        for i, c in points:
            if i != q:
                best[i] = max(best.get(i, -(10**18)), sum(a * b for a, b in zip(code(v), c)))
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(sorted(((s, i) for i, s in best.items()), key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


def rows_of(n, seed, size=12):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, size))
    v = (centres[draw.integers(0, 12, n)] + 0.1 * draw.normal(size=(n, size))).astype(np.float32).astype(float)
    v[n // 3 : n // 2] = v[0]
    return [(int(i), x.tolist()) for i, x in zip(draw.permutation(n), v)]


@pytest.mark.parametrize("block, shard, sample", [(8192, 8192, 4096), (7, 60, 40), (8192, 100, 3)])
def test_against_brute_force(spark, monkeypatch, block, shard, sample):
    for name, value in (("BLOCK", block), ("SHARD", shard), ("SAMPLE", sample), ("LEAF", 8)):
        monkeypatch.setattr(ct, name, value)
    rows = rows_of(700, 3)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in ct.top_k(frame, frame.filter("vec_id % 9 = 0")).collect())
    assert got == brute(rows, [r for r in rows if r[0] % 9 == 0])


def test_tree_covers_and_prunes(monkeypatch):
    monkeypatch.setattr(ct, "LEAF", 8)
    points = np.floor(256 * np.array([v for _, v in rows_of(3000, 4)]))
    root = ct.cover_tree(points)
    stack = [root]
    while stack:
        node = stack.pop()
        assert np.linalg.norm(points[node.places] - node.centre, axis=1).max() <= node.radius + 1e-4
        assert not node.children or sorted(np.concatenate([c.places for c in node.children])) == sorted(node.places)
        stack += node.children
    queries, held = points[:64], [[i] for i in range(len(points))]
    least = np.sort(queries @ points.T, axis=1)[:, -5]
    assert ct.search(queries, ct.cover_tree(queries), points, held, ct.Best(np.full(64, -1), 5, least)) < 0.5 * 64 * len(points)


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (50, [1.0, nan]), (None, [1.0, 1.0]), (1, None), (2, [None, 1.0]), (3, [-1.5, 0.25]), (3, [-1.5, 0.25]), (100, [0.5]), (4, []), (0, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "7 as query_id", "1 as score")
    got = sorted(tuple(r) for r in ct.top_k(frame, frame.filter("vec_id % 50 = 0")).collect())
    filled = [(i, None if v is None else (v + [0.0, 0.0])[:2]) for i, v in rows]
    assert got == brute(filled, [r for r in filled if r[0] is not None and r[0] % 50 == 0])
    assert ct.top_k(frame.limit(0), frame).count() == 0 and ct.top_k(frame, frame.limit(0)).count() == 0


def test_cost_is_near_that_of_matrix_products():
    draw = np.random.default_rng(6)
    points = draw.normal(size=(20_000, 64))
    points = np.floor(256 * points / np.linalg.norm(points, axis=1, keepdims=True))
    queries = points[::10].copy()
    began = time.perf_counter()
    scores = queries @ points.T
    product = time.perf_counter() - began
    scores[np.arange(2000), np.arange(2000) * 10] = -np.inf
    least = np.sort(scores[:, :4000], axis=1)[:, -5]
    best = ct.Best(np.arange(2000) * 10, 5, least)
    began = time.perf_counter()
    ct.search(queries, ct.cover_tree(queries), points, [[i] for i in range(20_000)], best)
    assert time.perf_counter() - began < 20 * product + 2  # pairs offered one by one had not ended after 90 s
    want = np.lexsort((np.broadcast_to(np.arange(20_000), scores.shape), -scores), axis=1)[:, :5]
    assert best.found.tolist() == want.tolist()


@pytest.mark.parametrize("shard, sample", [(8192, 4096), (50, 3)])
def test_large_scores_and_many_ties(spark, monkeypatch, shard, sample):
    monkeypatch.setattr(ct, "SHARD", shard)
    monkeypatch.setattr(ct, "SAMPLE", sample)
    large = [(i, [400 * x for x in v]) for i, v in rows_of(300, 7)]  # products beyond single precision
    sparse = [(i, [float((i * 7 + j) % 31 == 0) * (i % 5 - 1) for j in range(12)]) for i in range(600)]  # most pairs score 0
    for rows in (large, sparse, [(i // 3, v) for i, v in sparse]):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
        got = sorted(tuple(r) for r in ct.top_k(frame, frame.filter("vec_id % 9 = 0")).collect())
        assert got == brute(rows, [r for r in rows if r[0] % 9 == 0])


def test_query(spark):
    from sampleweave.llm.queries import op6_cover_tree

    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in op6_cover_tree(spark, sf).collect()) == brute(rows, [r for r in rows if r[0] % 50 == 0])
