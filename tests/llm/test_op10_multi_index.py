"""The multi-index: its walk against sorting, recall and links against brute force, hot cells, odd vectors, and the query."""

import numpy as np
import pytest

from sampleweave.llm import multi_index as mi


def brute(rows, limit=0.93):
    good = {}
    for k, (vec_id, v, label) in enumerate(rows):
        if vec_id is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not np.any(v):
            continue
        good[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links, root = dict.fromkeys(range(len(rows)), 0), {k: k for k in range(len(rows))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ks = list(good)
    for x, a in enumerate(ks):
        for b in ks[:x]:
            if rows[a][2] == rows[b][2] and good[a] @ good[b] >= limit:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k in ks:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return sorted(((r[0], links[k], least[find(k)] if k in good else r[0]) for k, r in enumerate(rows)), key=str)


def clusters(n, seed, noise=0.02):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(max(2, n // 4), 16))
    out = centres[draw.integers(0, len(centres), n)]
    out /= np.linalg.norm(out, axis=1, keepdims=True)
    out = out + draw.normal(size=out.shape) * draw.uniform(0, 4 * noise, (n, 1))
    return out.astype(np.float32)


def test_walk():
    draw = np.random.default_rng(1)
    a, b = np.sort(draw.random(9)).tolist(), np.sort(draw.random(7)).tolist()
    got = list(mi.traversed(a, b, list(range(9)), list(range(7)), 0.8))
    want = sorted(((x + y, i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x + y <= a[0] + b[0] + 0.8))
    assert [a[i] + b[j] for i, j in got] == [s for s, *_ in want] and set(got) == {(i, j) for _, i, j in want}


@pytest.mark.parametrize("most", [4096, 7])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(mi, "MOST", most)
    monkeypatch.setattr(mi, "HOMES", 12)
    vectors = clusters(500, 2)
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[5][1], 2) for i in range(60)] + [(2000 + i, (vectors[9] * (1 + i)).tolist(), 0) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted((tuple(r)[:3] for r in mi.near_duplicates(frame).collect()), key=str)
    want = brute([(i, np.array(v, np.float32).astype(float).tolist(), y) for i, v, y in rows])
    assert [g[0] for g in got] == [w[0] for w in want]
    found, true = sum(g[1] for g in got), sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and found >= 0.97 * true
    assert np.mean([g[2] == w[2] for g, w in zip(got, want)]) > 0.97


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (10, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as n_links", "2 as rep")
    assert sorted((tuple(r)[:3] for r in mi.near_duplicates(frame).collect()), key=str) == brute(rows)
    assert mi.near_duplicates(frame.limit(0)).count() == 0


def test_query_recall(spark):
    from sampleweave.llm.queries import op10_multi_index

    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r["vec_id"]: r for r in op10_multi_index(spark, sf).collect()}
    assert len(got) == len(rows)
    unit = np.array([r[1] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    true = {r[0]: int(n) - 1 for r, n in zip(rows, near.sum(axis=1))}
    assert all(got[i]["n_links"] <= true[i] for i in got)
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * sum(true.values())
