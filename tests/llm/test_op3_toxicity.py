"""Toxicity: features against their definition, FTRL against a row-wise form, held-out accuracy and odd rows."""

import math
import zlib

import numpy as np
import pytest

from sampleweave.llm import toxicity


def test_features():
    a, b = toxicity.features("You, IDIOT!"), toxicity.features("you idiot")
    assert (a == b).all() and len(a) == 3
    assert len(toxicity.features("a b c")) == 3 + 2 + 1
    assert len(toxicity.features(None)) == len(toxicity.features(" 12 .")) == 0
    assert set(toxicity.features("x y")) <= set(toxicity.features("x y z"))
    text = " ".join("w" * (i % 7) + "abc" for i in range(300_000))
    assert (np.diff(toxicity.features(text)) > 0).all()


def test_ftrl_row_by_row():
    draw = np.random.default_rng(0)
    rows = [(np.unique(draw.integers(0, 40, 8)), int(draw.integers(0, 2))) for _ in range(60)]
    rows = [(np.append(x, 50) if y else x, y) for x, y in rows]
    got = toxicity.ftrl(rows, epochs=2, alpha=0.4, beta=1.0, l1=0.5, l2=1.0)
    z, n = {}, {}
    pos = sum(y for _, y in rows)
    bias, seen = math.log((pos + 0.5) / (len(rows) - pos + 0.5)), 1.0

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= 0.5 else -(zi - math.copysign(0.5, zi)) / ((1 + math.sqrt(ni)) / 0.4 + 1.0)

    for _ in range(2):
        for x, y in rows:
            ws = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-(bias + sum(ws.values())))) - y
            for i, w in ws.items():
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / 0.4
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w, n.get(i, 0.0) + g * g
            seen += g * g
            bias -= 0.1 * g / math.sqrt(seen)
    want = {i: weight(i) for i in z if weight(i)}
    assert got.places.tolist() == sorted(want)
    assert np.allclose(got.weights, [want[i] for i in sorted(want)]) and abs(got.bias - bias) < 1e-9


def test_held_out_accuracy(spark):
    from sampleweave.llm.queries import op3_toxicity

    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in op3_toxicity(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(got) == docs.count()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [i for i in labels if got[i]["held_out"]]
    caught = np.mean([got[i]["predicted"] for i in held if labels[i]])
    wrong = np.mean([got[i]["predicted"] for i in held if not labels[i]])
    assert caught > 0.75 and wrong < 0.01


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 0), (None, 1), (3, None), (2, 1)]])
def test_odd_rows(spark, labels):
    docs = spark.createDataFrame([(1, "you idiot", "x"), (2, None, "x"), (2, "", None), (None, "null id", "x"), (5, "long " * 50_000, "x")], "doc_id long, text string, score string")
    got = toxicity.classified(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.classified(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
