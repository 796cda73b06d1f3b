"""Personal data: base spans against the plain patterns, message passing against enumeration, consistency, and the query."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np

from sampleweave.llm import pii


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans():
    draw = random.Random(3)
    for _ in range(20000):
        text = "".join(draw.choice("a.@-+0149 (é") for _ in range(draw.randint(0, 40)))
        assert pii.base_spans(text) == brute(text), text
    assert pii.base_spans("4111 1111 1111 1111, 1.2.3.4.5.6.7.8 +1 (521) 555-2373") == brute("4111 1111 1111 1111, 1.2.3.4.5.6.7.8 +1 (521) 555-2373")
    assert pii.base_spans("a" * 200_000 + "@" + "b" * 200_000 + "1" * 200_000) == []


def test_message_passing_is_exact_on_chains():
    draw = np.random.default_rng(0)
    made = pii.tokens_of(["call 12 34 56 then 78 and 90 x@y"])
    made.skip[:] = -1
    field = pii.Field(draw.normal(size=(1 << pii.BITS, 5)), draw.normal(size=5), draw.normal(size=(5, 5)), draw.normal(size=(5, 5)))
    n = len(made.text)
    own = field.bias + field.nodes[made.found].sum(axis=1)
    want = np.zeros((n, 5))
    followed = set(made.chain[made.chain >= 0].tolist())
    for ys in itertools.product(range(5), repeat=n):
        s = sum(own[i, y] for i, y in enumerate(ys))
        for i, y in enumerate(ys):
            s += field.chain[ys[made.chain[i]] if made.chain[i] >= 0 else 0, y]
            s += 0 if i in followed else field.chain[y, 0]
        for i, y in enumerate(ys):
            want[i, y] += np.exp(s)
    assert np.abs(field.marginals(made) - want / want.sum(axis=1, keepdims=True)).max() < 0.02


def test_repeated_tokens_agree():
    made = pii.tokens_of(["phone 5551234567 and later, alone: 5551234567"])
    assert made.skip.tolist() == [-1, 0]
    nodes = np.zeros((1 << pii.BITS, 5))
    nodes[made.found[0, 3], 4] = 4.0  # the word on its left
    alone = pii.Field(nodes, np.array([0.5, 0, 0, 0, 0]), np.zeros((5, 5)), np.zeros((5, 5))).marginals(made)
    agreed = pii.Field(nodes, np.array([0.5, 0, 0, 0, 0]), np.zeros((5, 5)), 3 * np.eye(5)).marginals(made)
    assert alone[1].argmax() == 0 and agreed[1].argmax() == 4


def test_similar_tokens_are_joined():
    made = pii.tokens_of(["a1@x-mail.org b2@x-mail.org a1@x-mail.org 7"])
    assert made.skip.tolist() == [-1, -1, 0, -1] and made.like.tolist() == [-1, 0, 1, -1]
    nodes = np.zeros((1 << pii.BITS, 5))
    nodes[made.found[0, 3], 1] = 6.0  # the first token's empty left side
    base = pii.Field(nodes, np.array([0.5, 0, 0, 0, 0]), np.zeros((5, 5)), np.zeros((5, 5)))
    agreed = pii.Field(nodes, base.bias, base.chain, base.skip, 3 * np.eye(5))
    assert base.marginals(made)[1].argmax() == 0 and agreed.marginals(made)[1].argmax() == 1


def test_slices_change_nothing(monkeypatch):
    draw = np.random.default_rng(5)
    made = pii.tokens_of([" ".join(str(x) for x in draw.integers(0, 300, 400)) for _ in range(3)])
    model = pii.Field(draw.normal(size=(1 << pii.BITS, 5)), draw.normal(size=5), *draw.normal(size=(3, 5, 5)))
    whole = model.marginals(made)
    monkeypatch.setattr(pii, "EDGES", 7)
    assert np.allclose(model.marginals(made), whole)
    monkeypatch.setattr(pii, "SLICE", 50)
    batch = pii.pa.RecordBatch.from_arrays([pii.pa.array(range(5)), pii.pa.array(["a" * 60, "b", None, "c" * 49, "d"])], ["doc_id", "text"])
    assert [x.column(0).to_pylist() for x in pii.slices(batch)] == [[0], [1, 2, 3], [4]]


def test_fitted_field_finds_what_patterns_miss(spark):
    """Numbers in the places of phone numbers, but without their plus sign: the patterns find none of them, the field fitted on the patterns' own labels does; clean texts stay clean."""
    draw = random.Random(4)
    number = lambda: f"{draw.randint(200, 999)}555{draw.randint(1000, 9999)}"
    rows = []
    for i in range(1500):
        room = draw.randint(1, 99)
        rows.append((i, f"Write to us. Phone +1{number()} is free today, in room {room} we have {draw.randint(2, 40)} seats. Room {room} is ours."))
    rows += [(2000 + i, f"Phone +1{(x := number())} is free. Later on, page 7, phone 1{x} is free, too.") for i in range(100)]
    rows += [(3000 + i, f"In room {draw.randint(1, 99)} we have {draw.randint(2, 40)} seats and {draw.randint(100, 999)} books.") for i in range(100)]
    texts = dict(rows)
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["spans"]] for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {i: [texts[i][s:e] for s, e, k in x if k == "crf_phone"] for i, x in got.items()}
    assert not any(brute(texts[i])[1:] for i in range(2000, 2100))  # the patterns find the first number alone
    assert sum(len(added[2000 + i]) == 1 and added[2000 + i][0].isdigit() for i in range(100)) > 90
    assert not any(got[3000 + i] for i in range(100)) and all(len(got[i]) == 1 for i in range(1500))


def test_query(spark, tmp_path):
    from sampleweave.llm.queries import op9_pii

    rows = [(i, f"mail me.{i}@host.example.org or call +1 (521) 555-{2000 + i}, card 4111111111111111 é 10.0.0.{i}. bye", "x", "y") for i in range(300)]
    rows += [(900, "phone: 5551234567", "x", "y"), (901, None, None, None), (None, "", "x", "y"), (902, "no data here", "x", "y"), (900, "phone: 5551234567", "x", "y"), (903, "1 " * 40_000, "x", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, kind string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in op9_pii(spark, str(tmp_path)).collect()), key=lambda r: str(r[:6]))
    want = []
    for i, t, *_ in rows:
        b = brute(t)
        n = Counter(r for _, r, _ in b)
        want.append((i, n[0], n[1], n[2], n[3], hashlib.sha256(",".join(f"{pii.BASE[r]}:{s}:{e}" for s, r, e in b).encode()).hexdigest()))
    assert [r[:6] for r in got] == sorted(want, key=str)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        base = ",".join(f"{pii.BASE[k]}:{s}:{e}" for s, k, e in brute(texts[r[0]]))
        assert ",".join(x for x in r[6].split(",") if not x.startswith("crf_")) == base
        assert r[0] != 902 or r[6] == ""
    assert pii.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clean = spark.createDataFrame([(i, "no data here") for i in range(600)] + [(700, "a 5")], "doc_id long, text string").coalesce(1)
    assert all(not r["spans"] for r in pii.scan(clean).collect())
    assert pii.scan(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()["spans"] == []
