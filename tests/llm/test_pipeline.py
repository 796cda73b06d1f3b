"""The pipeline: each stage against a brute-force form of its own, and all stages over a small table."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import test_op4_secrets

import corpus_pipeline as cp
from sampleweave.llm import simhash, tokens, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES[:-1]:
        out.append(cp.shared.written(stage(spark, out[-1], SF), name))
        assert out[-1].columns == cp.COLUMNS and out[-1].schema == docs.select(*cp.COLUMNS).schema
    return [{r["doc_id"]: r for r in d.collect()} for d in out] + [cp.packed(spark, out[-1], SF).collect()]


def test_toxicity(spark, stages):
    before, after = stages[0], stages[1]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i, y in labels.items() if not y]
    assert set(after) <= set(before) and all(after[i] == before[i] for i in after)
    assert sum(i in after for i in clean) >= 0.98 * len(clean)
    assert sum(i not in after for i, y in labels.items() if y) >= 0.5 * sum(labels.values())


def test_toxicity_by_hand(spark, stages):
    """What stays is what the weights, added up text by text, leave below the threshold."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fitted(spark.read.parquet(f"{SF}/documents.parquet"), labels.filter(~toxicity.held_out(cp.F.col("doc_id"))))
    weights = dict(zip(model.places.tolist(), model.weights.tolist()))
    scores = {i: 1 / (1 + np.exp(-model.bias - sum(weights.get(f, 0.0) for f in toxicity.features(r["text"]).tolist()))) for i, r in stages[0].items()}
    assert set(stages[1]) == {i for i, x in scores.items() if x < 0.3}


def shares(texts):
    """Pairs of texts and the share of five-word shingles that they have in common, by brute force over shingles in common."""
    sets = {}
    for i, text in texts.items():
        words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    holders = defaultdict(list)
    for i, shingles in sets.items():
        for x in shingles:
            holders[x].append(i)
    common = defaultdict(int)
    for some in holders.values():
        for a in some:
            for b in some:
                if a < b:
                    common[a, b] += 1
    return {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in common.items()}


def test_near_duplicates(stages):
    """Against all pairs' exact shares: every lost document has a link, nearly all linked pairs lose one, and a document without a link stays."""
    before, after = stages[1], stages[2]
    linked = [p for p, x in shares({i: r["text"] for i, r in before.items()}).items() if x >= cp.SIMILARITY]
    near = {i for p in linked for i in p}
    lost = set(before) - set(after)
    assert len(linked) > 50 and lost and lost <= near
    assert np.mean([a in lost or b in lost for a, b in linked]) > 0.97
    assert all(after[i] == before[i] for i in after)


def test_recall_on_documents(spark):
    """Pairs of different texts of sf0.1 at 0.8 and above end in one component, pairs of documents without any link do not."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = simhash.similar(docs).collect()
    component = {r["doc_id"]: r["component_id"] for r in rows}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    common = shares(texts)
    pairs = [p for p, x in common.items() if x >= 0.8 and texts[p[0]] != texts[p[1]]]
    assert len(pairs) > 200 and np.mean([component[a] == component[b] for a, b in pairs]) >= 0.95
    near = {i for p, x in common.items() if x >= 0.8 for i in p}
    assert all(component[i] == i for i in texts if i not in near and (texts[i] or "").split())


def test_rows_not_ids(spark, tmp_path):
    """Rows go by id and text: a text of its own stays though its id is shared, and of a row that is repeated one stays."""
    text = {k: " ".join(f"{k}{i}" for i in range(80)) for k in "ABC"}
    rows = [(1, text["A"], "en", "s", 1), (2, text["A"], "en", "s", 1), (2, text["B"], "en", "s", 1), (5, text["C"], "en", "s", 1), (5, text["C"], "de", "s", 1), (5, text["C"], "de", "s", 1), (None, text["A"], "en", "s", 1), (None, "lone", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    kept = cp.near_duplicates(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "")
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[4], rows[7]], key=str)


def test_secrets(stages):
    """Each text is what replacing the spans, found and replaced in Python, makes of it."""
    before, after = stages[2], stages[3]
    want = {i: test_op4_secrets.brute_redacted(r["text"], test_op4_secrets.spans(r["text"])) for i, r in before.items()}
    assert {i: r["text"] for i, r in after.items()} == want
    assert any(want[i] != r["text"] for i, r in before.items()) and all(r["n_chars"] == len(r["text"]) or want[i] == before[i]["text"] for i, r in after.items())


def test_packing(stages):
    """The pieces of a document, in order, are the library's ids and the end id; each sequence has no gap and at most 1024 ids."""
    docs, pieces = stages[3], stages[4]
    library = tokens.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    own, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        own[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(own) == set(docs)
    for i, rows in own.items():
        ids, at = np.array([*library.encode(docs[i]["text"] or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert zlib.crc32(ids[r["start"] : at].tobytes()) == r["ids_crc32"]
        assert at == len(ids)
    for spans in sequences.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [at for at, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_odd_tables(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "you there", "en", "s", 9), (3, "word " * 5000, "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, found string"
    spark.createDataFrame([(*r, "x", "y") for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert cp.near_duplicates(spark, docs, "").count() == 3  # 1 stands for the empty texts, null and 3 for themselves
    assert cp.without_secrets(spark, docs, "").count() == 5
    assert cp.run(spark, str(tmp_path)).count() >= 0
