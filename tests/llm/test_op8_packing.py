"""Packing: first-fit decreasing against its definition, whole coverage, little padding, and the query against the tokenizers library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from sampleweave.llm import packing, tokens


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing(sizes):
    bins, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(bins))
        if b == len(bins):
            bins.append([])
            room.append(50)
        bins[b].append(i)
        room[b] -= sizes[i]
    assert packing.first_fit_decreasing(sizes, 50) == bins


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40))
def test_all_ids_once(lengths):
    sequences = packing.pack_lengths(lengths, 64)
    covered = defaultdict(list)
    for sequence in sequences:
        assert 0 < sum(n for *_, n in sequence) <= 64
        for d, s, n in sequence:
            covered[d].append((s, s + n))
    for d, n in enumerate(lengths):
        spans = sorted(covered[d])
        assert spans[0][0] == 0 and spans[-1][1] == n
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert sum(sum(n for *_, n in s) < 64 for s in sequences) <= 1


ODD = st.lists(st.sampled_from([" ", "  ", "\n", "\r\n ", "\t", "a", "É", "é", "ß", "word", "The", "12", "7x", "'", "'s", "'Ll", ".", ",", "--", "$$", "×", "÷", "“", "…", "\xa0", "\x85", "\u3000", "\x1c", "\x00", "e\u0301", "漢字", "Σ", "İ", "😀", "ª", "½", "<|", "<|endoftext|>"]), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), ODD), max_size=6))
def test_many_texts(texts):
    found = tokens.byte_text(P.path("byte_bpe_50k.json"))
    want = [tokens.id_bytes(found.tokenizer.encode(x or "", add_special_tokens=False).ids) for x in texts]
    assert found.many(texts) == want


def test_a_piece_is_looked_up_once_a_run():
    found = tokens.ByteText(P.path("byte_bpe_50k.json"))
    asked, look = [], found.pieces.found
    found.pieces.found = lambda pieces: asked.extend(pieces) or look(pieces)
    texts = [" ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}{end}" for j in range(300)) for end in ("", ",", "!!", " -", "?") * 10]
    assert found.many(texts) == [found.ids(x) for x in texts]
    assert len(asked) < 320  # of 15,000 words, many of them with marks


def test_query(spark, tmp_path):
    from sampleweave.llm.queries import op8_packing

    rows = [(i, " ".join(f"Word {j}" for j in range(i * 7)), "x") for i in range(60)] + [(None, "a\n\n b", "x"), (5, None, "x"), (5, "", None), (9, "long " * 9000, "x"), (9, "long " * 9000, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = op8_packing(spark, str(tmp_path)).collect()
    library = tokens.tokenizer(P.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for doc, text, _ in rows:
        want[doc].append(np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4"))
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
        assert any(len(ids) == r["doc_tokens"] and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for ids in want[r["doc_id"]])
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert sum(r["length"] for r in got) == sum(len(x) for xs in want.values() for x in xs)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), P.path("byte_bpe_50k.json"), 0).count() == 0
