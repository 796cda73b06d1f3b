"""Token-id files: exact round trips of blocks, parts of blocks and files, damage, and the query against the tokenizers library."""

import io
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sampleweave.llm import rans, tokens


def table_of(*arrays):
    return rans.Table.of_counts(np.bincount(np.concatenate(arrays)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 49407), min_size=1, max_size=400), st.integers(1, 40))
def test_blocks(ids, times):
    ids = np.array(ids * times, np.uint32)
    table = table_of(ids)
    assert table.freq.sum() == 1 << rans.SCALE
    block = rans.encode_block(ids, table)
    assert (np.concatenate(list(rans.decoded(io.BytesIO(block), 0, table))) == ids).all()


def test_parts_decode_alone():
    draw = np.random.default_rng(3)
    ids = draw.zipf(1.3, rans.BLOCK - 77).astype(np.uint64) % 40000
    ids = ids.astype(np.uint32)
    table = table_of(ids)
    block = rans.encode_block(ids, table)
    parts = rans.HEAD.unpack(block[: rans.HEAD.size])[3]
    assert parts > 1
    assert (np.concatenate([x for p in range(parts) for x in rans.decoded(io.BytesIO(block), 0, table, p, p + 1)]) == ids).all()
    assert len(block) < 2 * len(ids)
    for at in (len(block) - 1, rans.HEAD.size + 40):
        with pytest.raises(ValueError):
            list(rans.decoded(io.BytesIO(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :]), 0, table))
    small = rans.encode_block(ids[:3000], table)
    assert len(small) < 2.2 * 3000


def test_files(monkeypatch):
    monkeypatch.setattr(rans, "UNIT", rans.PART_IDS)
    draw = np.random.default_rng(4)
    docs = [(None if i == 0 else i, draw.integers(0, 5000, size=n).astype(np.uint32)) for i, n in enumerate([1, 5, 700_000, 1, 300_000, 2])]
    table = table_of(*(x for _, x in docs))
    out = io.BytesIO()
    writer = rans.Writer(out, table)
    for doc, ids in docs:
        writer.add(doc, ids)
    writer.close()
    source = pa.PythonFile(io.BytesIO(out.getvalue()), mode="r")
    total = sum(len(x) for _, x in docs)
    units = [[(doc, at, np.concatenate(list(runs))) for doc, at, runs in rans.read_documents(source, table, unit)] for unit in (None, *range(-(-total // rans.UNIT)))]
    for back in (units[0], [x for u in units[1:] for x in u]):
        assert [d for d, *_ in back] == [d for d, _ in docs]
        assert [at for _, at, _ in back] == [sum(len(x) for _, x in docs[:k]) for k in range(len(docs))]
        assert all((a == b).all() for (_, a), (*_, b) in zip(docs, back, strict=True))
    assert len(units) > 3 and not all(units[1:])  # a unit within a long document has none of its own


def test_skewed_and_empty_tables():
    counts = np.zeros(40000, np.int64)
    counts[7], counts[1:30000:3] = 10**12, 1
    assert rans.Table.of_counts(counts).freq.sum() == 1 << rans.SCALE
    assert rans.Table.of_counts(np.zeros(3, np.int64)).freq.sum() == 0


ODD = st.lists(st.sampled_from([" ", "  ", "\n", "\r\n ", "\t", "a", "É", "é", "ß", "word", "The", "12", "7x", "'", "'s", "'Ll", ".", ",", "--", "$$", "×", "÷", "“", "…", "\xa0", "\x85", "\u3000", "\x1c", "\x00", "e\u0301", "漢字", "Σ", "İ", "😀", "ª", "½", "\ua7cb", "<|", "<|endoftext|>"]), max_size=14).map("".join)


@settings(max_examples=250, deadline=None)
@given(st.lists(st.one_of(st.none(), ODD), max_size=6))
def test_many_texts(texts):
    words = tokens.library_words(P.path("word_bpe_49k.json"))
    want = [tokens.id_bytes(words.tokenizer.encode(x or "", add_special_tokens=False).ids) for x in texts]
    assert words.many(texts) == want


def test_a_piece_is_looked_up_once_a_run():
    words = tokens.WordText(P.path("word_bpe_49k.json"))
    asked, found = [], words.pieces.found
    words.pieces.found = lambda pieces: asked.extend(pieces) or found(pieces)
    texts = [" ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}{end}" for j in range(300)) for end in ("", ",", "!!", " -", "?") * 10]
    assert words.many(texts) == [words.ids(x) for x in texts]
    assert len(asked) < 320  # of 15,000 words, many of them with marks
    assert len(words.pieces.held) < 320
    long = "x" * 5000
    assert words.many([long]) == [words.ids(long)] and long.encode() not in words.pieces.held


def test_query(spark, tmp_path):
    from sampleweave.llm.queries import op5_rans

    rows = [(9, "b c", "x"), (2, None, None), (5, "", "x"), (2, "same", "x"), (-4, "a <|endoftext|> z" * 300, "x"), (None, "no id", "x"), (9, "b c", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r)[:4] for r in op5_rans(spark, str(tmp_path)).collect()]
    library = tokens.tokenizer(P.path("word_bpe_49k.json"))
    want = {}
    for doc, text, _ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(doc, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert {d: sorted(x[2:] for x in got if x[0] == d) for d in want} == {d: sorted(x) for d, x in want.items()}
    in_order = sorted(got, key=lambda x: x[1])
    assert [x[0] for x in in_order] == [None, -4, 2, 2, 5, 9, 9]
    assert [x[1] for x in in_order] == [sum(y[2] for y in in_order[:i]) for i in range(len(in_order))]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rans.round_trip(spark, empty, P.path("word_bpe_49k.json"), 1).count() == 0
