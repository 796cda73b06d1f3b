"""BPE by prefixes against the tokenizers library: ids and decoded text, on odd and random texts and through the query."""

import hashlib
import random

import public_tokenizers as P
import pytest

from sampleweave.llm import bpe, tokens

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  a  b\n\n c", "a<|endoftext|>b <|startoftext|><|endoftext|>", "\x1c\x1da\x1fb", "Σίσυφος ΑΣ", "İstanbul ǅ é é", "Ᲊ x",
    "Ɤ A Ɤ", "ok 👨‍👩‍👧", "<|endoftext|", "a\x85d", "x" * 5000, "!" * 3000 + "?" * 777, "don't we'll I'D", "٣٤ ½ ² x_y", "aaaaaaa" * 99, "̀́ ͅ", "﻿a​b", "\r\n\t x \t",
]


@pytest.fixture(scope="module")
def library():
    return tokens.tokenizer(WORD)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    got = bpe.word_text(WORD).ids(text)
    assert got == tokens.id_bytes(ids)
    assert tokens.library_words(WORD).ids(text) == got
    assert bpe.vocabulary(WORD).decode(got) == library.decode(ids, skip_special_tokens=False)
    assert tokens.byte_text(BYTE).ids(text) == tokens.id_bytes(tokens.tokenizer(BYTE).encode(text, add_special_tokens=False).ids)


def test_random_texts(library):
    draw = random.Random(1)
    other = tokens.tokenizer(BYTE)
    for _ in range(3000):
        text = "".join(draw.choice("aabetionhs éèЖ中'.0\n") for _ in range(draw.randint(1, 30)))
        assert bpe.word_text(WORD).ids(text) == tokens.id_bytes(library.encode(text, add_special_tokens=False).ids), text
        assert tokens.byte_text(BYTE).ids(text) == tokens.id_bytes(other.encode(text, add_special_tokens=False).ids), text


def test_every_token_is_its_own_encoding():
    own = bpe.vocabulary(WORD)
    names = [n.removesuffix("</w>") for n in own.names if n.endswith("</w>") and n != "</w>"]
    letters = tokens.byte_letters()
    for i in range(0, len(names), 7):
        raw = bytes(letters[c] for c in names[i])
        try:
            word = raw.decode()
        except UnicodeDecodeError:
            continue
        assert own.word(word) == own.names.index(names[i] + "</w>").to_bytes(4, "little")


def test_small_caches_change_nothing():
    small = tokens.Cache(lambda xs: {x: x.encode() for x in xs}, most=3)
    draw = random.Random(2)
    for _ in range(200):
        pieces = [draw.choice("abcdefgh") for _ in range(draw.randint(0, 9))]
        assert small.joined(pieces) == "".join(pieces).encode()


def test_query(spark, library, tmp_path):
    from sampleweave.llm.queries import op1_bpe

    rows = [(i, x, "z", "clash") for i, x in enumerate(ODD)] + [(3, ODD[3], None, "again"), (None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in op1_bpe(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(tokens.id_bytes(ids)).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(empty, WORD).count() == 0
