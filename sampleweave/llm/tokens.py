"""Splitting text the way a tokenizer file says, with the ids of each piece kept in bounded caches.

A text is cut at places where no merge can cross (white space), each chunk's ids are looked up, and only chunks
that the cache does not hold are encoded. Results never depend on what a cache holds; a full cache is emptied.

Ids are bytes throughout: little-endian unsigned 32-bit integers, so a document's ids are one ``bytes.join``.

Many texts at a time (``many``) are cut by byte classes into pieces that no pre-token crosses; Arrow numbers the
different pieces of a run of texts, so that only these are looked up, and gathers the ids of all pieces from them.
"""

from __future__ import annotations

import functools
import gc
import json
import os
import re
import unicodedata
from array import array
from collections import ChainMap
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

#: Most entries of a generation of a cache.
CACHE = 450_000
#: Characters whose class or case is newer than the Unicode tables of Python: such texts are normalised and cut into words by the library's own steps.
NEWER = re.compile("[\u1c89\u1c8a\ua7cb-\ua7f1\U00010d40-\U00010d8f\U00010ec0-\U00010eff\U00016ea0-\U00016eff]")
#: Controls that str.split takes for white space and tokenizers do not.
CONTROLS = "\x1c\x1d\x1e\x1f"
#: White space outside ASCII.
SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters of a run of texts that are cut together, about.
RUN = 1 << 22
#: Longer pieces, in bytes, are not kept.
LONG = 256
#: Classes of bytes: anything else, letter, digit, mark, apostrophe, space, other white space.
OTHER, LETTER, DIGIT, MARK, APOSTROPHE, SPACE, WHITE = range(7)


def byte_class(b: int) -> int:
    if b == 0x20 or 9 <= b <= 13:
        return SPACE if b == 0x20 else WHITE
    if 0x20 < b < 0x7F:
        return LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else APOSTROPHE if b == 0x27 else MARK
    return OTHER


def cut_between(a: int, b: int) -> bool:
    """Whether a pre-token always ends between characters of classes a and b: where white space begins, behind white space that no word takes along, and between letters, digits and marks (an apostrophe may belong to the letters behind it)."""
    if (a >= SPACE) != (b >= SPACE):
        return a != SPACE
    if OTHER in (a, b) or a >= SPACE:
        return False
    return min(a, MARK) != min(b, MARK) and (a, b) != (APOSTROPHE, LETTER)


CLASS = bytes(map(byte_class, range(256)))
#: For two neighbours' classes as 8 a + b: whether a piece begins with the second, and with the first (the last of a run of white space).
SECOND = bytes(cut_between(*divmod(x, 8)) for x in range(64)) + bytes(192)
FIRST = bytes(x // 8 in (SPACE, WHITE) and x % 8 < SPACE for x in range(64)) + bytes(192)


def tokenizer(path: str):
    """The tokenizers library's own tokenizer, one thread, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, to the byte: printable ones stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def by_library(found) -> Callable[[list[str]], list[bytes]]:
    """Encodes pre-tokens with the BPE model of a tokenizer of the tokenizers library (its other steps have run already)."""
    letters = {b: c for c, b in byte_letters().items()}
    run = found.model.tokenize

    def encode(words: list[str]) -> list[bytes]:
        return [array("I", [t.id for t in run(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))]).tobytes() for w in words]

    return encode


def pieces_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The pieces of UTF-8 texts, and the places in them where each text begins and ends (between two texts lies a piece of no text)."""
    data = b"\n" + b"\n".join(texts) + b"\n"
    byte, kind = np.frombuffer(data, np.uint8), np.frombuffer(bytearray(data.translate(CLASS)), np.uint8)
    at = np.flatnonzero(byte == 0xC3)  # U+00C0 to U+00FF: letters but for the signs of multiplication and division
    at = at[(byte[at + 1] != 0x97) & (byte[at + 1] != 0xB7)]
    kind[at] = kind[at + 1] = LETTER
    pair = ((kind[:-1] << 3) | kind[1:]).tobytes()
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = np.frombuffer(pair.translate(SECOND), bool)
    cut[:-2] |= np.frombuffer(pair.translate(FIRST), bool)
    ends = np.cumsum([len(x) + 1 for x in texts])
    starts = np.concatenate([[1], ends[:-1] + 1])
    cut[starts] = cut[ends] = cut[0] = cut[-1] = True
    cuts = np.flatnonzero(cut)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
    return pieces, np.searchsorted(cuts, starts), np.searchsorted(cuts, ends)


def runs_of(texts: list[str | None]) -> list[tuple[int, int]]:
    """Where runs of about RUN characters begin and end in a list of texts."""
    cuts, held = [0], 0
    for i, text in enumerate(texts):
        if held >= RUN:
            cuts.append(i)
            held = 0
        held += len(text or "")
    return list(zip(cuts, [*cuts[1:], len(texts)], strict=True))


def encoded(texts: list[str], cache: Cache) -> list[bytes]:
    """The ids of texts by the pieces of all of them; cache holds pieces as UTF-8."""
    if not texts:
        return []
    pieces, firsts, lasts = pieces_of(list(map(str.encode, texts)))
    numbered = pieces.dictionary_encode()
    known = cache.found(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
    whole = pa.array(known, pa.large_binary()).take(numbered.indices)
    _, offsets, data = whole.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(whole) + 1, 8 * whole.offset)
    data = memoryview(data or b"")
    return [bytes(data[a:b]) for a, b in zip(offsets[firsts].tolist(), offsets[lasts].tolist(), strict=True)]


def id_bytes(ids) -> bytes:
    return array("I", ids).tobytes()


class Cache:
    """Bounded pieces of text to the bytes of their ids, in two generations: what is used again outlives the older half.

    encode gets the pieces that are missing and returns them, and any others that it had to encode, with their ids.
    """

    def __init__(self, encode: Callable[[list[str]], dict[str, bytes]], most: int = CACHE):
        self.encode, self.most = encode, most
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        gc.set_threshold(200_000, 20, 20)  # caches hold no cycles; looking through them often costs more than encoding

    def joined(self, pieces: list[str]) -> bytes:
        found = list(map(self.held.get, pieces))
        holes, at = [], -1
        try:
            while True:
                at = found.index(None, at + 1)
                holes.append(at)
        except ValueError:
            pass
        if holes:
            self.learn({pieces[i] for i in holes})
            held = self.held
            for i in holes:
                found[i] = held[pieces[i]]
        return b"".join(found)

    def found(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of some different pieces."""
        found = list(map(self.held.get, pieces))
        holes = [i for i, ids in enumerate(found) if ids is None]
        long = [i for i in holes if len(pieces[i]) > LONG]
        if len(long) < len(holes):
            self.learn({pieces[i] for i in holes if len(pieces[i]) <= LONG})
        known = ChainMap(self.held, self.encode([pieces[i] for i in long])) if long else self.held
        for i in holes:
            found[i] = known[pieces[i]]
        return found

    def of(self, piece: str) -> bytes | None:
        found = self.held.get(piece)
        return self.older.get(piece) if found is None else found

    def learn(self, missing: set[str]) -> None:
        again = {x: ids for x in missing if (ids := self.older.get(x)) is not None}
        if len(again) < len(missing):
            again |= self.encode([x for x in missing if x not in again])
        if len(self.held) + len(again) > self.most:
            self.older, self.held = self.held, {}
        self.held.update(again)


def looked_up(cache: Cache, chunks: list[str], split: Callable[[str], list[str]], encode: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
    """The ids of chunks that are words or are split into words of the same cache, and of the words that it did not hold."""
    new = {x: None for x in chunks if x.isalpha()}
    parts, known = [], {}
    for x in chunks:
        if x not in new:
            words = split(x)
            parts.append((x, words))
            for w in words:
                if w not in new and w not in known:
                    ids = cache.of(w)
                    if ids is None:
                        new[w] = None
                    else:
                        known[w] = ids
    words = list(new)
    made = dict(zip(words, encode(words), strict=True))
    known |= made
    for x, words in parts:
        made[x] = b"".join(map(known.__getitem__, words))
    return made


def split_pieces(pieces: list[bytes], find: Callable[[str], list[str]], encode: Callable[[list[str]], list[bytes]], word: Callable[[str], str] = str) -> dict[bytes, bytes]:
    """The ids of pieces in UTF-8, each split into words by itself; word makes one of letters behind at most one space."""
    words, ends = [], [0]
    for x in map(bytes.decode, pieces):
        if x.isalpha() or x[0] == " " and x[1:].isalpha():
            words.append(word(x))
        else:
            words += find(x)
        ends.append(len(words))
    ids = encode(words)
    return {x: ids[a] if b == a + 1 else b"".join(ids[a:b]) for x, a, b in zip(pieces, ends, ends[1:])}


def newer(text: str) -> bool:
    """Whether a text holds a character of NEWER."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return NEWER.search(text) is not None
    return False


class WordText:
    """Texts to ids for a vocabulary with word ends: NFC, lower case, white space dropped, split by the file's pattern.

    encode_words gets distinct words (pre-tokens, normalised) and returns the bytes of their ids.
    """

    def __init__(self, path: str, encode_words: Callable[[list[str]], list[bytes]] | None = None):
        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = tokenizer(path)
        encode_words = encode_words or by_library(self.tokenizer)
        self.special = {x["content"]: x["id"].to_bytes(4, "little") for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.find = regex.compile(pattern).findall
        self.encode = encode_words
        self.chunks = Cache(self._chunks)
        self.pieces = Cache(lambda pieces: split_pieces(pieces, self.find, self.encode, str.lstrip))

    def _chunks(self, chunks: list[str]) -> dict[str, bytes]:
        return looked_up(self.chunks, chunks, lambda x: [x[:-1], x[-1]] if x[-1] in ".,;:" and x[:-1].isalpha() else self.find(x), self.encode)

    def _plain(self, text: str) -> bytes:
        if newer(text):
            whole = self.tokenizer.normalizer.normalize_str(text)
            if newer(whole):
                return b"".join(self.encode([whole[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(whole)]))
            return self.chunks.joined(self.find(whole))
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if any(c in text for c in CONTROLS):
            return self.chunks.joined(self.find(text))
        return self.chunks.joined(text.split())

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text:
            return self._plain(text)
        return b"".join(self.special.get(x) or self._plain(x) for x in self.cut.split(text) if x)


    def many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as ``ids`` gives them with the library's words, one run of texts."""
        found, plain = [b""] * len(texts), {}
        for i, text in enumerate(texts):
            if text and ("<|" in text or newer(text)):
                found[i] = self.ids(text)
            elif text:
                plain[i] = (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()
        for i, ids in zip(plain, encoded(list(plain.values()), self.pieces), strict=True):
            found[i] = ids
        return found


class NotAlone(Exception):
    """A piece between two spaces that is empty or begins or ends with white space: where the cut lies depends on its neighbours."""


class ByteText:
    """Texts to ids for a byte-level vocabulary whose words carry their leading space.

    A text in which each space stands alone between other characters is cut before each space; any other is split
    by the pattern as a whole.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = tokenizer(path)
        self.special = {x["content"]: x["id"].to_bytes(4, "little") for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        import public_tokenizers

        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.encode = by_library(self.tokenizer)
        self.words = Cache(lambda words: dict(zip(words, self.encode(words), strict=True)), CACHE // 8)
        self.later = Cache(self._later, CACHE * 3 // 4)
        self.pieces = Cache(lambda pieces: split_pieces(pieces, self.find, self.encode))

    def _later(self, chunks: list[str]) -> dict[str, bytes]:
        """Chunks that follow a space; their first words are kept without it, the others by themselves in words."""
        if any(not x or x[0].isspace() or x[-1].isspace() for x in chunks):
            raise NotAlone
        new = {x: None for x in chunks if x.isalpha()}
        parts, known = [], {}
        for x in chunks:
            if x not in new:
                head, *rest = [f" {x[:-1]}", x[-1]] if x[-1] in ".,;:" and x[:-1].isalpha() else self.find(f" {x}")
                head = head[1:]
                parts.append((x, head, rest))
                if head not in new and head not in known:
                    ids = self.later.of(head)
                    if ids is None:
                        new[head] = None
                    else:
                        known[head] = ids
        words = list(new)
        made = dict(zip(words, self.encode([f" {w}" for w in words]), strict=True))
        known |= made
        tail = self.words.of
        for x, head, rest in parts:
            ids = tail(rest[0]) if len(rest) == 1 else None
            made[x] = known[head] + (self.words.joined(rest) if ids is None else ids)
        return made

    def _plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return self.words.joined(self.find(text))
        try:
            return self.words.joined(self.find(first)) + self.later.joined(rest)
        except NotAlone:
            return self.words.joined(self.find(text))

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text:
            return self._plain(text)
        return b"".join(self.special.get(x) or self._plain(x) for x in self.cut.split(text) if x)

    def many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as ``ids`` gives them, one run of texts."""
        found, plain = [b""] * len(texts), {}
        for i, text in enumerate(texts):
            if text and ("<|" in text or any(c in text for c in CONTROLS) or not text.isascii() and any(c in text for c in SPACES)):
                found[i] = self.ids(text)
            elif text:
                plain[i] = text
        for i, ids in zip(plain, encoded(list(plain.values()), self.pieces), strict=True):
            found[i] = ids
        return found


@functools.cache
def library_words(path: str) -> WordText:
    """Words encoded by the tokenizers library itself."""
    return WordText(path)


@functools.cache
def byte_text(path: str) -> ByteText:
    return ByteText(path)
