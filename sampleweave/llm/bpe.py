"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word the last token of its encoding is unique. A suffix automaton of the vocabulary gives, while
a word is read, the tokens that end at each position, longest first; the one whose predecessor (the last token of the
prefix before it) it is compatible with is stored; following these back from the end of the word gives its exact ids.
Two tokens are compatible if no merge across their border would have come before the merges that made them.

Cases: a null or empty text has no ids and decodes to an empty text; special tokens in a text are their own ids; every
row gives one row, repeated rows too; of the columns only doc_id and text are read, others may have any name.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sampleweave.llm.shared import at_work, own_columns
from sampleweave.llm.tokens import WordText, byte_letters

#: Most pairs of tokens whose compatibility is remembered.
PAIRS = 1_000_000
NEVER = 1 << 30


class Vocabulary:
    """A vocabulary with its merges, as a suffix automaton over symbols: bytes, and bytes that end a word (256 more)."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, letters = spec["model"], byte_letters()
        self.end = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.names: list[str] = [""] * (1 + max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]))
        for name, i in [*vocab.items(), *((x["content"], x["id"]) for x in spec["added_tokens"])]:
            self.names[i] = name
        self.left, self.right, self.merged = {}, {}, {}
        for a, b in model["merges"]:
            i = vocab[a + b]
            self.left[i], self.right[i] = vocab[a], vocab[b]
            self.merged[vocab[a] << 16 | vocab[b]] = i
        self.follow: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        token_of: dict[int, int] = {}
        for name, i in vocab.items():
            ends = bool(self.end) and name.endswith(self.end) and len(name) > len(self.end)
            symbols = [letters[c] for c in (name[: -len(self.end)] if ends else name)]
            if ends:
                symbols[-1] += 256
            token_of[self._add(symbols)] = i
        self._tokens(token_of)
        self.known: dict[int, bool] = {}

    def _add(self, symbols: list[int]) -> int:
        """Adds one string to the automaton; its state."""
        at = 0
        for c in symbols:
            to = self.follow[at].get(c)
            if to is not None:
                at = to if self.size[to] == self.size[at] + 1 else self._copy(at, c, to)
                continue
            new = self._state(self.size[at] + 1, {})
            p = at
            while p >= 0 and c not in self.follow[p]:
                self.follow[p][c] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.follow[p][c]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._copy(p, c, q)
            at = new
        return at

    def _state(self, size: int, follow: dict[int, int]) -> int:
        self.follow.append(follow)
        self.size.append(size)
        self.link.append(0)
        return len(self.size) - 1

    def _copy(self, p: int, c: int, q: int) -> int:
        new = self._state(self.size[p] + 1, dict(self.follow[q]))
        self.link[new] = self.link[q]
        self.link[q] = new
        while p >= 0 and self.follow[p].get(c) == q:
            self.follow[p][c] = new
            p = self.link[p]
        return new

    def _tokens(self, token_of: dict[int, int]) -> None:
        """For each state the tokens that are suffixes of it, longest first: the state's own (or -1) and the next state that has one."""
        self.token = [token_of.get(s, -1) for s in range(len(self.size))]
        self.nearest = [0] * len(self.size)
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.nearest[s] = s if self.token[s] >= 0 else self.nearest[self.link[s]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens where b follows a.

        Goes back in time over the pieces that touch the border. A merge across it counts if both pieces are there when
        its turn comes: before the left one is taken up by its own token's merge, and not after the right one is (of
        equal merges the leftmost goes first).
        """
        key = a << 16 | b
        found = self.known.get(key)
        if found is None:
            found = self._compatible(a, b)
            if len(self.known) >= PAIRS:
                self.known.clear()
            self.known[key] = found
        return found

    def _compatible(self, a: int, b: int) -> bool:
        left_taken = right_taken = NEVER
        while True:
            merge = self.merged.get(a << 16 | b, NEVER)
            if merge < left_taken and merge <= right_taken:
                return False
            undo_a, undo_b = a in self.right, b in self.left
            if undo_a and (a > b or not undo_b):
                left_taken, a = a, self.right[a]
            elif undo_b:
                right_taken, b = b, self.left[b]
            else:
                return True

    def word(self, word: str) -> bytes:
        """The ids of one pre-token."""
        symbols = list(word.encode("utf-8", "surrogatepass"))
        if self.end:
            symbols[-1] += 256
        follow, link, size, nearest, token, compatible = self.follow, self.link, self.size, self.nearest, self.token, self.compatible
        last = [0]  # the last token of each prefix
        start = [0]  # where that token begins
        at = length = 0
        for i, c in enumerate(symbols, 1):
            to = follow[at].get(c)
            while to is None:
                at = link[at]
                length = size[at]
                to = follow[at].get(c)
            at, length = to, length + 1
            s = nearest[at if length == size[at] else link[at]]
            while True:
                t, k = token[s], i - size[s]
                if k == 0 or compatible(last[k], t):
                    break
                s = nearest[link[s]]
            last.append(t)
            start.append(k)
        i, ids = len(symbols), []
        while i:
            ids.append(last[i].to_bytes(4, "little"))
            i = start[i]
        ids.reverse()
        return b"".join(ids)

    def decode(self, ids: bytes) -> str:
        """Without a decoder in its file, a vocabulary's tokens are joined by spaces."""
        return " ".join(map(self.names.__getitem__, memoryview(ids).cast("I")))


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.cache
def word_text(path: str) -> WordText:
    own = vocabulary(path)
    return WordText(path, lambda words: [own.word(x) for x in words])


def round_trip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Each document's ids (little-endian unsigned 32-bit integers) and the text that they decode to: doc_id, ids, decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("bpe", word_text.cache_clear)
        text, own = word_text(vocabulary_path), vocabulary(vocabulary_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = [text.ids(x) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string")
