"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

Fixed patterns (e-mail and IP addresses, card and phone numbers) give the base spans. The field labels the tokens that
hold a digit or an @; all other tokens are O, so they only bound the chain. Node potentials come from a token's shape, its
marks and its neighbours; chain potentials join neighbouring tokens; skip potentials join each token to the last one before
it in the document with the same letters and digits, and others to the last one with a like end (the LIKE last letters and
digits of a longer token), however far off. Loopy message passing over all of these makes the labels of repeated and
similar tokens agree. What the patterns found is evidence: their tokens keep their labels, and messages carry them on. A
token whose marginal reaches CERTAIN and that no base span touches starts or extends a span.

The field is trained piecewise, on the labels that the patterns give to a bounded sample of documents (SAMPLE rows, the
first by a hash of doc_id): softmax regression for nodes, smoothed counts for chain, skip and like pairs. A token that the
patterns passed over but that repeats one that they found has no label to learn from and is left out. The weights are
broadcast. Texts are labelled in slices of about SLICE characters, a longer text by itself; edges are gone through by EDGES.

Cases: a null or empty text has no span; rows repeat as they come; where no document has a token to learn from, the field
adds nothing; an empty table gives no row; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleweave.llm.shared import own_columns

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, *(f"crf_{k}" for k in BASE)]
LABELS = 1 + len(BASE)
BITS = 14  #: hashed node features: the weights are 2**BITS x 5 numbers
SAMPLE = 4000
FEATURES = 6  #: features of a token
TOKENS = 400_000  #: most tokens that are learned from
CERTAIN = 0.95
EVIDENCE = 8.0  #: what a base span adds to its label's potential
LIKE = 6  #: letters and digits that the ends of similar tokens share
SLICE = 1 << 20
EDGES = 1 << 16
ROUNDS = 12

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")  # a match can't begin inside a run of digits that failed at its start
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
WORD = re.compile(r"\S+")
HELD = re.compile(r"[0-9@]")
Span = tuple[int, int, int]  #: start, rank in KINDS, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from each @ outwards: the local part is the run of its characters before it, as far as the last match."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start, then by kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if 12 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


@dataclass
class Tokens:
    """The tokens of some texts that the field labels: which text, place, features, and edges between them by kind."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    found: np.ndarray  #: features, FEATURES a token
    chain: np.ndarray  #: the token before, where it is the neighbour, else -1
    skip: np.ndarray  #: the token before with the same letters and digits, else -1
    like: np.ndarray | None = None  #: the token before with a like end and other letters and digits, else -1; None: no such edges


def hashed(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}={value}".encode("utf-8", "surrogatepass")) >> (32 - BITS)


def shape(token: str) -> str:
    return re.sub(r"(.)\1{3,}", r"\1\1\1", re.sub(r"[a-z]+", "a", re.sub(r"[0-9]", "0", token.lower())))


def tokens_of(texts: list[str]) -> Tokens:
    rows, found, chain, skip, like = (array("q") for _ in range(5))
    for k, text in enumerate(texts):
        if not HELD.search(text):
            continue
        last: dict[str, int] = {}
        last_like: dict[str, int] = {}
        before, at = 0, -1
        for m in WORD.finditer(text):
            if not HELD.search(m[0]):
                continue
            token, i = m[0], len(chain)
            left = text[max(0, m.start() - 32) : m.start()].split()
            right = text[m.end() : m.end() + 32].split()
            digits = NOT_DIGIT.sub("", token)
            own = re.sub(r"[^a-z0-9@]", "", token.lower())
            inner = token.strip(".,;:!?()[]{}\"'$%&*#")
            found.extend([hashed("shape", shape(inner)), hashed("digits", str(min(len(digits), 24))), hashed("marks", "".join(sorted(set(re.sub(r"[\w\s]", "", inner)))[:4])), hashed("left", left[-1].lower()[-12:] if left else ""), hashed("right", right[0].lower()[:12] if right else ""), hashed("head", inner[:1] + str(len(inner) > 8))])
            chain.append(i - 1 if at >= 0 and not text[before : m.start()].strip() else -1)
            same = last.get(own, -1)
            skip.append(same)
            end = own[-LIKE:] if len(own) >= LIKE + 2 else ""
            similar = last_like.get(end, -1) if end else -1
            like.append(similar if similar != same else -1)
            if end:
                last_like[end] = i
            last[own] = at = i
            before = m.end()
            rows.extend((k, m.start(), m.end()))
    a = np.array(rows).reshape(-1, 3)
    return Tokens(a[:, 0], a[:, 1], a[:, 2], np.array(found).reshape(-1, FEATURES), np.array(chain), np.array(skip), np.array(like))


def base_labels(made: Tokens, spans: list[list[Span]]) -> np.ndarray:
    """For each token the kind (1 on) of the first base span that touches it, 0 for none."""
    out = np.zeros(len(made.text), np.int64)
    for k in np.unique(made.text):
        low, high = np.searchsorted(made.text, [k, k + 1])  # the tokens of a text lie side by side, in order
        for s, rank, e in reversed(spans[k]):
            a, b = np.searchsorted(made.end[low:high], s, "right"), np.searchsorted(made.start[low:high], e)
            out[low + a : low + b] = rank + 1
    return out


@dataclass
class Field:
    """Potentials in logarithms: nodes by feature and label, chain, skip and like pairs by both labels."""

    nodes: np.ndarray
    bias: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    like: np.ndarray = field(default_factory=lambda: np.zeros((LABELS, LABELS)))

    def marginals(self, made: Tokens, known: np.ndarray | None = None) -> np.ndarray:
        """Loopy belief propagation over all tokens at once; a token without a neighbour on a side has an O there. known: labels that are evidence where they are not 0."""
        own = self.bias + self.nodes[made.found].sum(axis=1)
        if known is not None:
            sure = np.flatnonzero(known)
            own[sure, known[sure]] += EVIDENCE
        own += np.where(made.chain[:, None] < 0, self.chain[0], 0.0)
        followed = np.zeros(len(own), bool)
        followed[made.chain[made.chain >= 0]] = True
        own += np.where(followed[:, None], 0.0, self.chain[:, 0])
        joined = [(b, np.flatnonzero(b >= 0)) for b in (made.chain, made.skip, made.like) if b is not None]
        i = np.concatenate([b[j] for b, j in joined])
        j = np.concatenate([j for _, j in joined])
        kind = np.repeat(np.arange(len(joined)), [len(j) for _, j in joined])
        pair = np.stack([self.chain, self.skip, self.like])
        right, left = np.zeros((len(i), LABELS)), np.zeros((len(i), LABELS))  # messages to j and to i

        def belief() -> np.ndarray:
            out = own.copy()
            np.add.at(out, j, right)
            np.add.at(out, i, left)
            return out

        for _ in range(ROUNDS if len(i) else 0):
            b, moved = belief(), 0.0
            for at in range(0, len(i), EDGES):
                some = slice(at, at + EDGES)
                new_right = log_sum((b[i[some]] - left[some])[:, :, None] + pair[kind[some]], 1)
                new_left = log_sum((b[j[some]] - right[some])[:, None, :] + pair[kind[some]], 2)
                moved = max(moved, np.abs(new_right - right[some]).max(), np.abs(new_left - left[some]).max())
                right[some], left[some] = 0.5 * right[some] + 0.5 * new_right, 0.5 * left[some] + 0.5 * new_left
            if moved < 1e-3:
                break
        b = belief()
        b = np.exp(b - b.max(axis=1, keepdims=True)) if len(own) else own
        return b / b.sum(axis=1, keepdims=True)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    out = np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)
    return out - out.max(axis=1, keepdims=True)


def unsure(t: Tokens, y: np.ndarray) -> np.ndarray:
    """The tokens without a label that repeat one with a label."""
    first = np.arange(len(y))
    for i in np.flatnonzero(t.skip >= 0).tolist():
        first[i] = first[t.skip[i]]
    return (y == 0) & np.isin(first, first[y > 0])


def learned(made: list[tuple[Tokens, np.ndarray]]) -> Field:
    """Piecewise: softmax regression by gradient steps with per-coordinate rates, and smoothed counts of label pairs."""
    nodes, bias = np.zeros((1 << BITS, LABELS)), np.zeros(LABELS)
    chain, skip, like = np.ones((LABELS, LABELS)), np.ones((LABELS, LABELS)) + 2 * np.eye(LABELS), np.ones((LABELS, LABELS)) + np.eye(LABELS)
    kept = [~unsure(t, y) for t, y in made]
    x, y = np.concatenate([t.found[k] for (t, _), k in zip(made, kept, strict=True)]), np.concatenate([y[k] for (_, y), k in zip(made, kept, strict=True)])
    size, seen = np.ones_like(bias), np.ones_like(nodes)
    for _ in range(8):
        for at in range(0, len(y), 256):
            f, want = x[at : at + 256], np.eye(LABELS)[y[at : at + 256]]
            s = bias + nodes[f].sum(axis=1)
            p = np.exp(s - s.max(axis=1, keepdims=True))
            g = p / p.sum(axis=1, keepdims=True) - want
            step = np.zeros_like(nodes)
            for c in range(f.shape[1]):
                np.add.at(step, f[:, c], g)
            rows = np.unique(f)
            seen[rows] += step[rows] ** 2
            nodes[rows] -= 0.3 * step[rows] / np.sqrt(seen[rows]) + 1e-3 * nodes[rows]
            size += g.sum(axis=0) ** 2
            bias -= 0.3 * g.sum(axis=0) / np.sqrt(size)
    for (t, y), k in zip(made, kept, strict=True):
        for before, count in ((t.chain, chain), (t.skip, skip), (t.like, like)):
            j = np.flatnonzero((before >= 0) & k)
            j = j[k[before[j]]]
            np.add.at(count, (y[before[j]], y[j]), 1)
        np.add.at(chain, (0, y[(t.chain < 0) & k]), 1)

    def odds(count: np.ndarray) -> np.ndarray:
        """How much likelier a pair is than its labels apart."""
        share = count / count.sum()
        return np.clip(np.log(share / (share.sum(axis=1, keepdims=True) * share.sum(axis=0, keepdims=True))), -4, 4)

    return Field(nodes, bias, odds(chain), odds(skip), odds(like))


def added_spans(text: str, k: int, made: Tokens, certain: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of text k: neighbouring tokens of one certain label, without marks around them, that no base span touches."""
    out: list[list[int]] = []
    low, high = np.searchsorted(made.text, [k, k + 1])
    for i in low + np.flatnonzero(certain[low:high] > 0):
        s, e, rank = int(made.start[i]), int(made.end[i]), int(certain[i]) + len(BASE) - 1
        if out and out[-1][1] == rank and made.chain[i] == i - 1 and certain[i - 1] == certain[i]:
            out[-1][2] = e
        else:
            out.append([s, rank, e])
    kept, starts, reach = [], [b for b, _, _ in base], np.maximum.accumulate([0, *(f for _, _, f in base)])
    for s, rank, e in out:
        while s < e and not (text[s].isalnum() or text[s] in "+("):
            s += 1
        while s < e and not text[e - 1].isalnum():
            e -= 1
        if s < e and reach[bisect.bisect_left(starts, e)] <= s:  # no base span that begins before e ends after s
            kept.append((s, rank, e))
    return kept


def slices(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most 256 texts and about SLICE characters."""
    at, size, lengths = 0, 0, [len(x or "") for x in whole.column(1).to_pylist()]
    for k, n in enumerate(lengths):
        if k > at and (size + n > SLICE or k - at == 256):
            yield whole.slice(at, k - at)
            at, size = k, 0
        size += n
    if at < len(lengths):
        yield whole.slice(at)


def fitted(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    """The field of a bounded sample: one task gets the sampled texts' tokens (at most TOKENS) and returns the weights."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = [], 0
        for batch in batches:
            for x in batch.column(1).to_pylist():
                t = tokens_of([x])
                if len(t.text) and held + len(t.text) <= TOKENS:
                    made.append((t, base_labels(t, [base_spans(x)])))
                    held += len(t.text)
        if made:
            f = learned(made)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f8").tobytes() for x in (f.nodes, f.bias, f.chain, f.skip, f.like)])], ["weights"])

    share = min(1.0, 1.2 * sample / max(1, docs.count()))
    key = F.xxhash64("doc_id", F.lit(9))
    some = docs.filter(F.pmod(key, F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).filter(F.col("text").rlike("[0-9@]"))
    some = some.select(key.alias("key"), "text").repartition(1).sortWithinPartitions("key", "text").limit(sample)
    rows = [r[0] for r in some.mapInArrow(learn, "weights binary").collect()]
    if not rows:
        return None
    nodes, bias, *pairs = (np.frombuffer(x, "<f8") for x in rows)
    return Field(nodes.reshape(-1, LABELS), bias, *(x.reshape(LABELS, LABELS) for x in pairs))


def scan(docs: DataFrame, certain: float = CERTAIN) -> DataFrame:
    """doc_id, spans: an array of (start, rank, end, kind) in order of start, then of the kind's place in KINDS."""
    docs = own_columns(docs, "doc_id", "text")
    model = fitted(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = [x or "" for x in batch.column(1).to_pylist()]
                spans = [base_spans(x) if HELD.search(x) else [] for x in texts]
                if model is not None:
                    made = tokens_of(texts)
                    p = model.marginals(made, base_labels(made, spans))
                    sure = np.where(p.max(axis=1) >= certain, p.argmax(axis=1), 0) if len(p) else np.empty(0, np.int64)
                    for k in np.unique(made.text[sure > 0]):
                        spans[k] = sorted(spans[k] + added_spans(texts[k], k, made, sure, spans[k]))
                out = [[{"start": s, "rank": r, "end": e, "kind": KINDS[r]} for s, r, e in x] for x in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    return docs.mapInArrow(run, "doc_id long, spans array<struct<start:int,rank:int,end:int,kind:string>>")
