"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased runs of letters inside white-space chunks; a document's features are the set of hashes of its
words, its pairs of neighbours and its pairs with one word between. Training sees a bounded sample of labelled documents:
the SAMPLE first by a hash of their doc_id, one text for each, and of these, in order, as many as have FEATURES features
in all; one task, EPOCHS passes. Per-coordinate learning rates and L1 leave few weights other than zero; those are
broadcast, and every whole text is scored.

Cases: a null or empty text has no features and scores the bias alone; rows repeat as they come; of texts that share a
doc_id the one with the least features in byte order is learned from; a document with labels that differ counts once with
each; where there is no label to learn from, every score is 0.5; columns other than doc_id, text (documents) and doc_id,
toxic (labels) are not read; scored passes them on, but for an own column toxicity, which the score replaces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleweave.llm.shared import at_work, own_columns, written

BITS = 20  #: hashed features: 2**BITS, so a broadcast model has at most 12 bytes x 2**20
SAMPLE = 8000  #: most labelled documents that are learned from
FEATURES = 1 << 25  #: most features over all of them
EPOCHS = 3
THRESHOLD = 0.3
CACHE = 150_000  #: most chunks, and most words, that are remembered

LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
PAIR, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Hashes(dict):
    """The hash of the words of a white-space chunk, for chunks of one word; 0 for none. Chunks of several words are cut first."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = found = zlib.crc32(word.encode("utf-8", "surrogatepass")) * 0x9E3779B1 % (1 << 64) | 1
        return found


class Chunks(dict):
    """The words of a chunk, joined by spaces; "" where it has none. Remembers what it has seen."""

    def __missing__(self, chunk: str) -> str:
        if len(self) >= CACHE:
            self.clear()
        self[chunk] = found = chunk if chunk.isalpha() else " ".join(LETTERS.findall(chunk))
        return found


CHUNKS, HASHES = Chunks(), Hashes()


def forget() -> None:
    CHUNKS.clear()
    HASHES.clear()


def features(text: str | None) -> np.ndarray:
    """The document's different features, ascending."""
    words = " ".join(map(CHUNKS.__getitem__, (text or "").lower().split())).split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    found = [h]
    for gap, salt in ((1, PAIR), (2, SKIP)):
        if len(h) > gap:
            mixed = h[:-gap] * salt + h[gap:]
            found.append((mixed ^ (mixed >> np.uint64(29))) * salt)
    seen = np.zeros(1 << BITS, bool) if len(h) > 1 << 18 else None
    places = [(x >> np.uint64(64 - BITS)).astype(np.int64) for x in found]
    if seen is None:
        return np.unique(np.concatenate(places))
    for x in places:
        seen[x] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    """Weights other than zero at ascending places, and a bias."""

    places: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, found: np.ndarray, dense: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + dense[found].sum(), -35, 35))))

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.places] = self.weights
        return out


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, alpha: float = 1.0, beta: float = 1.0, l1: float = 5.0, l2: float = 1.0) -> Model:
    """FTRL-proximal: each coordinate keeps z and n; its rate falls with the gradients it has seen and its weight is zero until |z| passes l1."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    positive = sum(y for _, y in rows)
    bias = float(np.log((positive + 0.5) / (len(rows) - positive + 0.5))) if rows else 0.0
    seen = 1.0
    for _ in range(epochs):
        for x, y in rows:
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= l1, 0.0, (np.sign(zx) * l1 - zx) / ((beta + root) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / alpha * w
            n[x] = nx + g * g
            seen += g * g
            bias -= 0.1 * g / np.sqrt(seen)
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    places = np.flatnonzero(w)
    return Model(places, w[places], bias)


def fitted(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled (doc_id, toxic): the first sample rows by a hash of doc_id.

    The sample's ids, at most sample rows, are broadcast to the scan of documents; its features go to one task.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("toxicity", forget)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                found = [features(x).astype("<i4").tobytes() for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "toxic", "found"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0  # the rows come in order
        for batch in batches:
            for y, x in zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
                held += len(x) // 4
                if held <= FEATURES:
                    rows.append((np.frombuffer(x, "<i4"), y))
        model = ftrl(rows)
        if not rows:
            return
        yield pa.RecordBatch.from_arrays([pa.array([-1, *model.places], pa.int64()), pa.array([model.bias, *model.weights], pa.float64())], ["place", "weight"])

    usable = labelled.filter("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    hashed = F.xxhash64("doc_id", F.lit(7))
    share = min(1.0, 1.2 * sample / max(1, usable.count()))  # so that tasks send about the sample, not a sample each
    chosen = usable.filter(F.pmod(hashed, F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).orderBy(hashed, "doc_id", "toxic").limit(sample)
    rows = own_columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(read, "doc_id long, toxic int, found binary")
    some = written(rows.groupBy("doc_id", "toxic").agg(F.min("found").alias("found")), "features")
    in_order = some.repartition(1).sortWithinPartitions(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id", "toxic")
    weights = in_order.mapInArrow(train, "place long, weight double").orderBy("place").collect()
    if not weights:
        return Model(np.empty(0, np.int64), np.empty(0), 0.0)
    return Model(np.array([r["place"] for r in weights[1:]], np.int64), np.array([r["weight"] for r in weights[1:]]), weights[0]["weight"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with its own columns and toxicity, a score from 0 to 1 of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("toxicity", forget)
        dense = model.dense()
        for whole in batches:
            text = whole.schema.get_field_index("text")
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                scores = [model.score(features(x), dense) for x in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names)

    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "toxicity"))
    names = [*docs.columns, "toxicity"]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())]))


def held_out(doc_id) -> F.Column:
    """Whether a document is never learned from: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classified(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model of the labels that are not held out."""
    model = fitted(docs, labels.filter(~held_out(F.col("doc_id"))))
    return scored(own_columns(docs, "doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))
