"""Packing of documents into sequences of a fixed capacity: first-fit decreasing over a tournament tree.

Documents are dealt to groups by a hash of their id and their ids, about GROUP to a group, and each group is packed by
itself; rows that repeat one in a batch are dealt by their number, too, so no group holds all copies. A
document's ids are cut into full sequences; what is left of each goes, longest first, to the first bin with room, found
in a tournament tree whose inner nodes hold the greatest room below them. Then the emptiest bins are taken apart and
their pieces, cut where need be, fill the gaps of the fuller ones, so that at most one sequence of a group is not full.

Cases: a null or empty text is its end id alone; repeated rows are packed each by itself; a document longer than a
sequence is cut; an empty table gives no piece; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleweave.llm import tokens
from sampleweave.llm.shared import at_work, own_columns

CAPACITY = 1024
GROUP = 512  #: documents of a group, about
Piece = tuple[int, int, int]  #: document (its place in the group), start, length


class Rooms:
    """A tournament tree over bins: the first bin with room for a size in logarithmic time."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> int:
        at, room = 1, self.room
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        found = at - self.leaves
        room[at] -= size
        while at > 1:
            at //= 2
            greatest = max(room[2 * at], room[2 * at + 1])
            if room[at] == greatest:
                break
            room[at] = greatest
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins, each the places of its sizes in the order they came."""
    rooms = Rooms(len(sizes), capacity)
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = rooms.take(sizes[i])
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[Piece]]:
    """Sequences of pieces; every id of every document is in exactly one piece, and at most one sequence isn't full."""
    full = [[(d, s, capacity)] for d, n in enumerate(lengths) for s in range(0, n - capacity + 1, capacity)]
    rest = [(d, n - n % capacity, n % capacity) for d, n in enumerate(lengths) if n % capacity]
    bins = [[rest[i] for i in b] for b in first_fit_decreasing([r[2] for r in rest], capacity)]
    fill = [sum(p[2] for p in b) for b in bins]
    done = [b for b, f in zip(bins, fill, strict=True) if f == capacity]
    partly = sorted((i for i, f in enumerate(fill) if f < capacity), key=lambda i: (-fill[i], i))
    giver = len(partly) - 1
    for k, i in enumerate(partly):
        room = capacity - fill[i]
        while room and giver > k:
            source = bins[partly[giver]]
            if not source:
                giver -= 1
                continue
            d, s, n = source.pop()
            take = min(n, room)
            bins[i].append((d, s, take))
            room -= take
            if take < n:
                source.append((d, s + take, n - take))
        if bins[i]:
            done.append(bins[i])
        if giver <= k:
            break
    return full + done


def pack(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("byte text", tokens.byte_text.cache_clear)
        text, packed, end = tokens.byte_text(vocabulary_path), zstandard.ZstdCompressor(level=1), tokens.id_bytes([end_id])
        for whole in batches:
            seen: dict[int | None, int] = {}  # rows of a doc_id so far in this batch
            texts = whole.column(1).to_pylist()
            for at, stop in tokens.runs_of(texts):
                batch = whole.slice(at, stop - at)
                ids = [x + end for x in text.many(texts[at:stop])]
                if narrow:
                    ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
                again = []
                for doc in batch.column(0).to_pylist():
                    again.append(seen.get(doc, 0))
                    seen[doc] = again[-1] + 1
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed.compress(x) for x in ids], pa.binary()), pa.array(again, pa.int32())], ["doc_id", "ids", "again"])

    def pack_group(key: tuple, rows: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        found = sorted(((doc is not None, doc or 0, unpack(x)) for doc, x in zip(rows["doc_id"].to_pylist(), rows["ids"].to_pylist(), strict=True)))
        width = 2 if narrow else 4
        out: list[tuple] = []
        for k, sequence in enumerate(pack_lengths([len(x) // width for *_, x in found], capacity)):
            offset = 0
            for d, start, n in sequence:
                known, doc, ids = found[d]
                part = np.frombuffer(ids, "<u2" if narrow else "<u4", n, start * width).astype("<u4").tobytes()
                out.append((doc if known else None, start, n, part, len(ids) // width, (key[0].as_py() << 32) + k, offset))
                offset += n
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    narrow = tokens.tokenizer(vocabulary_path).get_vocab_size(with_added_tokens=True) <= 1 << 16
    groups = max(1, -(-docs.count() // group))
    dealt = own_columns(docs, "doc_id", "text").mapInArrow(tokenise, "doc_id long, ids binary, again int")
    dealt = dealt.select("doc_id", "ids", F.pmod(F.xxhash64("doc_id", "ids", "again"), F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInArrow(pack_group, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
