"""Token-id files: a static range asymmetric numeral system over interleaved lanes, in independent blocks.

One frequency table, counted over all ids, is shared by all files. A file holds whole documents in ascending order of
doc_id; their ids form one run that is cut into blocks of BLOCK ids. A block is coded by itself in up to LANES lanes (one
for each LANE ids), id i in lane i mod lanes, so that one numpy step codes an id of every lane. Every CHECKPOINT steps a
part begins: the block keeps the lanes' states, the place in the words and the checksum of the part's ids. Files are
decoded in parallel by these checkpoints: a task gets the documents that begin in UNIT ids and reads no words before them.

    file    magic, blocks, index, tail
    block   ids u4, lanes u4, words u4, parts u4, crc32 of the parts u4; for each part the words before it u8, the
            crc32 of its ids u4, zero u4, the lanes' states u8 x lanes; words u4
    index   (zlib) documents u8, blocks u8, doc_ids i8, null marks u1, lengths u8, block offsets u8, first ids u8
    tail    offset of the index u8, its crc32 u4, magic

Cases: a null or empty text has no ids but the end id; a null doc_id comes first; equal doc_ids lie side by side,
ordered by a hash of their ids; an empty table gives no file; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sampleweave.llm import tokens
from sampleweave.llm.shared import at_work, discard, file_system, new_path, own_columns, written

MAGIC = b"SWRANS01"
SCALE = 20  #: bits of the sum of all frequencies: no vocabulary may have more ids than 2**SCALE
LOW = 1 << 31  #: least state; the states' words are 32 bits
BLOCK = 1 << 20
LANES = 4096
LANE = 128  #: ids for which a small block gets a lane
CHECKPOINT = 64
PART_IDS = LANES * CHECKPOINT  #: ids of a part of a whole block
UNIT = 8 * PART_IDS  #: ids whose documents a task reads
FILE_IDS = 1 << 24  #: a file ends with the document that reaches so many ids
FILE_DOCS = 1 << 18  #: or that is the last of so many
TASKS = 1 << 14  #: most tasks that read files
HEAD = struct.Struct("<5I")
PART = struct.Struct("<QII")
TAIL = struct.Struct("<QI8s")
CORRUPT = "corrupt block or index"


class Table:
    """The shared frequencies: for each id its share of 2**SCALE (at least 1 if it occurs) and the sum of those before it."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self._of_slot: np.ndarray | None = None

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Quantises counts; what rounding leaves over goes to (or comes from) the most frequent ids."""
        total, size = int(counts.sum()), 1 << SCALE
        if not total:
            return cls(np.zeros_like(counts))
        if (counts > 0).sum() > size:
            raise ValueError(f"more than {size} different ids")
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts / total * size)), 0).astype(np.int64)
        left = size - int(freq.sum())
        for i in np.argsort(-freq, kind="stable"):
            if not left:
                break
            take = left if left > 0 else max(left, 1 - int(freq[i]))
            freq[i] += take
            left -= take
        return cls(freq)

    @property
    def of_slot(self) -> np.ndarray:
        if self._of_slot is None:
            self._of_slot = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._of_slot


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """One block. The coder runs from the last id to the first, so that the decoder runs forward."""
    n, lanes = len(ids), max(1, min(LANES, len(ids) // LANE))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    shift, half, mask = np.uint64(63 - SCALE), np.uint64(32), np.uint64(0xFFFFFFFF)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, np.ndarray]] = []
    count = 0
    for step in range(steps - 1, -1, -1):
        part = ids[step * lanes : (step + 1) * lanes]
        f, c, state = table.freq[part], table.start[part], x[: len(part)]
        over = state >= f << shift
        if over.any():
            words.append((state[over] & mask).astype("<u4"))
            count += len(words[-1])
            state = np.where(over, state >> half, state)
        whole = state // f
        x[: len(part)] = (whole << np.uint64(SCALE)) + (state - whole * f) + c
        if step % CHECKPOINT == 0:
            marks.append((count, zlib.crc32(ids[step * lanes : (step + CHECKPOINT) * lanes].astype("<u4").tobytes()), x.astype("<u8")))
    parts = b"".join(PART.pack(count - at, crc, 0) + states.tobytes() for at, crc, states in reversed(marks))
    data = np.concatenate(words[::-1]).tobytes() if words else b""
    return HEAD.pack(n, lanes, count, len(marks), zlib.crc32(parts)) + parts + data


def decoded(source, offset: int, table: Table, first: int = 0, last: int | None = None) -> Iterator[np.ndarray]:
    """The ids of a block, part by part, from part first to before part last. Reads only those parts' words; checks the ids, the words' number and the states that the next part begins with."""
    source.seek(offset)
    n, lanes, n_words, count, crc = HEAD.unpack(source.read(HEAD.size))
    size = PART.size + 8 * lanes
    parts = source.read(count * size)
    if zlib.crc32(parts) != crc or len(parts) != count * size:
        raise ValueError(CORRUPT)
    begins = [PART.unpack_from(parts, p * size)[:2] for p in range(count)] + [(n_words, 0)]
    scale, half, mask, of_slot = np.uint64(SCALE), np.uint64(32), np.uint64((1 << SCALE) - 1), table.of_slot
    for p in range(first, count if last is None else min(last, count)):
        source.seek(offset + HEAD.size + len(parts) + 4 * begins[p][0])
        words = np.frombuffer(source.read(4 * (begins[p + 1][0] - begins[p][0])), "<u4")
        x = np.frombuffer(parts, "<u8", lanes, p * size + PART.size).astype(np.uint64)
        begin, end, w = p * CHECKPOINT * lanes, min(n, (p + 1) * CHECKPOINT * lanes), 0
        out = np.empty(end - begin, np.uint32)
        try:
            for i in range(begin, end, lanes):
                state = x[: min(lanes, end - i)]
                slot = state & mask
                part = of_slot[slot]
                state = table.freq[part] * (state >> scale) + slot - table.start[part]
                under = np.flatnonzero(state < LOW)
                if len(under):
                    state[under] = (state[under] << half) | words[w : w + len(under)]
                    w += len(under)
                x[: len(state)] = state
                out[i - begin : i - begin + len(part)] = part
        except (ValueError, IndexError) as error:  # damaged words lead past their end
            raise ValueError(CORRUPT) from error
        then = np.frombuffer(parts, "<u8", lanes, (p + 1) * size + PART.size) if p + 1 < count else np.full(lanes, LOW, np.uint64)
        if zlib.crc32(out.astype("<u4").tobytes()) != begins[p][1] or w != len(words) or (x != then).any():
            raise ValueError(CORRUPT)
        yield out


class Writer:
    """One file, written as documents come; memory holds a block and the index of documents."""

    def __init__(self, out, table: Table):
        self.out, self.table, self.at = out, table, 0
        self.pending: list[np.ndarray] = []
        self.held = self.total = 0
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.offsets: list[int] = []
        self.firsts: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self.firsts.append(self.total)
        self.total += len(ids)
        self._put(encode_block(ids, self.table))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            run = np.concatenate(self.pending)
            whole = len(run) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(run[i : i + BLOCK])
            self.pending, self.held = [run[whole:]], len(run) - whole

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.pending))
        index = struct.pack("<QQ", len(self.docs), len(self.offsets)) + np.array([x or 0 for x in self.docs], "<i8").tobytes() + np.array([x is None for x in self.docs], "u1").tobytes()
        index = zlib.compress(index + b"".join(np.array(x, "<u8").tobytes() for x in (self.lengths, self.offsets, self.firsts)))
        where = self.at
        self._put(index)
        self._put(TAIL.pack(where, zlib.crc32(index), MAGIC))


def read_index(source) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Of a file: its documents, their lengths and the offsets of its blocks."""
    source.seek(source.size() - TAIL.size)
    tail = source.read(TAIL.size)
    where, crc, magic = TAIL.unpack(tail)
    source.seek(where)
    index = source.read(source.size() - TAIL.size - where)
    if magic != MAGIC or zlib.crc32(index) != crc:
        raise ValueError(CORRUPT)
    index = zlib.decompress(index)
    n, blocks = struct.unpack_from("<QQ", index)
    docs, null = np.frombuffer(index, "<i8", n, 16), np.frombuffer(index, "u1", n, 16 + 8 * n)
    lengths, offsets, _ = (np.frombuffer(index, "<u8", m, 16 + 9 * n + 8 * k) for m, k in ((n, 0), (blocks, n), (blocks, n + blocks)))
    return [None if z else int(d) for d, z in zip(docs, null, strict=True)], lengths, offsets


def read_documents(source, table: Table, unit: int | None = None) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
    """The documents of a file in order, or of those the ones that begin in the unit-th UNIT ids: doc_id, place of the first
    id in the file, and the runs of ids that its parts hold. One part is decoded at a time."""
    docs, lengths, offsets = read_index(source)
    ends = np.cumsum(lengths.astype(np.int64))
    starts = ends - lengths.astype(np.int64)
    low, high = (0, len(docs)) if unit is None else np.searchsorted(starts, [unit * UNIT, (unit + 1) * UNIT])
    at = 0 if unit is None else unit * UNIT
    held = np.empty(0, np.uint32)

    def parts() -> Iterator[np.ndarray]:
        block, part = divmod(at, BLOCK)
        for offset in offsets[block:].tolist():
            yield from decoded(source, offset, table, part // PART_IDS)
            part = 0

    coming = parts()

    def runs(left: int) -> Iterator[np.ndarray]:
        nonlocal held
        while left:
            if not len(held):
                held = next(coming)
            some, held = held[:left], held[left:]
            left -= len(some)
            yield some

    if low < high:
        for _ in runs(int(starts[low]) - at):  # what a document before it holds of this unit
            pass
    for k in range(low, high):
        yield docs[k], int(starts[k]), runs(int(lengths[k]))


def tokenised(docs: DataFrame, vocabulary_path: str, end_id: int) -> DataFrame:
    """Every document's ids with the end id, zstd over little-endian 32-bit ids' low halves (whole ids where a vocabulary needs them): a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("library words", tokens.library_words.cache_clear)
        text, packed = tokens.library_words(vocabulary_path), zstandard.ZstdCompressor(level=1)
        end = tokens.id_bytes([end_id])
        for whole in batches:
            texts = whole.column(1).to_pylist()
            for at, stop in tokens.runs_of(texts):
                batch = whole.slice(at, stop - at)
                ids = [np.frombuffer(x + end, "<u4") for x in text.many(texts[at:stop])]
                small = [packed.compress(x.astype("<u2" if wide == 2 else "<u4").tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(small, pa.binary())], ["doc_id", "n_tokens", "ids"])

    wide = id_width(vocabulary_path)
    made = own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")
    return written(made.withColumn("row", F.monotonically_increasing_id()), "ids")  # written, so a row keeps its number


def id_width(vocabulary_path: str) -> int:
    return 2 if tokens.tokenizer(vocabulary_path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def unpacked(ids: bytes, wide: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), "<u2" if wide == 2 else "<u4").astype(np.uint32)


def counted(ids: DataFrame, wide: int) -> Table:
    """The frequency table of all ids. Each task sends a row for each different id; the driver gets one row for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("rans")
        total = np.zeros(1 << 16, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = np.bincount(np.concatenate([unpacked(x, wide) for x in whole.column(0).slice(at, 512).to_pylist()]))
                if len(part) > len(total):
                    total = np.concatenate([total, np.zeros(len(part) - len(total), np.int64)])
                total[: len(part)] += part
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max([0, *(r["id"] for r in rows)]), np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return Table.of_counts(counts)


def write_files(ids: DataFrame, table: Table, folder: str, wide: int) -> DataFrame:
    """Files of all documents, in ascending order of doc_id over all files; the manifest, one row per file: part, seq, path, n_docs, n_tokens.

    A file's name holds its task attempt, and only files of attempts that ended well are in the manifest.
    """
    freq = table.freq

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, base = file_system(folder)
        fs.create_dir(base)
        own, seq, writer, done = Table(freq), 0, None, []

        def close() -> None:
            writer.close()
            writer.out.close()
            done.append((context.partitionId(), seq, f"{folder}/{name}", len(writer.docs), writer.total))

        for batch in batches:
            for doc, packed in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                if writer is None:
                    name = f"part-{context.partitionId():06d}-{seq:05d}-{context.taskAttemptId()}.rans"
                    writer = Writer(fs.open_output_stream(f"{base}/{name}"), own)
                writer.add(doc, unpacked(packed, wide))
                if writer.total + writer.held >= FILE_IDS or len(writer.docs) >= FILE_DOCS:
                    close()
                    seq, writer = seq + 1, None
        if writer is not None:
            close()
        yield as_batch(done, schema)

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    # rows that share a doc_id, or have none, can be cut apart by the hash of their ids and by their number
    ordered = ids.select("doc_id", "ids", F.xxhash64("ids").alias("hash"), "row").repartitionByRange(F.asc_nulls_first("doc_id"), "hash", "row")
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), "hash", "row").select("doc_id", "ids")
    return written(ordered.mapInArrow(run, "part int, seq int, path string, n_docs long, n_tokens long"), "manifest")


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)


def read_files(manifest: DataFrame, table: Table) -> DataFrame:
    """Reads files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. A file's checkpoints deal it to tasks: a row (path, unit) is decoded by itself.

    The running sum over the manifest is the only step in one task; it has a row for each file, not for each document.
    """
    freq = table.freq

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Table(freq)
        for batch in batches:
            for path, start, unit in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, name = file_system(path)
                rows: list[tuple] = []
                with fs.open_input_file(name) as source:
                    for doc, at, runs in read_documents(source, own, unit):
                        n = crc = 0
                        for part in runs:
                            n, crc = n + len(part), zlib.crc32(part.astype("<u4").tobytes(), crc)
                        rows.append((doc, start + at, n, crc))
                        if len(rows) == 4096:
                            yield as_batch(rows, schema)
                            rows = []
                yield as_batch(rows, schema)

    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    units = written(files.select("path", "start", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n_tokens - 1) div {UNIT} as int)"))).alias("unit")), "units")
    return units.repartition(max(1, min(TASKS, units.count()))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, vocabulary_path: str, end_id: int) -> DataFrame:
    """Tokenises documents, writes them in this format to the shared folder and reads the files back."""
    wide = id_width(vocabulary_path)
    ids = tokenised(docs, vocabulary_path, end_id)
    table = counted(ids, wide)
    manifest = write_files(ids, table, new_path(spark, "token-files"), wide)
    discard(ids)
    return read_files(manifest, table)
