"""WARC archives: written as one gzip stream per file, normalised to one member per record, read back by a sidecar index.

Of records with equal payloads of at least LEAST bytes one is a response, the others revisit it and hold no payload.
Equal payloads are found by their SHA-1 with a maximum per digest, combined before the shuffle; records then meet their
digest's response in an equi-join whose hot partitions adaptive execution splits, and each task writes what it has.

The normaliser inflates a file's stream once, in bounded steps, cuts it into records, writes each record as a gzip member
of its own and an index of offset, length, crc32, type and id. Files are named by task attempt; only those of attempts
that ended well are in the manifests.

Cases: a null or empty payload has no bytes and is a response; rows with the same page_id and payload as the response are
responses, too; a null page_id is smaller than any other; line ends in a URL become %0D and %0A; an empty table gives no
file; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleweave.llm.shared import file_system, new_path, own_columns, removed, written

LEAST = 1000
FILE_BYTES = 1 << 26  #: a file ends with the record that reaches so many bytes before compression
TASKS = 1 << 14  #: most tasks that read files
STEP = 1 << 20  #: bytes that are read, and at most four times as many inflated, at once
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BAD = "not a WARC record"


def name_of(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def id_of(name: str) -> int | None:
    found = name.strip("<>").removeprefix("urn:page:")
    return None if found == "none" else int(found)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit of refers_to with the HTTP head alone; its Content-Length is the full payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name_of(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name_of(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def heads(data: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in data.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ":" in x)}


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Of one record: the WARC head, the HTTP head and the payload."""
    first, _, rest = data.partition(b"\r\n\r\n")
    own = heads(first)
    block = rest[: int(own["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return own, heads(http), payload


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip stream, of one member or several, in steps of bounded size."""
    unpack = zlib.decompressobj(31)
    while data := source.read(STEP):
        while data:
            if unpack.eof:
                unpack = zlib.decompressobj(31)
            if out := unpack.decompress(data, 4 * STEP):
                yield out
            data = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
    if not unpack.eof:
        raise EOFError("the gzip stream ends early")


def records(source) -> Iterator[bytes]:
    """The records of a gzip stream. Memory holds one record and a step."""
    held = bytearray()
    steps = inflated(source)

    def more(n: int) -> bool:
        while len(held) < n:
            part = next(steps, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while more(1):
        at = -1
        while at < 0:
            at = held.find(b"\r\n\r\n")
            if at < 0 and not more(len(held) + 1):
                raise ValueError(BAD)
        if not held.startswith(b"WARC/"):
            raise ValueError(BAD)
        size = at + 4 + int(heads(bytes(held[:at]))["content-length"]) + 4
        if not more(size):
            raise ValueError(BAD)
        yield bytes(held[:size])
        del held[:size]


def with_types(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest, refers_to: the response's page_id for revisits, else null."""
    pages = own_columns(pages, "page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    groups = pages.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1 and response is not null")
    groups = written(groups.select(F.col("digest").alias("of"), "response"), "payloads")
    known = pages.join(groups, (F.col("digest") == F.col("of")) & (F.octet_length("html") >= least), "left")
    return known.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))).select("page_id", "url", "html", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Files of one gzip stream each; the manifest: path, n_records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, base = file_system(folder)
        fs.create_dir(base)
        out, done = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (batch.column(i)[at].as_py() for i in range(5))
                if out is None:
                    name = f"part-{context.partitionId():06d}-{len(done):05d}-{context.taskAttemptId()}.warc.gz"
                    out, pack, raw, n = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                data = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to)
                out.write(pack.compress(data))
                raw, n = raw + len(data), n + 1
                if raw >= FILE_BYTES:
                    out.write(pack.flush())
                    out.close()
                    done.append((f"{folder}/{name}", n))
                    out = None
        if out is not None:
            out.write(pack.flush())
            out.close()
            done.append((f"{folder}/{name}", n))
        yield manifest_batch(done)

    return written(pages.mapInArrow(run, "path string, n_records long"), "manifest")


def manifest_batch(done: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "n_records"])


def spread(manifest: DataFrame) -> DataFrame:
    """A file to a task, or several where there are more than TASKS."""
    return manifest.repartition(max(1, min(TASKS, manifest.count())))


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Every file's stream inflated once and rewritten, a gzip member per record, with its index beside it (.index, JSON lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, inner = file_system(path)
                name = f"{path.rsplit('/', 1)[1].removesuffix('.warc.gz')}-{attempt}.warc.gz"
                at, lines = 0, []
                with source.open_input_stream(inner, compression=None) as data, fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                    for one in records(data):
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = pack.compress(one) + pack.flush()
                        head = heads(one.partition(b"\r\n\r\n")[0])
                        lines.append(json.dumps([at, len(member), zlib.crc32(member), head["warc-type"], head["warc-record-id"]]))
                        out.write(member)
                        at += len(member)
                with fs.open_output_stream(f"{base}/{name}.index", compression=None) as out:
                    out.write("".join(f"{x}\n" for x in lines).encode())
                yield manifest_batch([(f"{folder}/{name}", len(lines))])

    return written(spread(manifest).mapInArrow(run, "path string, n_records long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record by its index entry: page_id, url, payload_bytes, payload_digest, record_type, refers_to. Checks members and payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = file_system(path)
                with fs.open_input_stream(f"{inner}.index", compression=None) as source:
                    index = [json.loads(x) for x in source.read().splitlines()]
                rows = []
                with fs.open_input_file(inner) as source:
                    for offset, size, crc, *_ in index:
                        source.seek(offset)
                        member = source.read(size)
                        if zlib.crc32(member) != crc:
                            raise ValueError(f"corrupt member at {offset} of {path}")
                        own, http, payload = parsed(zlib.decompress(member, 31))
                        digest = own["warc-payload-digest"].removeprefix("sha1:")
                        response = own["warc-type"] == "response"
                        if response and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"corrupt payload at {offset} of {path}")
                        rows.append((id_of(own["warc-record-id"]), own.get("warc-target-uri"), int(http["content-length"]), digest, own["warc-type"], None if response else id_of(own["warc-refers-to"])))
                        if len(rows) == 4096:
                            yield as_batch(rows)
                            rows = []
                yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, schema.types, strict=True)], schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return spread(manifest).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes pages as archives in the shared folder, normalises them and reads them back. The first archives are removed once their successors are listed."""
    first = new_path(spark, "warc")
    made = normalise(write_archives(with_types(pages, least), first), new_path(spark, "warc-members"))
    removed(spark, first)
    return read_archives(made)
