"""Raw binary and WAV files: readers over Spark's binary source (any store), writers of one file per stream and part.

Readers never list or open paths themselves, so whatever Spark can read works. A file is one task's work; split large
recordings into several files. Writers go through pyarrow file systems and name files by stream and part.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = 1 << 16
#: numpy's names of the sample formats; complex ones hold two numbers.
FORMATS = {"int8": "i1", "uint8": "u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "int64": "<i8", "float32": "<f4", "float64": "<f8"}


def inflated(data: bytes, most: int = 1 << 31) -> bytes:
    """gzip or zlib data, or what it is, up to a stated size."""
    if data[:2] != b"\x1f\x8b" and not (data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0):
        return data
    unpack = zlib.decompressobj(47)
    out = unpack.decompress(data, most)
    if unpack.unconsumed_tail:
        raise ValueError(f"more than {most} bytes when inflated")
    return out


def binary_source(spark: SparkSession, path: str, fmt: str = "float32", offset: int = 0, length: int = 0, compressed: bool = False, repeat: int = 1) -> DataFrame:
    """stream_id (the file's path), idx, value of raw little-endian files: length samples from offset on (0: all), so many times
    over. A path with a pattern (/data/run*) reads every file that it meets, each as a stream."""
    kind = FORMATS[fmt]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = inflated(data) if compressed else data
                width = np.dtype(kind).itemsize
                values = np.frombuffer(data, kind, len(data) // width)[offset : offset + length if length else None]
                for start, at in ((r * len(values), at) for r in range(repeat) for at in range(0, len(values), STEP)):
                    part = values[at : at + STEP].astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(start + at, start + at + len(part))), pa.array(part)], ["stream_id", "idx", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "stream_id string, idx long, value double")


def write_parts(samples: DataFrame, folder: str, encode, suffix: str, most: int) -> DataFrame:
    """One file per stream and part of at most `most` samples: path, n."""
    from pyarrow import fs

    kind = dict(samples.dtypes)["stream_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base)
        name = f"{pdf['stream_id'].iloc[0]}-{int(pdf['part'].iloc[0]):06d}{suffix}".replace("/", "_")
        with system.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(encode(pdf["value"].to_numpy(float)))
        return pd.DataFrame({"stream_id": [pdf["stream_id"].iloc[0]], "path": [f"{folder}/{name}"], "n": [len(pdf)]})

    part = F.expr(f"idx div {most}") if most else F.lit(0).cast("long")
    return samples.select("stream_id", "idx", "value", part.alias("part")).groupBy("stream_id", "part").applyInPandas(run, f"stream_id {kind}, path string, n long")


def binary_sink(samples: DataFrame, folder: str, fmt: str = "float32", most: int = 1 << 24, compress: bool = False) -> DataFrame:
    """Raw files with rotation after `most` samples."""
    kind = FORMATS[fmt]

    def encode(x: np.ndarray) -> bytes:
        data = x.astype(kind).tobytes()
        return gzip.compress(data, mtime=0) if compress else data

    return write_parts(samples, folder, encode, ".bin.gz" if compress else ".bin", most)


def wav_bytes(x: np.ndarray, sample_rate: int, pcm16: bool = False) -> bytes:
    data = (np.clip(np.round(x * 32767), -32768, 32767).astype("<i2") if pcm16 else x.astype("<f4")).tobytes()
    width = 2 if pcm16 else 4
    head = struct.pack("<HHIIHH", 1 if pcm16 else 3, 1, sample_rate, sample_rate * width, width, 8 * width)
    return b"RIFF" + struct.pack("<I", 20 + len(head) + len(data)) + b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data


def wav_values(data: bytes) -> tuple[int, int, np.ndarray]:
    """sample rate, channels and the samples (frames x channels, -1 to 1) of PCM with 8 to 32 bits or 32-bit floats."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", body)
            if fmt[0] == 0xFFFE and len(body) >= 26:
                fmt = (struct.unpack_from("<H", body, 24)[0], *fmt[1:])
        elif name == b"data":
            if fmt is None:
                raise ValueError("data before format in WAV file")
            code, channels, rate, _, _, bits = fmt
            if code == 3 and bits == 32:
                x = np.frombuffer(body, "<f4", len(body) // 4).astype(np.float64)
            elif code == 1 and bits == 8:
                x = (np.frombuffer(body, "u1").astype(np.float64) - 128) / 128
            elif code == 1 and bits == 24:
                raw = np.frombuffer(body, "u1", len(body) // 3 * 3).reshape(-1, 3).astype(np.int32)
                x = ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8) / float(1 << 23)
            elif code == 1 and bits in (16, 32):
                x = np.frombuffer(body, f"<i{bits // 8}", len(body) // (bits // 8)) / float(1 << (bits - 1))
            else:
                raise ValueError(f"WAV format {code} with {bits} bits is not supported")
            return rate, channels, x[: len(x) // channels * channels].reshape(-1, channels)
        at += 8 + size + size % 2
    raise ValueError("no data in WAV file")


def wav_source(spark: SparkSession, path: str) -> DataFrame:
    """stream_id (path#channel), idx, value, sample_rate, num_channels."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rate, channels, x = wav_values(data)
                for c in range(channels):
                    for at in range(0, len(x), STEP):
                        part = np.ascontiguousarray(x[at : at + STEP, c], np.float64)
                        n = len(part)
                        yield pa.RecordBatch.from_arrays([pa.array([f"{name}#{c}"] * n), pa.array(np.arange(at, at + n)), pa.array(part), pa.array([float(rate)] * n), pa.array([channels] * n, pa.int32())], ["stream_id", "idx", "value", "sample_rate", "num_channels"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "stream_id string, idx long, value double, sample_rate double, num_channels int")


def wav_sink(samples: DataFrame, folder: str, sample_rate: int = 48000, pcm16: bool = False, most: int = 1 << 24) -> DataFrame:
    return write_parts(samples, folder, lambda x: wav_bytes(x, sample_rate, pcm16), ".wav", most)
