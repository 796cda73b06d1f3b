"""HTTP: a Python data source of chunks by GET, and a sink by POST, behind Spark's data-source interface. Needs a network only when it runs."""

from __future__ import annotations

import urllib.request
import zlib

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class HttpSource(DataSource):
    """Options: url (several separated by spaces, a partition each), chunk_bytes (0: whole), timeout."""

    @classmethod
    def name(cls) -> str:
        return "sampleweave_http"

    def schema(self) -> str:
        return "url string, chunk long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(self.options)


class HttpReader(DataSourceReader):
    def __init__(self, options):
        self.urls = options["url"].split()
        self.chunk = int(options.get("chunk_bytes", 0))
        self.timeout = float(options.get("timeout", 30))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition):
        with urllib.request.urlopen(partition.value, timeout=self.timeout) as answer:
            unpack = zlib.decompressobj(47) if answer.headers.get("Content-Encoding") in ("gzip", "deflate") else None
            n = 0
            while data := answer.read(self.chunk or -1):
                yield partition.value, n, unpack.decompress(data) if unpack else data
                n += 1


def http_sink(frame, url: str, column: str = "data", content_type: str = "application/octet-stream", timeout: float = 30.0) -> None:
    """Posts every row's bytes, a task's rows in order."""

    def post(rows) -> None:
        for row in rows:
            request = urllib.request.Request(url, bytes(row[column]), {"Content-Type": content_type}, method="POST")
            urllib.request.urlopen(request, timeout=timeout).close()

    frame.select(column).foreachPartition(post)
