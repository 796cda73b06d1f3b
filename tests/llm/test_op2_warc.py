"""WARC: records, streams of several members, the normaliser and its index, and the query against its definition."""

import gzip
import hashlib
import io
import json

import pyarrow.fs
import pytest

from sampleweave.llm import shared, warc


def test_streams():
    made = [warc.record(i, f"http://x/\n{i}", b"p" * i * 1000 + b"WARC/1.1\r\n\r\n", "d", None if i % 3 else 7) for i in range(50)]
    for data in (gzip.compress(b"".join(made)), b"".join(map(gzip.compress, made))):
        assert list(warc.records(io.BytesIO(data))) == made
        with pytest.raises((EOFError, ValueError)):
            list(warc.records(io.BytesIO(data[:-30])))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(b"nothing of the kind\r\n\r\n"))))
    head, http, payload = warc.parsed(made[4])
    assert (head["warc-target-uri"], http["content-length"], payload) == ("http://x/%0A4", str(4000 + 12), b"p" * 4000 + b"WARC/1.1\r\n\r\n")
    assert warc.id_of(warc.name_of(None)) is None and warc.id_of(warc.name_of(-3)) == -3


def brute(rows):
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, *_ in rows if (h or "") == (html or "") and p is not None]
        revisit = len(data) >= 1000 and same and max(same) != page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=str)


def test_query(spark, tmp_path, monkeypatch):
    from sampleweave.llm.queries import op2_warc

    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    big, edge = "é" * 800, "a" * 1000
    rows = [(i, f"http://h/{i}", [big, edge, "a" * 999, f"<p>{i}</p>" * 200, "", None][i % 6], "x") for i in range(90)] + [(None, None, big, "x"), (7, "again", edge, "x"), (500, "http://\r\nh", "z" * 3_000_000, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted((tuple(r)[:5] for r in op2_warc(spark, str(tmp_path)).collect()), key=str) == brute(rows)
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_index_finds_members(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"page {i} " * 300) for i in range(20)], "page_id long, url string, html string").coalesce(2)
    made = warc.normalise(warc.write_archives(warc.with_types(pages), shared.new_path(spark, "t")), shared.new_path(spark, "t"))
    fs = pyarrow.fs.LocalFileSystem()
    for row in made.collect():
        path = row["path"].removeprefix("file://")
        data = fs.open_input_file(path).read()
        index = [json.loads(x) for x in fs.open_input_file(path + ".index").read().splitlines()]
        assert len(index) == row["n_records"] and sum(x[1] for x in index) == len(data)
        for offset, size, _, kind, name in index:
            own, _, payload = warc.parsed(gzip.decompress(data[offset : offset + size]))
            assert own["warc-record-id"] == name and kind == "response" and payload == f"page {warc.id_of(name)} ".encode() * 300
