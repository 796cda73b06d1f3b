"""Streams against the batch operators: the same rows, however micro-batches cut them."""

import pytest
from pyspark.sql import functions as F

from sampleweave.operators import recursive, trigger
from sampleweave.streaming import stateful


@pytest.fixture()
def table(spark, tmp_path):
    rows = [(s, i, float((i * 37 + s * 11) % 101), ["", "start", "", "stop", "x"][(i * 7 + s) % 5], "") for s in range(3) for i in range(200)]
    frame = spark.createDataFrame(rows, "stream_id long, idx long, value double, name string, context string").withColumn("ts", F.timestamp_seconds(F.col("idx")))
    for k in range(4):
        frame.filter(f"idx div 50 = {k}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    return frame, str(tmp_path)


def streamed(spark, table, make, name):
    frame, path = table
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    q = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/c_{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_filters(spark, table):
    frame, _ = table
    got = streamed(spark, table, lambda s: stateful.iir(s, [0.3, 0.1], [1.0, -0.5]), "iir_out")
    want = sorted(tuple(r) for r in recursive.iir(frame, [0.3, 0.1], [1.0, -0.5]).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_schmitt(spark, table):
    frame, _ = table
    got = streamed(spark, table, lambda s: stateful.schmitt(s, 50.0, 20.0), "schmitt_out")
    assert got == sorted((r["stream_id"], r["idx"], r["edge"]) for r in recursive.schmitt(frame, 50.0, 20.0).collect())


def test_stream_filter(spark, table):
    frame, _ = table
    got = streamed(spark, table, lambda s: stateful.stream_filter(s, "[start, stop]", 1, 1), "filter_out")
    tags = frame.filter("name <> ''").select("stream_id", "idx", "name", "context", F.lit(0).alias("seq"))
    want = trigger.stream_filter(frame, tags, "[start, stop]", 1, 1).select("stream_id", "idx", "value")
    assert got == sorted(tuple(r) for r in want.collect())


def test_gaps_and_windows(spark, table):
    got = streamed(spark, table, lambda s: stateful.dropped(s.filter("idx % 10 <> 3")), "gap_out")
    assert got == sorted((s, i, 1) for s in range(3) for i in range(4, 200, 10))
    made = streamed(spark, table, lambda s: stateful.chunk_statistics(s, "20 seconds", "5 seconds"), "chunk_out")
    assert made and all(r[2] == 20 for r in made)
