"""Nested data sets, bulk expressions, uncertain filters, sink registry, listeners and monitors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleweave.operators import dataset, design, recursive
from sampleweave.operators.recursive import Recursion
from sampleweave.streaming import io


@pytest.fixture()
def rows(spark):
    draw = np.random.default_rng(0)
    return spark.createDataFrame([(d, i, i / 10, float(v)) for d in ("a", "b") for i, v in enumerate(draw.normal(size=50))], "ds string, idx long, x double, y double")


def test_nested(rows):
    sets = dataset.nested(rows)
    assert sorted(map(tuple, dataset.unnested(sets).collect())) == sorted(map(tuple, rows.collect()))
    b, a = design.iir_design("LOWPASS", 2, 0.1)
    v = {r["ds"]: np.array(r["values"]) for r in sets.collect()}
    for made, want in ((dataset.filtered(sets, b, a), lambda x: Recursion(b, a).run(x)[0]), (dataset.symmetric_filtered(sets, b, a), lambda x: (Recursion(b, a).run(x)[0] + Recursion(b, a).run(x[::-1])[0][::-1]) / 2)):
        for r in made.collect():
            assert r["values"] == pytest.approx(want(v[r["ds"]]))
    assert all(len(r["values"]) == 50 for r in dataset.savitzky_golay(sets).collect())
    noisy = dataset.with_noise(sets, 0.5, 3)
    assert noisy.collect() == dataset.with_noise(sets, 0.5, 3).collect()
    assert all(0.3 < np.abs(np.array(r["values"]) - v[r["ds"]]).max() <= 0.5 for r in noisy.collect())
    r = dataset.with_range(sets).filter("ds = 'a'").first()
    assert (r["range"]["min"], r["range"]["max"]) == (v["a"].min(), v["a"].max())


def test_bulk_and_uncertain(spark):
    s = spark.createDataFrame([("s", i, float(i)) for i in range(10)], "stream_id string, idx long, value double")
    got = [r["value"] for r in recursive.expression_bulk(s, "vecOut := a * vecIn + 1;", 4, 2.0).orderBy("idx").collect()]
    assert got == [2 * i + 1 for i in range(10)]
    u = s.select("stream_id", "idx", F.struct("value", F.lit(1.0).alias("uncertainty")).alias("value"))
    made = recursive.uncertain_iir(u, [0.5, 0.5], [1.0]).orderBy("idx").collect()
    assert made[5]["value"]["value"] == 4.5 and made[5]["value"]["uncertainty"] == pytest.approx(np.sqrt(0.5))


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([("s", i, float(i)) for i in range(10)], "stream_id string, idx long, value double")
    r = io.SinkRegistry()
    r.add("one", "voltage", s)
    with pytest.raises(ValueError):
        r.add("two", "voltage", s)
    assert r.find("voltage") is s and r.find("one") is s
    passed, seen = io.monitored(s)
    assert passed.count() == 10 and seen.get["n"] == 10 and seen.get["maximum"] == 9
    s.write.parquet(str(tmp_path / "in"))
    got = []
    monitor = io.PerformanceMonitor()
    spark.streams.addListener(monitor)
    q = io.listen(spark.readStream.schema(s.schema).parquet(str(tmp_path / "in")), lambda rows, n: got.extend(rows.collect()), str(tmp_path / "c"), once=True)
    q.awaitTermination(60)
    spark.streams.removeListener(monitor)
    assert len(got) == 10
    assert io.pps_source(spark).isStreaming
