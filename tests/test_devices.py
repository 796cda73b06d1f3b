"""Filters of uncertain values, drift, loopback devices, properties, plugins and late rows, against plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleweave.operators import design, recursive, timing
from sampleweave.plans.graph import BLOCKS, Graph
from sampleweave.plans.plugins import Loader
from sampleweave.sources import loopback
from sampleweave.streaming import stateful


def frame(spark, x):
    return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "stream_id string, idx long, value double")


def values(df, column="value"):
    return np.array([r[column] for r in df.orderBy("idx").collect()])


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_variances_pass_the_whole_response(spark, order):
    b, a = design.iir_design("LOWPASS", order, 0.05)
    response = recursive.Recursion(b, a).run(np.eye(1, 4000)[0])[0]
    rng = np.random.default_rng(order)
    u = rng.uniform(0, 2, 300)
    rows = spark.createDataFrame([("s", i, (0.0, float(x))) for i, x in enumerate(u)], "stream_id string, idx long, value struct<value:double,uncertainty:double>")
    made = recursive.uncertain_iir(rows, b, a).select("idx", F.col("value.uncertainty").alias("u"))
    want = np.sqrt(np.convolve(u**2, response**2)[:300])
    assert np.allclose(values(made, "u"), want, atol=1e-7)


def test_response_that_does_not_fade_is_an_error():
    with pytest.raises(ValueError, match="not stable"):
        recursive.whole_response([1.0], [1.0, -1.0])


@pytest.mark.parametrize("method", ["None", "Linear", "Cubic"])
@pytest.mark.parametrize("ppm", [20_000.0, -15_000.0, 0.0])
def test_drift_by_blocks_equals_one_pass(spark, method, ppm):
    x = np.random.default_rng(1).normal(size=3000)
    small = timing.blocked
    timing.blocked = lambda rows, before, after, compute: small(rows, before, after, compute, block=128)
    try:
        for n in (1, 2, 3, 4, 5, 3000):
            made = timing.drift_compensated(frame(spark, x[:n]), ppm, method)
            want = timing.resampled(x[:n], 1 + ppm * 1e-6, method)
            assert [r.idx for r in made.orderBy("idx").collect()] == list(range(len(want)))
            assert np.allclose(values(made), want, atol=1e-9), (n, method, ppm)
    finally:
        timing.blocked = small


def test_chunks_spread_anew_keep_their_ends(spark):
    x = np.arange(100.0)
    made = timing.adaptively_resampled(frame(spark, x), 95.0, 100.0, 25)
    out = values(made)
    assert [r.idx for r in made.orderBy("idx").collect()] == list(range(104))
    assert np.allclose(out[[0, 25, 26, 51, 103]], [0, 24, 25, 49, 99])
    assert np.all(np.diff(out.reshape(4, 26), axis=1) > 0)
    assert values(timing.adaptively_resampled(frame(spark, [5.0]), 95.0, 100.0)).tolist() == [5.0]
    assert values(timing.adaptively_resampled(frame(spark, x), 0.0, 100.0)).tolist() == x.tolist()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_chunks_spread_anew_equal_sql_to_the_last_digit(spark, sf):
    import duckdb

    from sampleweave.plans import registry

    made = {(r.stream_id, r.idx): r.value for r in registry.QUERIES["drift_adaptive"](spark, f"/root/testdata/{sf}").collect()}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('/root/testdata/{sf}/events.parquet')")
        want = {(s, i): v for s, i, v in con.execute(registry.ORACLES["drift_adaptive"]).fetchall()}
    assert made == want


@pytest.mark.parametrize("method", ["Linear", "Cubic"])
def test_splices(spark, method):
    x = np.arange(64.0)
    more = timing.spliced(frame(spark, x), 104.0, 100.0, 16, method)
    assert [r.idx for r in more.orderBy("idx").collect()] == list(range(66))
    out = values(more)
    assert out[31] == 31 and 30 < out[32] < 31 and out[33] == 32  # 0.64 after a chunk, 1.28 after two
    less = values(timing.spliced(frame(spark, x), 96.0, 100.0, 16, method))
    assert len(less) == 62 and less[30] == 30.5 and less[31] == 32
    assert values(timing.spliced(frame(spark, x), 96.0, 100.0, 16, "None")).tolist() == x.tolist()


def test_loopback(spark):
    sent = frame(spark, range(1, 7)).withColumn("value", F.struct(F.col("value").alias("re"), F.lit(0.0).alias("im")))
    radio = loopback.device("loopback#7", channels=2)
    assert loopback.device("loopback#7") is radio
    radio.model(0, loopback.delay(9))
    got = radio.received(0, sent).select("idx", F.col("value.re").alias("re"))
    assert values(got, "re").tolist() == [0.0] * 6  # the whole of it is still on its way
    assert values(radio.received(1, sent).select("idx", "value.re"), "re").tolist() == [1, 2, 3, 4, 5, 6]
    assert loopback.Loopback(1, "TxOnly").received(0, sent).count() == 0
    noisy = loopback.awgn(-20.0)(sent.withColumn("value", F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))))
    assert noisy.exceptAll(loopback.awgn(-20.0)(sent.withColumn("value", F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))))).count() == 0
    with pytest.raises(ValueError):
        radio.model(2, loopback.passthrough())
    half = sent.select(loopback.from_format(loopback.to_format(F.struct(F.lit(0.5).alias("re"), F.lit(-2.0).alias("im")), "CS16"), "CS16").alias("v")).first().v
    assert abs(half.re - 0.5) < 1e-4 and half.im < -1


def test_properties_of_a_block(spark):
    g = Graph()
    b = g.add("MultiplyConst", "m", value=2.0)
    ask = lambda name, action="Get", **data: g.message("Property", name="m", property=name, action=action, data=data)
    assert ask("Echo", x=1) == {"name": "m", "x": 1}
    assert ask("Heartbeat")["state"] == "IDLE"
    ask("StagedSettings", "Set", value=5.0)
    assert b.settings == {"value": 2.0} and ask("StagedSettings") == {"value": 5.0}
    g.export("in", b, "in")
    assert values(g.run(spark, "m", **{"in": frame(spark, [1.0])})).tolist() == [5.0]  # staged settings take effect when the block is compiled
    ask("SettingsCtx", "Set", context="low", settings={"value": 1.0})
    assert ask("SettingsContexts") == ["low"]
    assert ask("ActiveContext", "Set", context="low") == "low" and b.settings["value"] == 1.0
    ask("ResetDefaults", "Set")
    assert b.settings == {"value": 2.0}
    assert ask("UiConstraints", "Set", x=3) == {"x": 3}
    assert ask("Heartbeat", "Subscribe", client="c") == ["c"] and ask("Heartbeat", "Unsubscribe", client="c") == []
    with pytest.raises(ValueError):
        ask("Nothing")
    assert g.message("SchedulerInspect")["states"] == {"m": "IDLE"}


def test_plugins(tmp_path):
    (tmp_path / "a_good.py").write_text("from sampleweave.plans.graph import plain\nPLUGIN = {'name': 'good'}\nplain('Twice', lambda s: s)\n")
    (tmp_path / "b_bad.py").write_text("from sampleweave.plans.graph import plain\nplain('Half', lambda s: s)\nraise RuntimeError('no')\n")
    (tmp_path / "c_taken.py").write_text("from sampleweave.plans.graph import plain\nplain('Copy', lambda s: None)\n")
    copy, loader = BLOCKS["Copy"], Loader()
    assert [p.about["name"] for p in loader.load_folder(str(tmp_path))] == ["good"]
    assert "Twice" in BLOCKS and "Half" not in BLOCKS and BLOCKS["Copy"] is copy
    assert len(loader.failed) == 2 and any("RuntimeError: no" in x for x in loader.failed.values())
    loader.unload(str(tmp_path / "a_good.py"))
    assert "Twice" not in BLOCKS


def test_late_rows(spark, tmp_path):
    for k, rows in enumerate([[(0, 1.0), (2, 3.0)], [(1, 2.0), (3, 4.0), (3, 4.0)]]):
        spark.createDataFrame([("s", i, v) for i, v in rows], "stream_id string, idx long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k}"))
    source = spark.readStream.schema("stream_id string, idx long, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = stateful.late_rows(source).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.idx for r in spark.table("late").collect()) == [1, 3]
