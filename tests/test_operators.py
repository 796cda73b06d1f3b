"""Operators against fixtures of known results and against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleweave import model
from sampleweave.functions import cplx, expressions, nmea, scalars, tags, uncertain, windows
from sampleweave.operators import align, design, elementwise, estimators, frequency, power, recursive, select, spectral, timing, trigger, window
from sampleweave.sources import files, generators


def stream(spark, values, name="s"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "stream_id string, idx long, value double")


def values(df, *columns):
    rows = df.orderBy("idx").collect()
    return [r["value"] for r in rows] if not columns else [tuple(r[c] for c in columns) for r in rows]


def test_folds(spark):
    a = [stream(spark, v) for v in ([12, 35, 18, 17], [31, 15, 27, 36], [83, 46, 37, 41])]
    assert values(elementwise.fold(a, "add")) == [126, 96, 82, 94]
    d = [stream(spark, v) for v in ([0, 10, 40, 80], [1, 2, 4, 20], [1, 5, 5, 2, 9])]
    assert values(elementwise.fold(d, "divide")) == [0, 1, 2, 2]


@pytest.mark.parametrize("size, every, want", [(5, 3, [0, 1, 2, 3, 4, 3, 4, 5, 6, 7, 6, 7, 8, 9, 10, 9, 10, 11, 12, 13]), (3, 5, [0, 1, 2, 5, 6, 7, 10, 11, 12])])
def test_strides(spark, size, every, want):
    rows = window.strided(stream(spark, range(15)), size, every).orderBy("win", "pos").collect()
    assert [r["value"] for r in rows] == want


@pytest.mark.parametrize("size, every, n", [(50, 100, 10), (50, 133, 8), (100, 50, 19), (100, 33, 28), (48, 50, 20)])
def test_stride_counts(spark, size, every, n):
    made = window.chunk_aggregate(stream(spark, range(1000)), size, {"n": F.count("*")}, every)
    assert sorted(r["n"] for r in made.collect()) == [size] * n


def fixture_tags(spark):
    rows = [(2, "CMD_NONE", ""), *((i, "CMD_DIAG_TRIGGER1", "") for i in (4, 8, 12, 22)), *((i, "CMD_BP_START", "SELECT.C=1:S=1:P=1") for i in (5, 15)), *((i, "CMD_BP_START", "SELECT.C=1:S=1:P=2") for i in (10, 20))]
    return spark.createDataFrame([("s", i, n, c, 0) for i, n, c in rows], "stream_id string, idx long, name string, context string, seq int")


@pytest.mark.parametrize("rule, pre, post, want", [
    ("[CMD_BP_START/SELECT.C=1:S=1:P=1, CMD_BP_START/SELECT.C=1:S=1:P=2]", 0, 0, [*range(5, 10), *range(15, 20)]),
    ("[CMD_BP_START/SELECT.C=1:S=1:P=1, CMD_BP_START/SELECT.C=1:S=1:P=2]", 2, 2, [*range(3, 12), *range(13, 22)]),
    ("CMD_DIAG_TRIGGER1", 2, 2, [*range(2, 14), *range(20, 24)]),
])
def test_ranges(spark, rule, pre, post, want):
    got = trigger.stream_filter(stream(spark, range(50)), fixture_tags(spark), rule, pre, post)
    assert values(got) == want


def test_filter_grammar():
    assert trigger.parsed("[a/x, b/^y]").stop == trigger.Side("b", "y", True)
    assert trigger.parsed("a").single and trigger.parsed("[a, a]").single and not trigger.parsed("[a, b]").single
    for bad in ("[a", "a]", "[a/b/c]", "a,b,c"):
        with pytest.raises(ValueError):
            trigger.parsed(bad)
    after = trigger.parsed("[^a, b]")
    assert list(trigger.verdicts(after, [(1, "a", ""), (2, "a", ""), (3, "c", ""), (4, "b", "")])) == [(3, "start"), (4, "stop")]
    assert trigger.ranges(trigger.parsed("[a, b]"), [(1, "a", ""), (3, "a", ""), (5, "b", ""), (7, "b", "")], 0, 0, True) == [(1, 1, 5), (3, 3, 7)]


def test_datasets(spark):
    made = trigger.stream_to_dataset(stream(spark, range(50)), fixture_tags(spark), "CMD_DIAG_TRIGGER1", 2, 3, sample_rate=1000.0).orderBy("trigger").collect()
    assert [r["values"] for r in made] == [[float(v) for v in range(t - 2, t + 3)] for t in (4, 8, 12, 22)]
    assert made[0]["axis"] == pytest.approx([-0.002, -0.001, 0, 0.001, 0.002])


def test_sync_block(spark):
    ports = [([1, 0, 1, 2, 3, 0, 1, 2, 3, 4, 0, 1], [(1, 99), (5, 201), (10, 301)]), ([1, 2, 0, 1, 2, 3, 4, 0, 1, 2, 3, 0, 1, 2], [(2, 100), (7, 199), (11, 299)]), ([1, 2, 3, 0, 1, 2, 3, 4, 5, 0, 1, 2, 0, 1, 2, 3], [(3, 101), (9, 200), (12, 300)])]
    rows = spark.createDataFrame([("s", p, i, float(v)) for p, (vs, _) in enumerate(ports) for i, v in enumerate(vs)], "stream_id string, port int, idx long, value double")
    marks = spark.createDataFrame([("s", p, i, "sync", t) for p, (_, ts) in enumerate(ports) for i, t in ts], "stream_id string, port int, idx long, name string, time long")
    aligned, drops = align.sync_block(rows, marks, 3, 2)
    got = aligned.collect()
    want = {0: [1, 0, 1, 2, 3, 0, 1, 2, 0, 1], 1: [2, 0, 1, 2, 3, 0, 1, 2, 0, 1], 2: [3, 0, 1, 2, 3, 0, 1, 2, 0, 1]}
    assert {p: [r["value"] for r in sorted(got, key=lambda r: r["idx"]) if r["port"] == p] for p in want} == want
    assert sorted((r["port"], r["idx"], r["n_dropped_samples"]) for r in drops.collect()) == [(0, 8, 2), (1, 0, 1), (1, 5, 1), (1, 8, 1), (2, 0, 2), (2, 5, 2)]


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_blocks_change_nothing(spark, block):
    x = np.random.default_rng(1).normal(size=300)
    s = stream(spark, x)
    assert values(window.fir(s, [0.5, 0.25, 0.125, 1.0], block)) == pytest.approx(np.convolve(x, [0.5, 0.25, 0.125, 1.0])[:300])
    taps = np.linspace(0.1, 1, 20)
    assert values(window.fir(s, taps.tolist(), block)) == pytest.approx(np.convolve(x, taps)[:300])
    assert values(window.moving(s, "mean", 5, block)) == pytest.approx([x[max(0, i - 2) : i + 3].mean() for i in range(300)])
    assert values(window.moving(s, "rms", 4, block)) == pytest.approx([x[max(0, i - 2) : i + 3].std() for i in range(300)], abs=1e-9)
    assert values(window.derivative(s, block)) == pytest.approx(np.diff(x))
    b, a = design.iir_design("LOWPASS", 3, 0.1)
    want, y = [], np.zeros(300)
    for n in range(300):
        y[n] = sum(b[k] * x[n - k] for k in range(4) if n >= k) - sum(a[k] * y[n - k] for k in range(1, 4) if n >= k)
        want.append(y[n])
    assert values(recursive.iir(s, b, a, block)) == pytest.approx(want)
    assert values(model.running_sum(s, F.col("value"), "value", block)) == pytest.approx(np.cumsum(x))


@pytest.mark.parametrize("method", ["BUTTERWORTH", "CHEBYSHEV1", "CHEBYSHEV2", "BESSEL"])
@pytest.mark.parametrize("response, inside, outside", [("LOWPASS", 10, 400), ("HIGHPASS", 400, 10), ("BANDPASS", 141, 5), ("BANDSTOP", 5, 141)])
def test_iir_designs(method, response, inside, outside):
    c = design.iir_design(response, 4, 100, 200, 1000, method)
    assert abs(design.response_at(c, inside, 1000)) > 0.9 or method == "BESSEL"
    assert abs(design.response_at(c, outside, 1000)) < 0.3
    assert np.abs(np.roots(c[1])).max() < 1


def test_designs_and_responses(spark):
    c = design.iir_design("LOWPASS", 2, 100, 200, 1000)
    assert abs(design.response_at(c, 100, 1000)) == pytest.approx(math.sqrt(0.5), abs=1e-9)
    f = spark.createDataFrame([(0.0,), (50.0,), (200.0,)], "f double").select("f", *(v.alias(k) for k, v in design.response_columns(c, F.col("f"), 1000.0).items())).collect()
    assert [r["magnitude"] for r in f] == pytest.approx([abs(design.response_at(c, r["f"], 1000)) for r in f])
    for response in ("LOWPASS", "HIGHPASS", "BANDPASS", "BANDSTOP"):
        h = design.fir_design(response, 100, 200, 1000, 81)
        assert abs(design.response_at(h, {"LOWPASS": 10, "HIGHPASS": 400, "BANDPASS": 145, "BANDSTOP": 10}[response], 1000)) == pytest.approx(1, abs=0.1)
    assert abs(design.response_at(design.resonator(50, 1000, q=20), 50, 1000)) == pytest.approx(1)
    out, spread = design.uncertain_filter([0.5, 0.5], [1.0], np.ones(5), np.ones(5))
    assert spread[-1] == pytest.approx(math.sqrt(0.5)) and out[-1] == 1


def test_power(spark):
    fs, n = 10_000.0, 20_000
    t = np.arange(n) / fs
    rows = spark.createDataFrame([("a", i, float(325 * math.sin(2 * math.pi * 50 * x)), float(10 * math.sin(2 * math.pi * 50 * x - 0.3))) for i, x in enumerate(t)], "stream_id string, idx long, u double, i double")
    last = power.power_metrics(rows, fs, 2.0, 10.0, 100).orderBy(F.desc("idx")).first()
    s = 325 * 10 / 2
    assert last["S"] == pytest.approx(s, rel=0.02) and last["P"] == pytest.approx(s * math.cos(0.3), rel=0.02) and last["Q"] == pytest.approx(s * math.sin(0.3), rel=0.06)


def test_frequencies(spark):
    x = np.sin(2 * np.pi * 51.3 * np.arange(4000) / 1000)
    s = stream(spark, x)
    assert frequency.time_domain(s).orderBy(F.desc("win")).first()["frequency"] == pytest.approx(51.3, abs=0.05)
    assert frequency.frequency_domain(s).orderBy(F.desc("win")).first()["frequency"] == pytest.approx(51.3, abs=0.2)
    ref, resp = np.sin(2 * np.pi * 1000 * np.arange(8000) / 62500), 0.5 * np.sin(2 * np.pi * 1000 * np.arange(8000) / 62500 - 0.4)
    made = frequency.lock_in(ref, resp, 4000, 62500, 20, 200)
    assert made["frequency"] == pytest.approx(1000, rel=0.01) and made["amplitude"] == pytest.approx(0.5, rel=0.03) and abs(made["phase"]) == pytest.approx(0.4, abs=0.05)


def test_svd(spark):
    draw = np.random.default_rng(0)
    clean = np.sin(np.arange(256) / 5)
    out = values(frequency.svd_denoiser(stream(spark, clean + 0.3 * draw.normal(size=256)), 64, 0.25, max_rank=2))
    assert len(out) == 256 and np.abs(out - clean).mean() < 0.15


def test_spectra(spark):
    x = np.random.default_rng(2).normal(size=64)
    made = spectral.fft(stream(spark, x), 32, "Hann", 32.0).orderBy("win").collect()
    z = np.fft.fft(x[:32] * windows.values("Hann", 32))[:16]
    assert made[0]["re"] == pytest.approx(z.real) and made[0]["magnitude"] == pytest.approx(np.abs(z) / 16) and made[0]["frequency"] == list(range(16))
    d = spectral.dft(stream(spark, x), 32, "Hann").filter("win = 0").orderBy("bin").collect()
    assert [r["im"] for r in d] == pytest.approx(z.imag)
    for name in windows.NAMES:
        k = spark.range(16).select(windows.column(name, F.col("id"), 16).alias("w")).collect()
        assert [r["w"] for r in k] == pytest.approx(windows.values(name, 16))


def test_expressions(spark):
    s = stream(spark, [1, 2, 3, -4])
    assert values(elementwise.expression(s, "a*x^2 + if(x > 2, 1, 0) - min(x, b)", 2.0, 1.0)) == [1, 7, 18, 36]
    assert values(recursive.expression(s, "x + a*y", 0.5)) == [1, 2.5, 4.25, -1.875]
    assert values(elementwise.expression_of_two(s, s, "x*y + c", c=1.0)) == [2, 5, 10, 17]
    assert expressions.vector_program("t := vecIn * a; vecOut := t + 1;", np.array([1.0, 2.0]), 3.0).tolist() == [4, 7]
    for bad in ("x +", "__import__('os')", "q", "x ) (", "1 2"):
        with pytest.raises(ValueError):
            expressions.computed(bad, {"x": 1.0})


def test_conversion(spark):
    row = spark.createDataFrame([(300.7, -1.5, 1e40)], "a double, b double, c double").select(
        elementwise.converted(F.col("a"), "int8").alias("a8"), elementwise.converted(F.col("b"), "uint16").alias("b16"), elementwise.converted(F.col("b"), "int32", 2.0).alias("b32"), elementwise.converted(F.col("c"), "int64").alias("c")
    ).first()
    assert tuple(row) == (44, 65535, -3, None)


def test_complex(spark):
    s = stream(spark, [1, 2, 3, 4, 5])
    z = elementwise.interleaved_to_complex(s)
    assert [tuple(v) for v in values(z)] == [(1, 2), (3, 4)]
    assert values(elementwise.complex_to_interleaved(z)) == [1, 2, 3, 4]
    back = elementwise.mag_phase_to_complex(elementwise.to_mag_phase(z))
    assert [v["re"] for v in values(back)] == pytest.approx([1, 3])
    turned = values(elementwise.rotator(z, phase_increment=math.pi / 2))
    assert turned[0]["re"] == pytest.approx(-2) and turned[1]["re"] == pytest.approx(-3)
    with pytest.raises(ValueError):
        elementwise.rotator(z)
    q = spark.range(1).select(cplx.div(cplx.complex_(F.lit(1.0), F.lit(2.0)), cplx.complex_(F.lit(3.0), F.lit(4.0))).alias("q")).first()["q"]
    assert complex(q["re"], q["im"]) == pytest.approx((1 + 2j) / (3 + 4j))


def test_uncertain(spark):
    a, b = uncertain.uncertain(F.lit(4.0), 0.3), uncertain.uncertain(F.lit(2.0), 0.4)
    r = spark.range(1).select(uncertain.add(a, b).alias("add"), uncertain.mul(a, b).alias("mul"), uncertain.div(a, b).alias("div"), uncertain.sqrt(a).alias("sqrt"), uncertain.log10(a).alias("log")).first()
    assert r["add"]["uncertainty"] == pytest.approx(0.5) and r["mul"]["uncertainty"] == pytest.approx(math.hypot(1.6, 0.6))
    assert r["div"]["uncertainty"] == pytest.approx(math.hypot(0.15, 0.4)) and r["sqrt"]["uncertainty"] == pytest.approx(0.075)


def test_scalars(spark):
    a = F.array(*(F.lit(float(x)) for x in (1, 2, 4)))
    m = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))
    r = spark.range(1).select(scalars.value_at(a, a, F.lit(3.0)).alias("v"), scalars.value_at(a, a, F.lit(9.0)).alias("e"), scalars.index_at(a, F.lit(2.9)).alias("i"), scalars.variance(a).alias("var"), scalars.gemm(m, m).alias("mm"), scalars.hankel(a, 2).alias("h"), scalars.adler32(F.lit(b"Wikipedia")).alias("adler"), scalars.array_math("DIVIDE", a, F.array(F.lit(0.0), F.lit(2.0), F.lit(2.0))).alias("d")).first()
    assert (r["v"], r["e"], r["i"], r["mm"], r["h"], r["adler"]) == (3.0, 4.0, 1, [[7.0, 10.0], [15.0, 22.0]], [[1.0, 2.0], [2.0, 4.0]], 0x11E60398)
    assert r["var"] == pytest.approx(np.var([1, 2, 4])) and math.isnan(r["d"][0])


def test_logarithms(spark):
    a = F.array(F.lit(0.0), F.lit(100.0), F.lit(-1.0))
    r = spark.range(1).select(*(scalars.array_math(op, a, 0.0).alias(op) for op in ("LOG10", "DB", "SQRT", "IDENTITY", "INV_DB"))).first()
    assert r["LOG10"][:2] == [-math.inf, 20] and r["DB"][:2] == [-math.inf, 40] and r["SQRT"][1] == 10 and math.isnan(r["SQRT"][0]) and math.isnan(r["DB"][2])
    assert r["IDENTITY"] == [0, 100, -1] and r["INV_DB"][1] == 1e5


def test_estimators(spark):
    n = 200
    y = np.exp(-((np.arange(n) - 90.3) ** 2) / (2 * 12**2))
    rows = spark.createDataFrame([("d", i, float(i), float(v)) for i, v in enumerate(y)], "ds string, idx long, x double, y double")
    assert estimators.gauss_maximum(rows).first()["location"] == pytest.approx(90.3, abs=1e-6)
    assert estimators.width_at_half_maximum(rows).first()["width"] == pytest.approx(2.3548 * 12, abs=0.05)
    step = np.concatenate([np.zeros(50), np.linspace(0, 1, 11), np.ones(139)])
    made = estimators.step_response(np.arange(n), step)
    assert made["rise_time"] == pytest.approx(8) and made["overshoot"] == pytest.approx(100) and made["rising"] and not made["pulse"]
    assert (made["v1"], made["v2"], made["trigger_time"]) == pytest.approx((0, 1, 55), abs=1e-6)
    assert not estimators.step_response(np.arange(n), -step)["rising"]
    over = step + 0.2 * np.exp(-((np.arange(n) - 64) ** 2) / 8.0) * (np.arange(n) > 60)
    assert estimators.step_response(np.arange(n), over)["overshoot"] == pytest.approx(120, abs=1)
    assert estimators.settling(step, 20, 0.001, 30) == (40, 0.0)
    both = spark.createDataFrame([("a", i, float(i), float(v)) for i, v in enumerate(step)] + [("b", i, float(i), 1.0) for i in range(5)], "ds string, idx long, x double, y double")
    rows = {r["ds"]: r for r in estimators.step_responses(both).collect()}
    assert rows["a"]["rise_time"] == pytest.approx(8) and rows["b"]["rise_time"] is None


def test_tags(spark):
    rows = spark.createDataFrame([("s", 0, 0, {"gr:a": "1"}), ("s", 5, 0, {"gr:a": "2", "x": "y"}), ("s", 6, 0, {"gr:a": "3", "gr:b": "4"})], "stream_id string, idx long, seq int, tag map<string,string>")
    at = lambda policy: sorted((r["idx"], sorted(r["tag"].items())) for r in tags.moved(rows, policy, 4, 2).collect())
    assert at("Forward") == [(0, [("gr:a", "1")]), (4, [("gr:a", "2")]), (4, [("gr:a", "3"), ("gr:b", "4")])]
    assert at("Merge") == [(0, [("gr:a", "1")]), (2, [("gr:a", "3"), ("gr:b", "4")])]
    assert tags.once([rows, rows]).count() == 3
    assert rows.select(tags.get(F.col("tag"), "a").alias("a")).first()["a"] == "1"


def test_nmea(spark):
    good = "$GPGGA,123519,4807.038,N,01131.000,E,1,08,0.9,545.4,M,46.9,M,,*47"
    r = spark.createDataFrame([(good,), (good.replace("*47", "*48"),)], "s string").select(nmea.position(F.col("s")).alias("p")).collect()
    assert r[0]["p"]["latitude"] == pytest.approx(48 + 7.038 / 60) and r[0]["p"]["seconds"] == 45319 and r[1]["p"] is None


def test_generators(spark):
    assert values(generators.counting_source(spark, 3)) == [1, 2, 3]
    sine = values(generators.signal_generator(spark, 8, "Sin", 8.0, 1.0, 2.0, 1.0))
    assert sine == pytest.approx(1 + 2 * np.sin(2 * np.pi * np.arange(8) / 8))
    assert values(generators.signal_generator(spark, 4, "Square", 4.0, 1.0)) == [1, 1, -1, -1]
    seg = spark.createDataFrame([("s", 2, "LinearRamp", 0.0, 4.0, 4.0, 1.0, 0.0, 0.0), ("s", 8, "ParabolicRamp", 4.0, 0.0, 4.0, 1.0, 0.0, 0.0)], "stream_id string, idx long, kind string, start_value double, final_value double, duration double, round_off_time double, impulse_time0 double, impulse_time1 double")
    out = values(generators.function_generator(generators.null_source(spark, 14), seg, 1.0))
    assert out[:7] == [0, 0, 0, 1, 2, 3, 4] and out[8] == 4 and out[12] == pytest.approx(0) and out[10] == pytest.approx(2)
    _, marks = generators.clock_source(spark, 100, 1000.0, [(0, "a/x"), (5_000_000, "b")], 50_000_000)
    assert sorted((r["idx"], r["name"]) for r in marks.collect()) == [(0, "a"), (5, "b"), (50, "a"), (55, "b")]


def test_selector_and_sinks(spark):
    a, b = stream(spark, [1, 2, 3]), stream(spark, [10, 20])
    assert values(select.selector([a, b], [(0, 0), (1, 0)])[0]) == [1, 10, 2, 20]
    assert values(select.selector([a, b], [(0, 0), (1, 0)], interleave=False)[0]) == [1, 2, 3, 10, 20]
    assert values(select.selector([a, b], [(0, 0), (0, 1)])[1]) == [1, 2, 3]
    assert values(select.decimate(stream(spark, range(10)), 3)) == [0, 3, 6]


def test_timing(spark):
    x = np.sin(np.arange(400) / 9)
    for method in ("None", "Linear", "Cubic"):
        out = timing.resampled(x, 1.01, method)
        assert np.abs(out - np.sin(np.arange(len(out)) * 1.01 / 9))[:-2].max() < {"None": 0.07, "Linear": 0.01, "Cubic": 0.001}[method]
    marks = spark.createDataFrame([("s", i, 100, int(i * 100 / 1001 * 1e9)) for i in range(60)], "stream_id string, idx long, n long, time long")
    assert timing.sample_rate_estimate(marks, 1000.0).orderBy(F.desc("idx")).first()["ppm"] == pytest.approx(1000, rel=0.02)
    u = spark.range(1).select(*(timing.rise(k, F.lit(1.0)).alias(k) for k in ("Linear", "RaisedCosine", "Tukey", "Gaussian", "Mushroom", "MushroomSine"))).first()
    assert list(u) == pytest.approx([1] * 6)


def test_files(spark, tmp_path):
    x = np.random.default_rng(0).uniform(-1, 1, 1000)
    s = stream(spark, x)
    for most, compress in ((0, False), (300, True)):
        folder = f"file://{tmp_path}/raw{most}"
        files.binary_sink(s, folder, "float64", most, compress).collect()
        back = files.binary_source(spark, folder, "float64", compressed=compress)
        got = [r["value"] for r in back.orderBy("stream_id", "idx").collect()]
        assert got == x.tolist()
    files.wav_sink(s, f"file://{tmp_path}/wav", 8000).collect()
    got = files.wav_source(spark, f"file://{tmp_path}/wav").orderBy("idx").collect()
    assert [r["value"] for r in got] == pytest.approx(x, abs=1e-6) and got[0]["sample_rate"] == 8000
    rate, channels, back = files.wav_values(files.wav_bytes(x, 44100, True))
    assert (rate, channels) == (44100, 1) and np.abs(back[:, 0] - x).max() < 1e-4


def test_savitzky_golay(spark):
    x = np.arange(40) ** 2 / 10.0
    assert values(window.savitzky_golay(stream(spark, x), 7, 2))[10:] == pytest.approx(x[7:-3], abs=1e-6)
    assert window.savgol_zero_phase(x, 7, 2)[8:-8] == pytest.approx(x[8:-8])
