"""Queries of conversions, settings, generators and kernels. Those that SQL cannot express have no oracle; their operators are tested against numpy."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sampleweave.functions import cplx, scalars, uncertain
from sampleweave.functions import tags as tag_functions
from sampleweave.model import with_index
from sampleweave.operators import align, dataset, design, elementwise, estimators, frequency, monitor, power, recursive, select, spectral, timing, trigger, window
from sampleweave.plans.graph import Graph
from sampleweave.plans.registry import STREAM, query, r6, rounded
from sampleweave.plans.sources_of_queries import datasets, indexed, signal, tags
from sampleweave.sources import generators


@query(
    STREAM
    + """
SELECT stream_id, idx, round(y, 6) + 0.0 AS value FROM (
  SELECT s.stream_id, s.idx, (SELECT sum(0.2 * t.value * pow(0.8, s.idx - t.idx)) FROM s t WHERE t.stream_id = s.stream_id AND t.idx <= s.idx) AS y FROM s)"""
)
def iir_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recursive.iir(signal(spark, sf_dir), [0.2], [1.0, -0.8]), "value")


@query(STREAM + " SELECT stream_id, idx, round(2 * value * value - 3 * value + CASE WHEN value > 50 THEN 1 ELSE -1 END, 4) + 0.0 AS value FROM s")
def expression_siso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elementwise.expression(signal(spark, sf_dir), "a*x^2 - 3*x + if(x > 50, 1, -1)", 2.0).withColumn("value", F.round("value", 4) + F.lit(0.0))


@query(
    STREAM
    + """ SELECT stream_id, idx, round((SELECT sum(t.value * pow(0.3771, s.idx - t.idx)) FROM s t WHERE t.stream_id = s.stream_id AND t.idx <= s.idx), 5) + 0.0 AS value FROM s"""
)
def expression_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recursive.expression(signal(spark, sf_dir), "x + a*y", 0.3771).withColumn("value", F.round("value", 5) + F.lit(0.0))


@query(STREAM + ", p AS (SELECT stream_id, idx // 2 AS idx, max(value) FILTER (idx % 2 = 0) AS re, max(value) FILTER (idx % 2 = 1) AS im, count(*) AS n FROM s GROUP BY stream_id, idx // 2) SELECT stream_id, idx, re, im, round(sqrt(re * re + im * im), 6) + 0.0 AS abs FROM p WHERE n = 2")
def interleaved_to_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = elementwise.interleaved_to_complex(signal(spark, sf_dir))
    return z.select("stream_id", "idx", F.col("value.re").alias("re"), F.col("value.im").alias("im"), r6(cplx.magnitude(F.col("value")), "abs"))


@query("SELECT event_id, ((CAST(trunc(value) AS BIGINT) + 128) % 256 + 256) % 256 - 128 AS int8, ((CAST(trunc(value * -3) AS BIGINT)) % 65536 + 65536) % 65536 AS uint16, round(value / 180 * pi(), 6) + 0.0 AS rad, round(value / pi() * 180, 4) + 0.0 AS deg FROM events")
def converters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", elementwise.converted(v, "int8").cast("long").alias("int8"), elementwise.converted(v, "uint16", -3.0).cast("long").alias("uint16"), r6(elementwise.radians(v), "rad"), (F.round(elementwise.degrees(v), 4) + F.lit(0.0)).alias("deg"))


@query(
    """SELECT p_partkey, round(p_retailprice * p_size, 3) + 0.0 AS product, round(sqrt(pow(p_retailprice * 0.5, 2) + pow(p_size * p_retailprice * 0.01, 2)), 4) + 0.0 AS product_u,
round(sqrt(p_retailprice), 6) + 0.0 AS root, round(p_retailprice * 0.01 * 0.5 / sqrt(p_retailprice), 6) + 0.0 AS root_u FROM part"""
)
def uncertain_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = uncertain.uncertain(F.col("p_retailprice"), F.col("p_retailprice") * 0.01)
    product, root = uncertain.mul(price, uncertain.uncertain(F.col("p_size"), 0.5)), uncertain.sqrt(price)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.round(product["value"], 3) + F.lit(0.0)).alias("product"), (F.round(product["uncertainty"], 4) + F.lit(0.0)).alias("product_u"), r6(root["value"], "root"), r6(root["uncertainty"], "root_u"))


@query(
    STREAM
    + """, m AS (SELECT *, CASE WHEN event_type = 'signup' THEN CAST(idx AS DOUBLE) END AS gain FROM s)
SELECT stream_id, idx, round(value * coalesce(last_value(gain IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 5) + 0.0 AS value FROM m"""
)
def tag_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gain that tags change in mid-stream."""
    changes = indexed(spark, sf_dir).filter("event_type = 'signup'").select("stream_id", "idx", F.col("idx").cast("double").alias("value"))
    rows = align.apply_settings(signal(spark, sf_dir), changes, "gain", 1.0)
    return rows.select("stream_id", "idx", (F.round(F.col("value") * F.col("gain"), 5) + F.lit(0.0)).alias("value"))


@query(STREAM + " SELECT stream_id, CASE WHEN idx % 4 = 0 THEN idx ELSE (idx + 3) // 4 * 4 END // 4 * 2 AS idx, count(*) AS n FROM s GROUP BY 1, 2")
def tag_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags behind a 4:2 operator with the Forward policy."""
    moved = tag_functions.moved(_maps(spark, sf_dir), "Forward", 4, 2)
    return moved.groupBy("stream_id", "idx").agg(F.count("*").alias("n"))


@query(STREAM + " SELECT stream_id, idx // 4 * 2 AS idx, arg_max(event_type, idx) AS name, count(DISTINCT event_type) AS n FROM s GROUP BY stream_id, idx // 4")
def tag_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = tag_functions.moved(_maps(spark, sf_dir), "Merge", 4, 2)
    kinds = F.size(F.map_filter("tag", lambda k, v: k.startswith("gr:is_")))
    return moved.select("stream_id", "idx", tag_functions.get(F.col("tag"), "trigger_name").alias("name"), kinds.cast("long").alias("n"))


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.create_map(F.lit("gr:trigger_name"), F.col("event_type"), F.concat(F.lit("gr:is_"), F.col("event_type")), F.lit("1"), F.lit("local"), F.lit("x"))
    return indexed(spark, sf_dir).select("stream_id", "idx", F.lit(0).alias("seq"), tag.alias("tag"))


@query(STREAM + " SELECT stream_id, count(*) AS n FROM s WHERE idx < 50 GROUP BY stream_id")
def counting_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.counted(select.head(signal(spark, sf_dir), 50)).select("stream_id", "n")


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id % 7) AS BIGINT) AS checksum FROM events WHERE value > 20 GROUP BY event_type")
def dataset_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery by predicate."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value > 20")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("event_id") % 7).alias("checksum"))


@query(
    "SELECT 's' AS stream_id, i AS idx, round(2 * sin(2 * pi() * 5 * i / 100.0 + 0.3) + 1, 6) + 0.0 AS sine, round(CASE WHEN 5 * i / 100.0 - floor(5 * i / 100.0) < 0.5 THEN 1 ELSE -1 END, 6) + 0.0 AS square, "
    "round(2 * (3 * i / 100.0 - floor(3 * i / 100.0 + 0.5)), 6) + 0.0 AS saw, round(4 * abs(3 * i / 100.0 - floor(3 * i / 100.0 + 0.75) + 0.25) - 1, 6) + 0.0 AS triangle FROM range(1000) t(i)"
)
def signal_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("idx") / F.lit(100.0)
    rows = generators.signal_generator(spark, 1000, "Sin", 100.0, 5.0, 2.0, 1.0, 0.3).withColumnRenamed("value", "sine")
    return rows.select("stream_id", "idx", r6("sine", "sine"), r6(generators.waveform("Square", t, 5.0), "square"), r6(generators.waveform("Saw", t, 3.0), "saw"), r6(generators.waveform("Triangle", t, 3.0), "triangle"))


@query(
    STREAM
    + """, m AS (SELECT *, CASE WHEN event_type = 'click' THEN idx END AS mark FROM s),
f AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS anchor FROM m),
t AS (SELECT stream_id, idx, CASE WHEN anchor IS NULL THEN 0.0 WHEN idx - anchor > 4 THEN 10.0 ELSE 10.0 * (idx - anchor) / 4 * (idx - anchor) / 4 * (3 - 2 * (idx - anchor) / 4.0) END AS v FROM f)
SELECT stream_id, idx, round(v, 6) + 0.0 AS value FROM t"""
)
def function_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cubic ramp that every click starts again."""
    rows = indexed(spark, sf_dir)
    seg = rows.filter("event_type = 'click'").select("stream_id", "idx", F.lit("CubicSpline").alias("kind"), F.lit(0.0).alias("start_value"), F.lit(10.0).alias("final_value"), F.lit(4.0).alias("duration"), F.lit(1.0).alias("round_off_time"), F.lit(0.0).alias("impulse_time0"), F.lit(0.0).alias("impulse_time1"))
    return rounded(generators.function_generator(rows, seg, 1.0), "value")


_SAVGOL = [float(x) for x in window.savgol_coefficients(5, 2)[::-1]]


@query(STREAM + " SELECT stream_id, idx, round(" + " + ".join(f"{b!r} * coalesce(lag(value, {k}) OVER w, 0)" for k, b in enumerate(_SAVGOL)) + ", 6) + 0.0 AS value FROM s WINDOW w AS (PARTITION BY stream_id ORDER BY idx)")
def savitzky_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(window.savitzky_golay(signal(spark, sf_dir), 5, 2), "value")


@query("WITH f AS (SELECT i AS k, i / 50.0 AS f FROM range(25) t(i)) SELECT k, round(abs(cos(pi() * f)), 6) + 0.0 AS magnitude FROM f")
def frequency_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(25).select(F.col("id").alias("k"), (F.col("id") / F.lit(50.0)).alias("f"))
    return rows.select("k", r6(design.response_columns(((0.5, 0.5), (1.0,)), F.col("f"))["magnitude"], "magnitude"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 5) + 0.0 AS dot, round(list_avg(embedding), 5) + 0.0 AS mean, round(CAST(list_max(embedding) AS DOUBLE), 5) + 0.0 AS maximum FROM embeddings")
def tensor_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    five = lambda c, n: (F.round(c, 5) + F.lit(0.0)).alias(n)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", five(scalars.dot(v, v), "dot"), five(scalars.mean(v), "mean"), five(F.array_max(v), "maximum"))


@query(
    STREAM
    + """, b AS (SELECT s.*, idx // 20 AS seg, idx % 20 AS pos FROM s), c AS (SELECT *, count(*) OVER (PARTITION BY stream_id, seg) AS length FROM b),
e AS (SELECT *, least(CASE WHEN pos < 4 THEN (pos + 1) / 5.0 ELSE 1 END, CASE WHEN length - 1 - pos < 4 THEN (length - pos) / 5.0 ELSE 1 END) AS u FROM c)
SELECT stream_id, idx, round(value * u, 6) + 0.0 AS value FROM e"""
)
def burst_taper(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal(spark, sf_dir).withColumn("seg", F.expr("idx div 20")).withColumn("pos", F.col("idx") % 20)
    rows = rows.withColumn("length", F.count("*").over(Window.partitionBy("stream_id", "seg")))
    return rounded(timing.burst_taper(rows, 4, "Linear").select("stream_id", "idx", "value"), "value")


@query(STREAM + " SELECT stream_id, idx, list_sort(list(event_type)) AS names FROM s WHERE event_type IN ('click', 'view') GROUP BY stream_id, idx")
def attach_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tags(spark, sf_dir).filter("name in ('click', 'view')").select("stream_id", "idx", "name")
    return align.attach_tags(signal(spark, sf_dir), found).filter("tags is not null").select("stream_id", "idx", F.transform("tags", lambda t: t["name"]).alias("names"))


@query(STREAM + " SELECT stream_id, idx, round(3 * value + 2 * value - (value + 1), 6) + 0.0 AS value FROM s WHERE idx < 30")
def graph_of_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph with parallel paths: 3x + 2x - (x + 1) of the first 30 samples."""
    g = Graph()
    source = g.add("Table", frame=signal(spark, sf_dir))
    head = g.add("Head", n_samples_max=30)
    three, two, plus = g.add("MultiplyConst", value=3.0), g.add("MultiplyConst", value=2.0), g.add("AddConst", value=1.0)
    total, rest = g.add("Add"), g.add("Subtract")
    g.connect(source, "out", head, "in")
    for b in (three, two, plus):
        g.connect(head, "out", b, "in")
    g.connect(three, "out", total, "in0")
    g.connect(two, "out", total, "in1")
    g.connect(total, "out", rest, "in0")
    g.connect(plus, "out", rest, "in1")
    return rounded(g.run(spark, rest.name), "value")


@query(STREAM + " SELECT event_id, stream_id, idx FROM s")
def bucketed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of every event in its stream, with days sorted apart."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id")
    return with_index(events, "user_id", ["ts", "event_id"], F.to_date("ts")).select("event_id", "stream_id", "idx")


@query(STREAM + " SELECT stream_id, idx, round(2 * value + 1, 6) + 0.0 AS value FROM s")
def expression_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recursive.expression_bulk(signal(spark, sf_dir), "t := a * vecIn; vecOut := t + 1;", 1 << 16, 2.0), "value")


@query(STREAM + " SELECT stream_id AS ds, round(min(value), 6) + 0.0 AS minimum, round(max(value), 6) + 0.0 AS maximum, count(*) AS n FROM s GROUP BY stream_id")
def dataset_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data sets as rows of arrays, with the range of each."""
    sets = dataset.with_range(dataset.nested(datasets(spark, sf_dir)))
    return sets.select("ds", r6("range.min", "minimum"), r6("range.max", "maximum"), F.size("values").cast("long").alias("n"))


@query()
def dataset_symmetric_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = dataset.symmetric_filtered(dataset.nested(datasets(spark, sf_dir)), *design.iir_design("LOWPASS", 2, 0.1))
    return rounded(dataset.unnested(sets), "y")


@query()
def uncertain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal(spark, sf_dir).select("stream_id", "idx", F.struct("value", F.lit(1.0).alias("uncertainty")).alias("value"))
    made = recursive.uncertain_iir(rows, *design.iir_design("LOWPASS", 2, 0.1))
    return made.select("stream_id", "idx", r6("value.value", "value"), r6("value.uncertainty", "uncertainty"))


@query()
def trigger_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that start behind a run of views and end behind one of clicks."""
    return trigger.segments(tags(spark, sf_dir), "[^view, ^click]").select("stream_id", "seg", "i_start", "i_end")


@query()
def iir_butterworth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recursive.iir(signal(spark, sf_dir), *design.iir_design("LOWPASS", 3, 0.1)), "value")


@query()
def fft_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.fft(signal(spark, sf_dir), 16).select("stream_id", "win", F.transform("magnitude", lambda m: F.round(m, 6)).alias("magnitude"))


@query()
def svd_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frequency.svd_denoiser(signal(spark, sf_dir), 16, 0.25, max_rank=3), "value")


@query()
def frequency_time_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    tone = generators.signal_generator(spark, 20_000, "Sin", 1000.0, 50.4)
    return rounded(frequency.time_domain(tone), "frequency")


@query()
def frequency_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    tone = generators.signal_generator(spark, 20_000, "Sin", 1000.0, 50.4)
    return rounded(frequency.frequency_domain(tone), "frequency")


@query()
def iq_demodulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = 2 * math.pi * 1000.0 / 62500.0 * F.col("idx")
    rows = spark.range(40_000).select(F.lit("s").alias("stream_id"), F.col("id").alias("idx")).withColumn("ref", F.sin(t)).withColumn("resp", 0.5 * F.sin(t - 0.4))
    return rounded(frequency.iq_demodulator(rows, 62500.0, 20.0, 200.0, 4096, 4096), "amplitude", "phase", "frequency")


@query()
def power_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = 2 * math.pi * 50.0 / 10_000.0 * F.col("idx")
    rows = spark.range(50_000).select(F.lit("L1").alias("stream_id"), F.col("id").alias("idx")).withColumn("u", 325 * F.sin(t)).withColumn("i", 10 * F.sin(t - 0.2))
    return rounded(power.power_metrics(rows), "P", "Q", "S", "u_rms", "i_rms")


@query()
def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = estimators.step_responses(datasets(spark, sf_dir))
    return rounded(made, *(c for c in made.columns if c != "ds"))


@query()
def drift_compensation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timing.drift_compensated(signal(spark, sf_dir), 20_000.0, "Cubic"), "value")
