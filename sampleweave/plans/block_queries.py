"""Queries of sources, conversions, data-set mathematics, windows and filters, one for each operator that no other query shows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleweave.functions import cplx, nmea, scalars, windows
from sampleweave.operators import align, dataset, design, elementwise, estimators, feedback, monitor, recursive, timing, window
from sampleweave.plans.graph import Graph
from sampleweave.plans.registry import ORACLES, STREAM, query, r6, rounded
from sampleweave.plans.sources_of_queries import datasets, indexed, signal, tags
from sampleweave.sources import generators

RECURSIVE = STREAM.replace("WITH s AS", "WITH RECURSIVE s AS", 1)


def recursion_sql(b: list[float], a: list[float], backward: bool = False) -> str:
    """Common tables s and r: the difference equation of b and a, a sample of every stream a step; r (stream_id, idx, y0)."""
    m = max(len(a), len(b)) - 1
    first = "SELECT max(idx) FROM s z WHERE z.stream_id = s.stream_id" if backward else "0"
    states = "".join(f", CAST(0 AS DOUBLE) AS x{k}, CAST(0 AS DOUBLE) AS y{k}" for k in range(1, m + 1))
    new = " + ".join([f"{b[0]!r} * s.value", *(f"{x!r} * r.x{k - 1}" for k, x in enumerate(b[1:], 1)), *(f"{-x!r} * r.y{k - 1}" for k, x in enumerate(a[1:], 1))])
    moved = "".join(f", r.x{k - 1}, r.y{k - 1}" for k in range(1, m + 1))
    return f"""SELECT stream_id, idx, value AS x0, {b[0]!r} * value AS y0{states} FROM s WHERE idx = ({first})
        UNION ALL SELECT s.stream_id, s.idx, s.value, {new}{moved} FROM r JOIN s ON s.stream_id = r.stream_id AND s.idx = r.idx {"-" if backward else "+"} 1"""


def plainly(coefficients) -> tuple[list[float], list[float]]:
    return tuple([float(x) for x in c] for c in coefficients)


# queries of other modules that had no oracle
_B, _A = plainly(design.iir_design("LOWPASS", 3, 0.1))
ORACLES["iir_butterworth"] = f"{RECURSIVE}, r AS ({recursion_sql(_B, _A)}) SELECT stream_id, idx, round(y0, 6) + 0.0 AS value FROM r"
_B, _A = plainly(design.iir_design("LOWPASS", 2, 0.1))
ORACLES["dataset_symmetric_filter"] = (
    f"{RECURSIVE}, r AS ({recursion_sql(_B, _A)}), f AS MATERIALIZED (SELECT * FROM r), q AS ({recursion_sql(_B, _A, backward=True).replace('FROM r JOIN', 'FROM q r JOIN')}) "
    "SELECT f.stream_id AS ds, f.idx, CAST(f.idx AS DOUBLE) AS x, round((f.y0 + q.y0) / 2, 6) + 0.0 AS y FROM f JOIN q ON f.stream_id = q.stream_id AND f.idx = q.idx"
)
ORACLES["fft_blocks"] = (
    STREAM
    + """, n AS (SELECT stream_id, max(idx) + 1 AS n FROM s GROUP BY stream_id),
c AS (SELECT s.stream_id, idx // 16 AS win, idx % 16 AS pos, value * (0.5 - 0.5 * cos(2 * pi() * (idx % 16) / 15)) AS x FROM s JOIN n USING (stream_id) WHERE idx < n // 16 * 16),
z AS (SELECT stream_id, win, k AS bin, sum(x * cos(2 * pi() * k * pos / 16)) AS re, sum(x * sin(2 * pi() * k * pos / 16)) AS im FROM c, range(0, 8) t(k) GROUP BY ALL)
SELECT stream_id, win, list(round(sqrt(re * re + im * im) * 2 / 16, 6) ORDER BY bin) AS magnitude FROM z GROUP BY stream_id, win"""
)


@query(f"{RECURSIVE}, r AS ({recursion_sql(*plainly(design.resonator(0.1, 1.0, q=3.0)))}) SELECT stream_id, idx, round(y0, 6) + 0.0 AS value FROM r")
def resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recursive.iir(signal(spark, sf_dir), *design.resonator(0.1, 1.0, q=3.0)), "value")


_TAPS = [float(x) for x in design.fir_design("LOWPASS", 0.1, 0.2, 1.0, 9)[0]]


@query(STREAM + " SELECT stream_id, idx, round(" + " + ".join(f"{b!r} * coalesce(lag(value, {k}) OVER w, 0)" for k, b in enumerate(_TAPS)) + ", 6) + 0.0 AS value FROM s WINDOW w AS (PARTITION BY stream_id ORDER BY idx)")
def fir_designed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(window.fir(signal(spark, sf_dir), design.fir_design("LOWPASS", 0.1, 0.2, 1.0, 9)[0]), "value")


@query("SELECT kind, i AS idx, CASE kind WHEN 'null' THEN 0.0 WHEN 'constant' THEN 3.5 ELSE 11.0 + i END AS value FROM (VALUES ('null'), ('constant'), ('counting')) k(kind), range(500) t(i)")
def plain_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"null": generators.null_source(spark, 500), "constant": generators.constant_source(spark, 500, 3.5), "counting": generators.counting_source(spark, 500, 10.0)}
    return reduce(DataFrame.union, [x.select(F.lit(k).alias("kind"), "idx", "value") for k, x in made.items()])


@query(
    """WITH v AS (SELECT r, i, r * 4 + i AS idx, [1.5, -2.0, 0.25, 8.0][i + 1] AS value FROM range(25) a(r), range(4) b(i))
SELECT idx, CAST(value AS DOUBLE) AS value, CASE i WHEN 1 THEN 'start' WHEN 3 THEN 'stop' END AS name FROM v"""
)
def tag_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and tags that repeat, the tags on their samples."""
    rows, marks = generators.tag_source(spark, [1.5, -2.0, 0.25, 8.0], [(1, "start", "a"), (3, "stop", "")], 25)
    return align.attach_tags(rows, marks.select("stream_id", "idx", "name")).select("idx", "value", F.col("tags")[0]["name"].alias("name"))


@query("WITH t AS (SELECT (r * 250 + o) * 1000000 AS time, name FROM range(8) a(r), (VALUES (10, 'inject'), (130, 'ramp')) b(o, name)) SELECT CAST(round(time / 1e6) AS BIGINT) AS idx, name, time FROM t")
def clock_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a clock of 1 kHz that repeat every 250 ms."""
    return generators.clock_source(spark, 2000, 1000.0, [(10_000_000, "inject/a"), (130_000_000, "ramp/b")], 250_000_000)[1].select("idx", "name", "time")


@query(
    "WITH k AS (SELECT i, CAST(i AS DOUBLE) AS k FROM range(200) t(i)) SELECT * FROM (SELECT 'triangular' AS ds, i AS idx, round(1 + 2 * greatest(0, 1 - abs(k - 100) / 25), 6) + 0.0 AS y FROM k "
    "UNION ALL SELECT 'ramp', i, round(1 + 2 * k / 199, 6) + 0.0 FROM k UNION ALL SELECT 'gauss', i, round(1 + 2 * exp(-pow(k - 100, 2) / 1250), 6) + 0.0 FROM k UNION ALL SELECT 'step', i, CASE WHEN k < 100 THEN 1.0 ELSE 3.0 END FROM k)"
)
def test_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [generators.test_signal(spark, kind, 200, low=1.0, high=3.0) for kind in ("triangular", "ramp", "gauss", "step")]
    return rounded(reduce(DataFrame.union, made).select("ds", "idx", "y"), "y")


@query(
    """WITH p AS (SELECT i AS idx, i / 100.0 AS t FROM range(150) x(i)), r AS (SELECT *, 4 / (0.2 * 0.8) AS a FROM p)
SELECT idx, round(2 + CASE WHEN t > 1 THEN 4 WHEN t < 0.2 THEN a * t * t / 2 WHEN t <= 0.8 THEN a * (0.02 + 0.2 * (t - 0.2)) ELSE 4 - a * pow(1 - t, 2) / 2 END, 6) + 0.0 AS parabola,
       round(CASE WHEN t > 1 THEN 6 ELSE 2 + 4 * t END, 6) + 0.0 AS line, CASE WHEN t < 0.3 OR t > 0.7 THEN 2.0 ELSE 6.0 END AS impulse FROM r"""
)
def ramps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a function generator from 2 to 6 in a second: a parabolic ramp, a line, an impulse."""
    t = F.col("id") / F.lit(100.0)
    made = lambda kind: generators.ramp(F.lit(kind), t, F.lit(2.0), F.lit(6.0), F.lit(1.0), F.lit(0.2), F.lit(0.3), F.lit(0.4))
    return spark.range(150).select(F.col("id").alias("idx"), r6(made("ParabolicRamp"), "parabola"), r6(made("LinearRamp"), "line"), made("ImpulseResponse").alias("impulse"))


@query(STREAM + " SELECT stream_id, idx, round(abs(value - 50), 6) + 0.0 AS value, round(2 * (value + (value - idx)), 6) + 0.0 AS both FROM s")
def absolute_and_two_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute values, and an expression of two inputs."""
    x = signal(spark, sf_dir)
    both = elementwise.expression_of_two(x, x.withColumn("value", F.col("value") - F.col("idx")), "a*(x+y)", 2.0).withColumnRenamed("value", "both")
    y = x.withColumn("value", elementwise.absolute(F.col("value") - 50))
    return rounded(y.join(both, ["stream_id", "idx"]), "value", "both")


def turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complex samples: the value, and the place as imaginary part."""
    return elementwise.real_imag_to_complex(signal(spark, sf_dir).select("stream_id", "idx", F.col("value").alias("real"), F.col("idx").cast("double").alias("imag")))


@query(STREAM + " SELECT stream_id, idx, round(value, 6) + 0.0 AS real, CAST(idx AS DOUBLE) AS imag FROM s")
def real_imag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(elementwise.to_real_imag(turned(spark, sf_dir)), "real", "imag")


@query(STREAM + " SELECT stream_id, idx, round(sqrt(value * value + idx * idx), 6) + 0.0 AS mag, round(atan2(idx, value), 6) + 0.0 AS phase FROM s")
def mag_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(elementwise.to_mag_phase(turned(spark, sf_dir)), "mag", "phase")


@query(STREAM + " SELECT stream_id, idx, round(value * cos(idx / 10.0), 6) + 0.0 AS re, round(value * sin(idx / 10.0), 6) + 0.0 AS im FROM s")
def mag_phase_to_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    polar = signal(spark, sf_dir).select("stream_id", "idx", F.col("value").alias("mag"), (F.col("idx") / 10.0).alias("phase"))
    return elementwise.mag_phase_to_complex(polar).select("stream_id", "idx", r6("value.re", "re"), r6("value.im", "im"))


@query(STREAM + " SELECT stream_id, idx * 2 + p AS idx, round(CASE p WHEN 0 THEN value ELSE idx END, 6) + 0.0 AS value FROM s, range(2) t(p)")
def complex_to_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(elementwise.complex_to_interleaved(turned(spark, sf_dir)), "value")


@query(STREAM + " SELECT stream_id, idx, round((value * 3 + idx) / (9 + 1), 6) + 0.0 AS re, round((3 * idx - value) / 10, 6) + 0.0 AS im FROM s")
def complex_quotient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complex samples over 3 + i."""
    z = cplx.div(F.col("value"), cplx.complex_(F.lit(3.0), F.lit(1.0)))
    return turned(spark, sf_dir).select("stream_id", "idx", r6(z["re"], "re"), r6(z["im"], "im"))


@query(STREAM + " SELECT stream_id, idx, round(2 * value - (value + 3) - (-1 * value), 6) + 0.0 AS value FROM s")
def split_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel paths of one stream in one expression."""
    return rounded(elementwise.split_merge(signal(spark, sf_dir), [lambda x: x * 2, lambda x: x + 3, lambda x: -x], [1, -1, -1]), "value")


@query(STREAM + " SELECT stream_id, idx, round(value + (value + 1) + (value + 2) + (value + 3), 6) + 0.0 AS total, round(value * (value + 1) * (value + 2) / 1000, 4) + 0.0 AS product FROM s")
def graph_of_many_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph: a copy fans out to constants, four meet in a sum and three in a product of whole streams."""
    g = Graph()
    source, copy = g.add("Table", frame=signal(spark, sf_dir)), g.add("Copy")
    g.connect(source, "out", copy, "in")
    plus = [g.add("AddConst", value=float(k)) for k in range(4)]
    total, product, small = g.add("Add4"), g.add("Multiply3"), g.add("DivideConst", value=1000.0)
    for k, b in enumerate(plus):
        g.connect(copy, "out", b, "in")
        g.connect(b, "out", total, f"in{k}")
        if k < 3:
            g.connect(b, "out", product, f"in{k}")
    g.connect(product, "out", small, "in")
    a, b = g.run(spark, total.name).withColumnRenamed("value", "total"), g.run(spark, small.name).withColumnRenamed("value", "product")
    return a.join(b, ["stream_id", "idx"]).select("stream_id", "idx", r6("total", "total"), (F.round("product", 4) + F.lit(0.0)).alias("product"))


@query(STREAM + ", n AS (SELECT stream_id, max(idx) AS last FROM s GROUP BY stream_id) SELECT s.stream_id, idx, value FROM s JOIN n ON s.stream_id = n.stream_id AND idx > last - 5")
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a history of five samples keeps of each stream."""
    return align.drop_history(signal(spark, sf_dir), 5).select("stream_id", "idx", "value")


@query(
    STREAM
    + """, v AS (SELECT stream_id, list(round(value, 6) ORDER BY idx) AS v FROM s WHERE idx < 40 GROUP BY stream_id)
SELECT a.stream_id // 2 AS pair, count(*) AS n, CAST(len(any_value(a.v)) AS BIGINT) AS length, list(list_sum(a.v)::DECIMAL(18, 4)::DOUBLE ORDER BY a.stream_id) AS sums FROM v a GROUP BY 1"""
)
def merged_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data sets of neighbouring streams stacked as signals; a stream that ends early keeps its shorter signal, and its pair the axis of the first."""
    rows = datasets(spark, sf_dir).filter("idx < 40").withColumn("y", F.round("y", 6))
    sets = dataset.nested(rows).select(F.expr("ds div 2").alias("group"), F.col("ds").alias("name"), "axis", "values")
    made = align.merge_datasets(sets, strict=False)
    known = lambda s: F.filter(s["values"], lambda x: x.isNotNull())
    total = lambda s: F.when(F.size(known(s)) > 0, F.round(F.aggregate(known(s), F.lit(0.0), lambda a, x: a + x), 4))
    return made.select(F.col("group").alias("pair"), F.size("signals").cast("long").alias("n"), F.size("axis").cast("long").alias("length"), F.transform("signals", total).alias("sums"))


@query(
    STREAM
    + """, p AS (SELECT *, max(value) OVER w AS top, first_value(idx) OVER (PARTITION BY stream_id ORDER BY value DESC, idx) AS peak, max(idx) OVER w AS n,
  lag(value) OVER o AS l, lead(value) OVER o AS r FROM s WINDOW w AS (PARTITION BY stream_id), o AS (PARTITION BY stream_id ORDER BY idx)),
u AS (SELECT stream_id, min_by(idx - 1 + (top / 2 - l) / (value - l), idx) AS hi FROM p WHERE value <= top / 2 AND idx > peak GROUP BY stream_id),
d AS (SELECT stream_id, max_by(idx + (top / 2 - value) / (r - value), idx) AS lo FROM p WHERE value <= top / 2 AND idx < peak GROUP BY stream_id)
SELECT s.stream_id AS ds, round(hi - lo, 6) + 0.0 AS width FROM (SELECT DISTINCT stream_id, peak, n FROM p) s JOIN u USING (stream_id) JOIN d USING (stream_id) WHERE peak > 0 AND peak < n"""
)
def half_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of the maximum at half its height, where it has two sides."""
    return rounded(estimators.width_at_half_maximum(datasets(spark, sf_dir)), "width").filter("not isnan(width)")


@query("SELECT p_partkey, p_size % 4 <> 0 AND p_size % 3 <> 0 AND p_size % 5 <> 0 AS fits FROM part")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested data sets of which some lack a unit, a range or a value."""
    size = F.col("p_size")
    names = F.array(F.lit("a"), F.lit("b"))
    short = lambda by: F.slice(names, 1, F.when(size % by == 0, 1).otherwise(2))
    ds = F.struct(
        F.array(F.lit("x")).alias("axis_names"), F.array(F.lit("s")).alias("axis_units"), F.array(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))).alias("axis_values"), F.array(F.lit(3)).alias("extents"),
        names.alias("signal_names"), short(4).alias("signal_units"), F.transform(short(3), lambda _: F.lit(0.0)).alias("signal_ranges"),
        F.sequence(F.lit(1), F.when(size % 5 == 0, 5).otherwise(6)).alias("signal_values"),
    )
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", estimators.consistent(ds).alias("fits"))


#: Decimals that both engines agree on: quotients may end in a 5 after fewer.
PLACES = {"DIVIDE": 9}


def _operation(a: str, b: str) -> dict[str, str]:
    return {
        "ADD": f"{a} + {b}", "SUBTRACT": f"{a} - {b}", "MULTIPLY": f"{a} * {b}", "DIVIDE": f"CASE WHEN {b} = 0 THEN 'nan'::DOUBLE ELSE {a} / nullif({b}, 0) END", "SQR": f"pow({a} + {b}, 2)",
        "SQRT": f"CASE WHEN {a} + {b} > 0 THEN sqrt(greatest({a} + {b}, 0)) ELSE 'nan'::DOUBLE END", "LOG10": f"10 * log10({a} + {b})", "DB": f"20 * log10({a} + {b})", "INV_DB": f"log10(pow(10, {a} / 20))", "IDENTITY": f"{a} + {b}",
    }


@query(STREAM + " SELECT stream_id, idx, " + ", ".join(f"round({sql}, {PLACES.get(op, 4)}) + 0.0 AS {op.lower()}" for op, sql in _operation("value", "(idx + 1.0)").items()) + " FROM s")
def dataset_mathematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operations on two data sets of one axis; of the inverse decibels, which are large, the logarithm."""
    sets = dataset.nested(datasets(spark, sf_dir))
    other = F.transform("axis", lambda x: x + 1)
    made = sets.select(F.col("ds").alias("stream_id"), F.posexplode(F.arrays_zip(*(scalars.array_math(op, F.col("values"), other).alias(op.lower()) for op in scalars.MATH))).alias("idx", "v"))
    return made.select("stream_id", F.col("idx").cast("long").alias("idx"), *((F.round(F.log10(f"v.{op.lower()}") if op == "INV_DB" else F.col(f"v.{op.lower()}"), PLACES.get(op, 4)) + F.lit(0.0)).alias(op.lower()) for op in scalars.MATH))


def _cosines(name: str) -> str:
    return " + ".join(f"{(-1) ** i * a!r} * cos({i} * 2 * pi() * k / 31)" for i, a in enumerate(windows.COSINES[name]))


_BESSEL = "list_sum(list_transform(range(0, 30), lambda j: pow({x} / 2, 2 * j) / pow(gamma(j + 1), 2)))"


@query(
    "SELECT k, "
    + ", ".join(f"round({_cosines(n)}, 6) + 0.0 AS {n.lower()}" for n in windows.COSINES)
    + ", round(pow(sin(2 * pi() * k / 31), 2), 6) + 0.0 AS hannexp, round(exp(k / 96.0), 6) + 0.0 AS exponential, "
    + f"round({_BESSEL.format(x='(1.6 * sqrt(1 - pow(2 * k / 31.0 - 1, 2)))')} / {_BESSEL.format(x='1.6')}, 6) + 0.0 AS kaiser FROM range(32) t(k)"
)
def apodisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows at 32 places."""
    return spark.range(32).select(F.col("id").alias("k"), *(r6(windows.column(n, F.col("id"), 32), n.lower()) for n in windows.NAMES))


@query(
    """WITH a AS (SELECT vec_id, embedding AS e, list_transform(range(0, len(embedding)), lambda i: CAST(i AS DOUBLE)) AS axis, (vec_id % 500) / 10.0 AS place FROM embeddings)
SELECT vec_id, round(CAST(e[CAST(floor(place) AS BIGINT) + 1] AS DOUBLE) + (CAST(e[CAST(floor(place) AS BIGINT) + 2] AS DOUBLE) - CAST(e[CAST(floor(place) AS BIGINT) + 1] AS DOUBLE)) * (place - floor(place)), 5) + 0.0 AS value,
CAST(ceil(place - 0.5) AS INTEGER) AS nearest, round(list_sum(list_transform(e[4:10], lambda x: CAST(x AS DOUBLE))), 5) + 0.0 AS part FROM a"""
)
def axis_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at a place on an axis, the nearest place, the sum of a part."""
    axis, at = F.transform("embedding", lambda x, i: i.cast("double")), (F.col("vec_id") % 500) / 10.0
    e = F.transform("embedding", lambda x: x.cast("double"))
    five = lambda c, n: (F.round(c, 5) + F.lit(0.0)).alias(n)
    total = F.aggregate(scalars.sub_array(e, 3, 10), F.lit(0.0), lambda s, x: s + x)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", five(scalars.value_at(axis, e, at), "value"), scalars.index_at(axis, at).alias("nearest"), five(total, "part"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding[1:6], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 5) + 0.0 AS norm, round(list_var_pop(e), 5) + 0.0 AS variance,
list_transform(range(1, 5), lambda i: round(e[i] * e[1] + e[i + 1] * e[2] + e[i + 2] * e[3], 5) + 0.0) AS product, round(e[2] * e[2] + e[3] * e[3] + e[4] * e[4], 5) + 0.0 AS inner_product FROM v"""
)
def tensor_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Hankel matrix of six numbers times its own first row; an element of the matrix times its transpose; norm and variance."""
    five = lambda c: F.round(c, 5) + F.lit(0.0)
    e = F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", e.alias("e")).withColumn("h", scalars.hankel(F.col("e"), 4))
    square = scalars.gemm(F.col("h"), scalars.transpose(F.col("h")))
    return rows.select("vec_id", five(scalars.frobenius(F.col("e"))).alias("norm"), five(scalars.variance(F.col("e"))).alias("variance"), F.transform(scalars.gemv(F.col("h"), F.slice("e", 1, 3)), five).alias("product"), five(square[1][1]).alias("inner_product"))


@query(
    """WITH b AS (SELECT event_id, list_transform(string_split(event_type || event_id, ''), lambda c: unicode(c)) AS d FROM events)
SELECT event_id, ((len(d) + list_sum(list_transform(d, lambda x, i: x * (len(d) - i + 1)))) % 65521)::BIGINT * 65536 + ((1 + list_sum(d)) % 65521)::BIGINT AS checksum FROM b"""
)
def adler_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", scalars.adler32(F.concat("event_type", F.col("event_id").cast("string")).cast("binary")).alias("checksum"))


@query(
    """SELECT event_id, CAST((event_id % 24) * 3600 + (event_id % 60) * 60 + 7 AS DOUBLE) AS seconds, round((event_id % 80 + 30.5 / 60) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END, 6) + 0.0 AS latitude,
round((event_id % 170 + 12.25 / 60) * CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END, 6) + 0.0 AS longitude FROM events WHERE event_id % 5 <> 0"""
)
def nmea_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with positions; every fifth has a wrong checksum and gives none."""
    n = F.col("event_id")
    text = F.format_string("$GPGGA,%02d%02d07.00,%02d30.5000,%s,%03d12.2500,%s,1,08,0.9,545.4,M,46.9,M,,*", n % 24, n % 60, n % 80, F.when(n % 2 == 0, "N").otherwise("S"), n % 170, F.when(n % 3 == 0, "W").otherwise("E"))
    own = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.alias("t"))
    right = F.lpad(F.hex(F.expr("aggregate(transform(split(substring(t, 2, length(t) - 2), ''), c -> ascii(c)), 0, (a, x) -> a ^ x)")), 2, "0")
    own = own.select("event_id", F.concat("t", F.when(F.col("event_id") % 5 == 0, F.lit("ZZ")).otherwise(right)).alias("t")).withColumn("p", nmea.position(F.col("t")))
    return own.filter("p is not null").select("event_id", F.col("p.seconds").alias("seconds"), r6("p.latitude", "latitude"), r6("p.longitude", "longitude"))


@query(
    STREAM
    + """, t AS (SELECT stream_id, idx, epoch_us(ts) * 1000 AS time FROM s), p AS (SELECT stream_id, idx, coalesce((time - lag(time) OVER (PARTITION BY stream_id ORDER BY idx)) / 1e9 / 10, 0.001) - 0.001 AS off FROM t),
k AS (SELECT 1 - exp(-2 * pi() * 0.1) AS k), y AS (SELECT p.stream_id, p.idx, (SELECT sum(k * q.off * pow(1 - k, p.idx - q.idx)) FROM p q WHERE q.stream_id = p.stream_id AND q.idx <= p.idx) AS y FROM p, k)
SELECT stream_id, idx, round((y + 0.001) * 1000, 3) + 0.0 AS period FROM y"""
)
def sample_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of clocks that tick with every event, ten samples each: its period in milliseconds."""
    marks = indexed(spark, sf_dir).select("stream_id", "idx", F.lit(10).alias("n"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time"))
    made = timing.sample_rate_estimate(marks, 1000.0)
    return made.select("stream_id", "idx", (F.round(1000 / F.col("sample_rate"), 3) + F.lit(0.0)).alias("period"))


@query(STREAM + ", p AS (SELECT *, row_number() OVER (PARTITION BY stream_id, event_type ORDER BY idx) AS k FROM s) SELECT stream_id, idx, event_type AS name, k AS nth, idx - lag(idx) OVER (PARTITION BY stream_id, event_type ORDER BY idx) AS apart FROM p")
def tag_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag as it was seen: its place, its number among those of its name and the distance from the last."""
    return monitor.tag_monitor(tags(spark, sf_dir)).select("stream_id", "idx", "name", "nth", "apart")


@query(
    STREAM
    + """, m AS (SELECT *, CASE WHEN event_type = 'signup' THEN CAST(idx AS DOUBLE) END AS g FROM s), f AS (SELECT stream_id, idx, coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS gain FROM m),
p AS (SELECT *, lag(gain) OVER (PARTITION BY stream_id ORDER BY idx) AS before FROM f) SELECT stream_id, idx, 'gain' AS name, before, gain AS after FROM p WHERE idx = 0 OR before <> gain"""
)
def settings_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a gain that tags set."""
    changes = indexed(spark, sf_dir).filter("event_type = 'signup'").select("stream_id", "idx", F.col("idx").cast("double").alias("value"))
    return monitor.settings_changes(align.apply_settings(signal(spark, sf_dir), changes, "gain", 1.0), ["gain"])


@query(STREAM + ", v AS (SELECT stream_id, avg(value) AS m, count(*) AS n FROM s GROUP BY stream_id) SELECT CAST(count(*) FILTER (m > 50) AS BIGINT) AS delivered, CAST(count(*) FILTER (m <= 50) AS BIGINT) AS passed, CAST(coalesce(sum(n) FILTER (m <= 50), 0) AS BIGINT) AS passed_samples FROM v")
def delivered_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data sets that a listener asks for by their mean, and what passed it by."""
    known = F.filter("values", lambda x: x.isNotNull())  # SQL's mean is of these, and a set without any is in neither count
    wanted, rest = monitor.delivered(dataset.nested(datasets(spark, sf_dir)).filter(F.size(known) > 0), scalars.mean(known) > 50)
    return wanted.agg(F.count("*").alias("delivered")).withColumn("one", F.lit(1)).join(rest.select(F.lit(1).alias("one"), F.col("n").alias("passed"), F.col("n_samples").alias("passed_samples")), "one").drop("one")


def mixer() -> Graph:
    """A part of a stream and a part of what left the sum before, as a graph with a loop."""
    g = Graph("mixer")
    g.add("MultiplyConst", "scale", value=0.2718281828)
    g.add("Add", "sum")
    g.add("MultiplyConst", "back", value=0.7310585786)
    g.connect("scale", "out", "sum", "in0")
    g.connect("sum", "out", "back", "in")
    g.connect("back", "out", "sum", "in1")
    g.export("in", "scale", "in")
    return g


@query(f"{RECURSIVE}, r AS ({recursion_sql([0.2718281828], [1.0, -0.7310585786])}) SELECT stream_id, idx, round(y0, 6) + 0.0 AS value, round(0.7310585786 * y0, 6) + 0.0 AS tap FROM r")
def feedback_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A low-pass as a cycle of a sum and a factor, and what the factor puts out for the same sample."""
    ports = mixer().compile(spark, **{"in": signal(spark, sf_dir)})
    own = feedback.Transfer.of([0.2718281828])
    _, tap = feedback.feedback_merge([own.applied(signal(spark, sf_dir))], feedback.Transfer.of([0.7310585786]), tap=True)
    both = ports["sum", "out"].join(tap.withColumnRenamed("value", "tap"), ["stream_id", "idx"])
    return both.select("stream_id", "idx", r6("value", "value"), r6("tap", "tap"))


@query(f"{RECURSIVE}, r AS ({recursion_sql([1.0, 0.2345678912], [1.0, 0.0, 0.0, -0.5123456789])}) SELECT stream_id, idx, round(y0, 6) + 0.0 AS value FROM r")
def feedback_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum of a filtered stream and about half of its own output through a delay of two samples and the loop's one."""
    loop = feedback.Transfer.delay(2).then(feedback.Transfer.of([0.5123456789]))
    return rounded(feedback.feedback_merge([signal(spark, sf_dir)], loop, [feedback.Transfer.of([1.0, 0.2345678912])]), "value")


@query(
    STREAM
    + """, m AS (SELECT *, CASE WHEN event_type = 'click' THEN idx END AS mark FROM s),
f AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS anchor FROM m)
SELECT stream_id, idx, round(CASE WHEN anchor IS NULL THEN 0 WHEN idx - anchor > 6 THEN 1 ELSE 1 + 2 * sin(2 * pi() * 0.15 * (idx - anchor) + 0.3) END, 6) + 0.0 AS value FROM f"""
)
def tone_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tone that every click starts again, of six samples."""
    rows = indexed(spark, sf_dir)
    zero = [F.lit(0.0).alias(c) for c in ("round_off_time", "impulse_time0", "impulse_time1")]
    seg = rows.filter("event_type = 'click'").select("stream_id", "idx", F.lit("Sin").alias("kind"), F.lit(1.0).alias("start_value"), F.lit(2.0).alias("final_value"), F.lit(6.0).alias("duration"), *zero, F.lit(0.15).alias("frequency"), F.lit(0.3).alias("phase"))
    return rounded(generators.function_generator(rows, seg, 1.0), "value")


@query(
    STREAM
    + """, m AS (SELECT *, CASE WHEN value >= 100 THEN 1 WHEN value <= 40 THEN 0 END AS mark FROM s), k AS (SELECT stream_id, idx, mark FROM m WHERE mark IS NOT NULL),
t AS (SELECT *, lag(mark) OVER w AS was, lag(idx) OVER w AS since FROM k WINDOW w AS (PARTITION BY stream_id ORDER BY idx)), z AS (SELECT stream_id, min(idx) AS low FROM k WHERE mark = 0 GROUP BY stream_id),
e AS (SELECT stream_id, idx AS edge, mark, least(greatest(idx - since, 2), 16) AS n FROM t JOIN z USING (stream_id) WHERE mark <> was AND idx > low),
r AS (SELECT stream_id, edge, mark, regr_slope(value, idx - edge) AS slope, regr_intercept(value, idx - edge) AS level FROM e JOIN s USING (stream_id) WHERE s.idx > edge - n AND s.idx <= edge GROUP BY stream_id, edge, mark)
SELECT stream_id, edge AS idx, CASE WHEN mark = 1 THEN 'RISING' ELSE 'FALLING' END AS edge, round((70 - level) / slope, 5) + 0.0 AS trigger_offset FROM r"""
)
def schmitt_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at the line through the samples between 40 and 100, at 70."""
    found = recursive.schmitt_regression(signal(spark, sf_dir), 70.0, 30.0)
    # values in cents put offsets on ties of the fifth place: rounded as SQL rounds a double, by the product with 10**5
    return found.select("stream_id", "idx", "edge", (F.round(F.col("trigger_offset") * 1e5, 0) / 1e5 + F.lit(0.0)).alias("trigger_offset"))
