"""Every query of the library by name, with its SQL oracle where SQL can express it.

Doubles are rounded on both sides, for sums are taken in another order by each engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sampleweave.functions import cplx
from sampleweave.operators import align, elementwise, estimators, power, recursive, select, spectral, trigger, window
from sampleweave.plans.sources_of_queries import STREAM, datasets, indexed, signal, tags

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to six places, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 6) + F.lit(0.0)
    return out.alias(name) if name else out


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(r6(c, c) if c in names else F.col(c) for c in df.columns))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_statistics(spark, sf_dir)


#: Ranges from one event type to another, widened by pre and post, in SQL: the first start after a stop opens, the next stop closes.
RANGES = (
    STREAM
    + """,
m AS (SELECT *, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 0 END AS mark FROM s),
p AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM m),
starts AS (SELECT stream_id, idx AS trigger FROM p WHERE mark = 1 AND coalesce(was, 0) = 0),
stops AS (SELECT stream_id, idx FROM p WHERE mark = 0),
ends AS (SELECT stream_id, max(idx) + 1 AS n FROM s GROUP BY stream_id),
r AS (
    SELECT a.stream_id, a.trigger, greatest(a.trigger - {pre}, 0) AS i_start,
           least(coalesce((SELECT min(b.idx) FROM stops b WHERE b.stream_id = a.stream_id AND b.idx > a.trigger) + {post}, n), n) AS i_end
    FROM starts a JOIN ends USING (stream_id)
)"""
)


@query(
    RANGES.format(pre=0, post=0)
    + """
SELECT r.stream_id, r.trigger, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(max(value), 6) + 0.0 AS maximum, round(stddev_pop(value), 6) + 0.0 AS rms
FROM s JOIN r ON s.stream_id = r.stream_id AND s.idx >= r.i_start AND s.idx < r.i_end GROUP BY r.stream_id, r.trigger"""
)
def range_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the samples between a signup and the next error."""
    found = trigger.segments(tags(spark, sf_dir), "[signup, error]")
    rows = trigger.selected(signal(spark, sf_dir), found)
    return rows.groupBy("stream_id", "trigger").agg(F.count("*").alias("n"), r6(F.avg("value"), "mean"), r6(F.max("value"), "maximum"), r6(F.stddev_pop("value"), "rms"))


@query(
    RANGES.format(pre=2, post=1)
    + """
SELECT DISTINCT s.stream_id, s.idx, value FROM s JOIN r ON s.stream_id = r.stream_id AND s.idx >= r.i_start AND s.idx < r.i_end"""
)
def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trigger.stream_filter(signal(spark, sf_dir), tags(spark, sf_dir), "[signup, error]", 2, 1).select("stream_id", "idx", "value")


@query(
    STREAM
    + """,
e AS (SELECT *, event_type = 'purchase' AS hit FROM s),
t AS (SELECT stream_id, idx AS trigger FROM e WHERE hit)
SELECT t.stream_id, t.trigger, count(*) AS n, round(sum(value), 6) + 0.0 AS total, CAST(min(s.idx) AS BIGINT) AS first_idx
FROM t JOIN s ON s.stream_id = t.stream_id AND s.idx >= greatest(t.trigger - 3, 0) AND s.idx < t.trigger + 4 GROUP BY t.stream_id, t.trigger"""
)
def stream_to_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single triggers with samples before and after, overlapping."""
    made = trigger.stream_to_dataset(signal(spark, sf_dir), tags(spark, sf_dir), "purchase", 3, 4, sample_rate=1.0)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return made.select("stream_id", "trigger", F.size("values").cast("long").alias("n"), r6(total, "total"), (F.col("trigger") + F.array_min("axis").cast("long")).alias("first_idx"))


@query(
    STREAM
    + """
SELECT t.stream_id, t.idx AS seg, s.idx - greatest(t.idx - 2, 0) AS pos, s.value
FROM s t JOIN s ON s.stream_id = t.stream_id AND s.idx >= t.idx - 2 AND s.idx < t.idx + 3 WHERE t.event_type = 'error'"""
)
def sink_triggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = indexed(spark, sf_dir).filter("event_type = 'error'").select("stream_id", "idx")
    return select.triggered(signal(spark, sf_dir), at, 2, 3).select("stream_id", "seg", "pos", "value")


@query(
    STREAM
    + """,
m AS (SELECT *, CASE event_type WHEN 'click' THEN idx WHEN 'view' THEN -1 END AS mark FROM s),
f AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM m)
SELECT stream_id, seg, idx - seg AS pos, value FROM f WHERE seg >= 0 AND idx - seg < 5"""
)
def sink_multiplexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indexed(spark, sf_dir)
    return select.multiplexed(rows, F.col("event_type") == "click", F.col("event_type") == "view", 5).select("stream_id", "seg", "pos", "value")


@query(STREAM + " SELECT t.stream_id, t.idx AS trigger_idx, s.idx, s.value FROM s t JOIN s ON s.stream_id = t.stream_id AND s.idx = t.idx + 2 WHERE t.event_type = 'signup'")
def sink_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = indexed(spark, sf_dir).filter("event_type = 'signup'").select("stream_id", "idx")
    return select.snapshot(signal(spark, sf_dir), at, 2).select("stream_id", "trigger_idx", "idx", "value")


@query("""SELECT event_id, round(value + 2.5, 6) + 0.0 AS added, round(value - 2.5, 6) + 0.0 AS subtracted, round(value * 2.5, 6) + 0.0 AS multiplied, round(value / 2.5, 6) + 0.0 AS divided FROM events""")
def const_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    out = rows
    for name, op in (("added", "add"), ("subtracted", "subtract"), ("multiplied", "multiply"), ("divided", "divide")):
        made = elementwise.with_constant(out.withColumn("kept", F.col("value")), op, 2.5)
        out = made.withColumn(name, r6("value")).withColumn("value", F.col("kept")).drop("kept")
    return out.drop("value")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, round(l_quantity + l_extendedprice + l_tax, 4) + 0.0 AS added,
       round(l_extendedprice - l_quantity - l_discount, 4) + 0.0 AS subtracted, round(l_quantity * l_extendedprice * l_discount, 4) + 0.0 AS multiplied,
       CASE WHEN l_discount = 0 THEN CAST('nan' AS DOUBLE) ELSE round(l_quantity / l_discount, 4) + 0.0 END AS divided FROM lineitem"""
)
def nary_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = rows
    for name, op, ports in (("added", "add", ["l_quantity", "l_extendedprice", "l_tax"]), ("subtracted", "subtract", ["l_extendedprice", "l_quantity", "l_discount"]), ("multiplied", "multiply", ["l_quantity", "l_extendedprice", "l_discount"]), ("divided", "divide", ["l_quantity", "l_discount"])):
        made = elementwise.fold_ports(out, ports, op).withColumn(name, F.round("value", 4) + F.lit(0.0)).drop("value")
        out = made
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "added", "subtracted", "multiplied", "divided")


@query(STREAM + " SELECT a.stream_id, a.idx, round(a.value + b.value * 2, 6) + 0.0 AS value FROM s a JOIN s b ON a.stream_id = b.stream_id + 1 AND a.idx = b.idx")
def sync_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample k of one stream with sample k of its neighbour's, as far as the shorter goes."""
    a = signal(spark, sf_dir)
    b = elementwise.with_constant(a.withColumn("stream_id", F.col("stream_id") + 1), "multiply", 2.0)
    return rounded(elementwise.fold([a, b], "add"), "value")


@query(STREAM + " SELECT stream_id, idx, value FROM s WHERE idx < 10")
def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.head(signal(spark, sf_dir), 10)


@query(STREAM + ", n AS (SELECT stream_id, max(idx) + 1 AS n FROM s GROUP BY stream_id) SELECT s.stream_id, idx // 4 AS idx, value FROM s JOIN n USING (stream_id) WHERE idx % 4 = 0 AND idx < n // 4 * 4")
def decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.decimate(signal(spark, sf_dir), 4)


def _stride_sql(size: int, stride: int) -> str:
    return (
        STREAM
        + f""", n AS (SELECT stream_id, max(idx) + 1 AS n FROM s GROUP BY stream_id),
w AS (SELECT stream_id, unnest(range(0, CASE WHEN n >= {size} THEN (n - {size}) // {stride} + 1 ELSE 0 END)) AS win FROM n)
SELECT w.stream_id, w.win, count(*) AS n, round(sum(value), 6) + 0.0 AS total, round(max(value), 6) + 0.0 AS maximum
FROM w JOIN s ON s.stream_id = w.stream_id AND s.idx >= win * {stride} AND s.idx < win * {stride} + {size} GROUP BY w.stream_id, w.win"""
    )


def _stride(spark: SparkSession, sf_dir: str, size: int, stride: int) -> DataFrame:
    return window.chunk_aggregate(signal(spark, sf_dir), size, {"n": F.count("*"), "total": r6(F.sum("value")), "maximum": r6(F.max("value"))}, stride)


@query(_stride_sql(8, 8))
def stride_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stride(spark, sf_dir, 8, 8)


@query(_stride_sql(8, 3))
def stride_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stride(spark, sf_dir, 8, 3)


@query(_stride_sql(4, 7))
def stride_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stride(spark, sf_dir, 4, 7)


W = "OVER (PARTITION BY stream_id ORDER BY idx"


@query(STREAM + f" SELECT stream_id, idx, round(0.5 * value + 0.3 * coalesce(lag(value, 1) {W}), 0) + 0.2 * coalesce(lag(value, 2) {W}), 0), 6) + 0.0 AS value FROM s")
def fir_3tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(window.fir(signal(spark, sf_dir), [0.5, 0.3, 0.2]), "value")


@query(STREAM + f" SELECT stream_id, idx, round(avg(value) {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS value FROM s")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(window.moving(signal(spark, sf_dir), "mean", 5), "value")


@query(STREAM + f" SELECT stream_id, idx, round(median(value) {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS value FROM s")
def moving_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(window.moving(signal(spark, sf_dir), "median", 5), "value")


@query(STREAM + f" SELECT stream_id, idx, round(stddev_pop(value) {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 5) + 0.0 AS value FROM s")
def moving_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.moving(signal(spark, sf_dir), "rms", 5).withColumn("value", F.round("value", 5) + F.lit(0.0))


@query(STREAM + f" SELECT stream_id, idx, round(max(value) {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - min(value) {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS value FROM s")
def moving_ptp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(window.moving(signal(spark, sf_dir), "ptp", 5), "value")


@query(STREAM + f", d AS (SELECT stream_id, idx - 1 AS idx, value - lag(value) {W}) AS value FROM s) SELECT stream_id, idx, round(value, 6) + 0.0 AS value FROM d WHERE idx >= 0")
def derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(window.derivative(signal(spark, sf_dir)), "value")


@query(
    STREAM
    + f""", m AS (SELECT *, CASE WHEN value >= 100 THEN 1 WHEN value <= 40 THEN 0 END AS mark FROM s),
f AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM m),
e AS (SELECT *, coalesce(lag(state) {W}), 0) AS was FROM f)
SELECT stream_id, idx, CASE WHEN state = 1 THEN 'RISING' ELSE 'FALLING' END AS edge FROM e WHERE state <> was"""
)
def schmitt_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hysteresis at 70 with a threshold of 30."""
    return recursive.schmitt(signal(spark, sf_dir), 70.0, 30.0).select("stream_id", "idx", "edge")


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders),
p AS (SELECT n_nationkey AS k, make_timestamp(694224000000000 + (n_nationkey + 1) * 86400000000 * j * 30) AS valid_from, CAST(j * 10 + n_nationkey AS DOUBLE) AS preset FROM nation, range(1, 4) t(j)),
q AS (SELECT o_orderkey, o_custkey % 25 AS k, o_orderdate FROM o)
SELECT q.o_orderkey, p.preset FROM q ASOF LEFT JOIN p ON q.k = p.k AND q.o_orderdate >= p.valid_from"""
)
def settings_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preset of a context that is valid at a time."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    j = F.explode(F.array(*(F.lit(i) for i in (1, 2, 3))))
    presets = nation.select(F.col("n_nationkey").cast("long").alias("k"), j.alias("j"))
    micros = F.lit(694224000000000) + (F.col("k") + 1) * F.lit(86400000000) * F.col("j") * 30
    presets = presets.select("k", F.timestamp_micros(micros).alias("valid_from"), (F.col("j") * 10 + F.col("k")).cast("double").alias("preset"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_custkey") % 25).alias("k"), F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    return align.as_of(orders, presets, "k", "o_orderdate", "preset", bucket=lambda t: F.trunc(t, "month")).select("o_orderkey", "preset")


@query(
    STREAM
    + """, n AS (SELECT stream_id, count(*) AS n, count(*) FILTER (idx >= 5) AS m FROM s GROUP BY stream_id),
a AS (SELECT s.stream_id, idx * 2 AS idx, value FROM s JOIN n USING (stream_id) WHERE idx < m),
b AS (SELECT s.stream_id, (idx - 5) * 2 + 1 AS idx, -value AS value FROM s JOIN n USING (stream_id) WHERE idx >= 5 AND idx - 5 < m)
SELECT * FROM a UNION ALL SELECT * FROM b"""
)
def selector_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    other = s.filter("idx >= 5").select("stream_id", (F.col("idx") - 5).alias("idx"), (-F.col("value")).alias("value"))
    return select.selector([s, other], [(0, 0), (1, 0)])[0]


@query(
    STREAM
    + """, t AS (SELECT stream_id, idx, CAST(event_type = 'purchase' AS INTEGER) AS f, value FROM s),
c AS (SELECT stream_id, min(idx) AS cut, max(idx) + 1 AS n FROM t WHERE f = 1 GROUP BY stream_id),
k AS (SELECT c.stream_id, cut, e.n FROM c JOIN (SELECT stream_id, max(idx) + 1 AS n FROM s GROUP BY stream_id) e USING (stream_id)),
g AS (SELECT a.stream_id, a.cut AS c0, b.cut AS c1, least(a.cut, b.cut) AS pre, least(a.n - a.cut, b.n - b.cut) AS tail
      FROM k a JOIN k b ON b.stream_id = a.stream_id + 1)
SELECT g.stream_id, 0 AS port, s.idx - c0 + pre AS idx, s.value FROM g JOIN s ON s.stream_id = g.stream_id WHERE s.idx >= c0 - pre AND s.idx < c0 + tail
UNION ALL
SELECT g.stream_id, 1 AS port, s.idx - c1 + pre AS idx, s.value FROM g JOIN s ON s.stream_id = g.stream_id + 1 WHERE s.idx >= c1 - pre AND s.idx < c1 + tail"""
)
def sync_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two neighbouring users' streams as ports, aligned at the first purchase of each."""

    def both(rows: DataFrame) -> DataFrame:
        ways = F.array(*(F.struct((F.col("stream_id") - p).alias("stream_id"), F.lit(p).alias("port")) for p in (0, 1)))
        return rows.withColumn("_p", F.explode(ways)).select("_p.*", *(c for c in rows.columns if c != "stream_id"))

    ports = both(signal(spark, sf_dir))
    marks = both(indexed(spark, sf_dir).filter("event_type = 'purchase'").groupBy("stream_id").agg(F.min("idx").alias("idx")))
    marks = marks.withColumn("name", F.lit("purchase")).withColumn("time", F.lit(1000))
    return align.sync_block(ports, marks, 2, 5)[0]


DS = STREAM + ", d AS (SELECT stream_id AS ds, idx, CAST(idx AS DOUBLE) AS x, value AS y FROM s)"


@query(
    DS
    + """ SELECT ds, round(max(y), 6) + 0.0 AS maximum, arg_max(idx, struct_pack(y := y, i := -idx)) AS maximum_idx, round(min(y), 6) + 0.0 AS minimum,
arg_min(idx, struct_pack(y := y, i := idx)) AS minimum_idx, round(avg(y), 6) + 0.0 AS mean, round(median(y), 6) + 0.0 AS median,
round(max(y) - min(y), 6) + 0.0 AS range, round(stddev_pop(y), 5) + 0.0 AS rms, round(sum(x * y) / sum(y), 6) + 0.0 AS centre_of_mass FROM d GROUP BY ds"""
)
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = estimators.statistics(datasets(spark, sf_dir)).withColumn("rms", F.round("rms", 5) + F.lit(0.0))
    return rounded(made, "maximum", "minimum", "mean", "median", "range", "centre_of_mass")


@query(DS + ", t AS (SELECT ds, (lead(x) OVER w - x) * (lead(y) OVER w + y) / 2 AS part FROM d WINDOW w AS (PARTITION BY ds ORDER BY idx)) SELECT ds, round(coalesce(sum(part), 0), 5) + 0.0 AS integral FROM t GROUP BY ds")
def dataset_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimators.integral(datasets(spark, sf_dir)).select("ds", (F.round("integral", 5) + F.lit(0.0)).alias("integral"))


@query(
    DS
    + """, e AS (SELECT *, min(y) OVER (PARTITION BY ds) AS lo, max(y) OVER (PARTITION BY ds) AS hi FROM d)
SELECT ds, round(count(*) FILTER (y > lo + 0.55 * (hi - lo)) / nullif(count(*) FILTER (y > lo + 0.55 * (hi - lo) OR y < lo + 0.45 * (hi - lo)), 0), 6) + 0.0 AS duty_cycle FROM e GROUP BY ds"""
)
def dataset_duty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimators.duty_cycle(datasets(spark, sf_dir)), "duty_cycle")


@query(
    DS
    + """, e AS (SELECT *, min(y) OVER (PARTITION BY ds) AS lo, max(y) OVER (PARTITION BY ds) AS hi FROM d),
m AS (SELECT *, CASE WHEN y > lo + 0.55 * (hi - lo) THEN 1 WHEN y < lo + 0.45 * (hi - lo) THEN 0 END AS mark FROM e),
f AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY ds ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM m),
c AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY ds ORDER BY idx), 0) AS was FROM f),
p AS (SELECT ds, x - lag(x) OVER (PARTITION BY ds, state ORDER BY idx) AS period FROM c WHERE state <> was)
SELECT q.ds, coalesce(round(count(period) / sum(period), 6) + 0.0, CAST('nan' AS DOUBLE)) AS frequency FROM (SELECT DISTINCT ds FROM d) q LEFT JOIN p ON p.ds = q.ds GROUP BY q.ds"""
)
def dataset_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimators.frequency_estimate(datasets(spark, sf_dir)), "frequency")


@query(
    DS
    + """, e AS (SELECT *, lag(y) OVER w AS y0, lag(x) OVER w AS x0, first_value(y) OVER w AS f FROM d WINDOW w AS (PARTITION BY ds ORDER BY idx)),
h AS (SELECT *, y0 IS NOT NULL AND CASE WHEN f < 60 THEN y >= 60 ELSE y <= 60 END AS hit FROM e)
SELECT ds, round(coalesce(arg_min(CASE WHEN y = y0 THEN x0 ELSE x0 + (x - x0) * (60 - y0) / (y - y0) END, idx) FILTER (hit), arg_max(y, idx)), 6) + 0.0 AS crossing FROM h GROUP BY ds"""
)
def dataset_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimators.zero_crossing(datasets(spark, sf_dir), 60.0), "crossing")


@query(
    DS
    + """, e AS (SELECT *, min(y) OVER p AS lo, max(y) OVER p AS hi, arg_min(y, idx) OVER p AS f, arg_max(y, idx) OVER p AS l, arg_min(x, idx) OVER p AS x0 FROM d WINDOW p AS (PARTITION BY ds))
SELECT ds, coalesce(round(arg_min(x - x0, idx) FILTER (hi > lo AND CASE WHEN f > l THEN y < (hi + lo) / 2 ELSE y > (hi + lo) / 2 END), 6) + 0.0, CAST('nan' AS DOUBLE)) AS edge_time FROM e GROUP BY ds"""
)
def dataset_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimators.edge_time(datasets(spark, sf_dir)), "edge_time")


@query(
    DS
    + """, e AS (SELECT *, max(y) OVER (PARTITION BY ds) AS hi, min(y) OVER (PARTITION BY ds) AS lo, arg_min(y, idx) OVER (PARTITION BY ds) AS f FROM d)
SELECT ds, coalesce(min(idx) FILTER (hi > f AND y >= f + 0.5 * (hi - f)), min(idx) FILTER (lo < f AND y <= f - 0.5 * (f - lo))) AS step_idx FROM e GROUP BY ds"""
)
def dataset_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimators.step_start(datasets(spark, sf_dir))


@query(
    DS
    + """, e AS (SELECT *, lag(y) OVER w AS l, lead(y) OVER w AS r, lead(x) OVER w AS x1, row_number() OVER (PARTITION BY ds ORDER BY y DESC, idx) AS k FROM d WINDOW w AS (PARTITION BY ds ORDER BY idx))
SELECT ds, CASE WHEN x1 IS NULL THEN CAST('nan' AS DOUBLE) ELSE round(x + CASE WHEN l > 0 AND r > 0 AND y > 0 AND y * y <> l * r THEN 0.5 * ln(r / l) / ln(y * y / (l * r)) ELSE 0 END * (x1 - x), 6) + 0.0 END AS location FROM e WHERE k = 1"""
)
def dataset_gauss_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimators.gauss_maximum(datasets(spark, sf_dir)), "location")


@query(
    DS
    + """, a AS (SELECT ds, x, y FROM d), b AS (SELECT ds, x + 0.5 AS x, 2 * y AS y, lead(x + 0.5) OVER w AS x1, lead(2 * y) OVER w AS y1, row_number() OVER w AS k FROM d WINDOW w AS (PARTITION BY ds ORDER BY idx)),
f AS (SELECT ds, y FROM b WHERE k = 1),
j AS (SELECT a.ds, a.x, a.y, b.x AS bx, b.y AS by0, b.x1, b.y1 FROM a ASOF LEFT JOIN b ON a.ds = b.ds AND a.x >= b.x)
SELECT j.ds, j.x, round(j.y + CASE WHEN bx IS NULL THEN f.y WHEN x1 IS NULL OR bx = j.x THEN by0 ELSE by0 + (y1 - by0) * (j.x - bx) / (x1 - bx) END, 6) + 0.0 AS y FROM j JOIN f USING (ds)"""
)
def dataset_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two data sets on different axes, the second interpolated."""
    d = datasets(spark, sf_dir)
    a = d.select("ds", "x", "y")
    b = d.select("ds", (F.col("x") + 0.5).alias("x"), (2 * F.col("y")).alias("y"))
    return rounded(align.dataset_operation(a, b, "ADD"), "y")


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) + 0.0 AS p, round(sqrt(sum(l_quantity * l_quantity)) * sqrt(sum(l_tax * l_tax)), 4) + 0.0 AS s,
round(greatest(-1, least(1, sum(l_quantity * l_tax) / (sqrt(sum(l_quantity * l_quantity)) * sqrt(sum(l_tax * l_tax))))), 6) + 0.0 AS power_factor,
round(acos(greatest(-1, least(1, sum(l_quantity * l_tax) / (sqrt(sum(l_quantity * l_quantity)) * sqrt(sum(l_tax * l_tax)))))), 5) + 0.0 AS phase
FROM lineitem GROUP BY l_returnflag, l_linestatus"""
)
def power_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("total"), F.sum(F.col("l_quantity") * F.col("l_tax")).alias("P"), (F.sqrt(F.sum(F.col("l_quantity") ** 2)) * F.sqrt(F.sum(F.col("l_tax") ** 2))).alias("S"))
    factor, phase = power.power_factor(F.col("P"), F.col("S"))
    return rows.select("l_returnflag", "l_linestatus", (F.round("total", 2) + F.lit(0.0)).alias("p"), (F.round("S", 4) + F.lit(0.0)).alias("s"), r6(factor, "power_factor"), (F.round(phase, 5) + F.lit(0.0)).alias("phase"))


@query(
    """WITH a AS (SELECT c_nationkey, avg(c_acctbal) FILTER (c_custkey % 3 = 0) AS x, avg(c_acctbal) FILTER (c_custkey % 3 = 1) AS y, avg(c_acctbal) FILTER (c_custkey % 3 = 2) AS z FROM customer GROUP BY c_nationkey),
m AS (SELECT *, (x + y + z) / 3 AS mean FROM a)
SELECT c_nationkey, round(x + y + z, 4) + 0.0 AS total, CASE WHEN mean > 0 THEN round(100 * greatest(abs(x - mean), abs(y - mean), abs(z - mean)) / mean, 4) + 0.0 ELSE 0.0 END AS unbalance FROM m WHERE mean IS NOT NULL"""
)
def unbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    phases = rows.groupBy("c_nationkey").agg(*(F.avg(F.when(F.col("c_custkey") % 3 == k, F.col("c_acctbal"))).alias(n) for k, n in enumerate("xyz")))
    made = phases.dropna().select("c_nationkey", (F.col("x") + F.col("y") + F.col("z")).alias("total"), power.unbalance([F.col("x"), F.col("y"), F.col("z")]).alias("unbalance"))
    return made.select("c_nationkey", (F.round("total", 4) + F.lit(0.0)).alias("total"), (F.round("unbalance", 4) + F.lit(0.0)).alias("unbalance"))


@query(
    STREAM
    + """, n AS (SELECT stream_id, max(idx) + 1 AS n FROM s GROUP BY stream_id),
c AS (SELECT s.stream_id, idx // 16 AS win, idx % 16 AS pos, value * (0.5 - 0.5 * cos(2 * pi() * (idx % 16) / 15)) AS x FROM s JOIN n USING (stream_id) WHERE idx < n // 16 * 16),
b AS (SELECT c.*, k AS bin FROM c, range(0, 8) t(k)),
z AS (SELECT stream_id, win, bin, sum(x * cos(-2 * pi() * bin * pos / 16)) AS re, sum(x * sin(-2 * pi() * bin * pos / 16)) AS im FROM b GROUP BY stream_id, win, bin)
SELECT stream_id, win, CAST(bin AS INTEGER) AS bin, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im, round(sqrt(re * re + im * im) * 2 / 16, 5) + 0.0 AS magnitude FROM z"""
)
def dft_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = spectral.dft(signal(spark, sf_dir), 16, "Hann")
    z = z.withColumn("magnitude", spectral.magnitude(F.col("re"), F.col("im"), 16))
    return z.select("stream_id", "win", "bin", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("re", "im", "magnitude")))


@query(
    STREAM
    + """, z AS (SELECT stream_id, idx, value AS re, coalesce(lag(value) OVER (PARTITION BY stream_id ORDER BY idx), 0) AS im FROM s)
SELECT stream_id, idx, round(sqrt(re * re + im * im), 6) + 0.0 AS mag, round(atan2(im, re), 6) + 0.0 AS phase,
round(re * cos(0.1 * (idx + 1)) - im * sin(0.1 * (idx + 1)), 5) + 0.0 AS rotated_re, round(re * sin(0.1 * (idx + 1)) + im * cos(0.1 * (idx + 1)), 5) + 0.0 AS rotated_im FROM z"""
)
def complex_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("stream_id").orderBy("idx")
    z = signal(spark, sf_dir).select("stream_id", "idx", cplx.complex_(F.col("value"), F.coalesce(F.lag("value").over(w), F.lit(0.0))).alias("value"))
    parts = elementwise.rotator(z.withColumn("z", F.col("value")), phase_increment=0.1).withColumnRenamed("value", "turned").withColumnRenamed("z", "value")
    return parts.select("stream_id", "idx", r6(cplx.magnitude(F.col("value")), "mag"), r6(cplx.arg(F.col("value")), "phase"), (F.round("turned.re", 5) + F.lit(0.0)).alias("rotated_re"), (F.round("turned.im", 5) + F.lit(0.0)).alias("rotated_im"))


from sampleweave.plans import kernel_queries as _kernel_queries  # noqa: E402, F401  (registers its queries)
from sampleweave.plans import block_queries as _block_queries  # noqa: E402, F401  (registers its queries)
from sampleweave.plans import device_queries as _device_queries  # noqa: E402, F401  (registers its queries)
