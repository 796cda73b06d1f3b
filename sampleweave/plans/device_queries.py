"""Queries of clocks, devices, files and the filters of uncertain values, and oracles of queries that had none."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleweave.operators import align, design, monitor, power, recursive, select, timing
from sampleweave.plans.block_queries import RECURSIVE, plainly, recursion_sql
from sampleweave.plans.graph import Graph
from sampleweave.plans.registry import ORACLES, STREAM, query, r6, rounded
from sampleweave.plans.sources_of_queries import signal, tags
from sampleweave.sources import files, loopback

_B, _A = plainly(design.iir_design("LOWPASS", 2, 0.1))


def of(tables: str, source: str, made: str) -> str:
    """recursion_sql over another source table, under another name."""
    return tables.replace("FROM s ", f"FROM {source} s ").replace("JOIN s ", f"JOIN {source} s ").replace("FROM s z", f"FROM {source} z").replace("FROM r JOIN", f"FROM {made} r JOIN")


# the sum of squares of the impulse response up to a sample is the variance that unit uncertainties come to there
ORACLES["uncertain_filter"] = (
    f"{RECURSIVE}, r AS ({recursion_sql(_B, _A)}), u AS (SELECT 0 AS stream_id, i AS idx, CASE WHEN i = 0 THEN 1.0 ELSE 0.0 END AS value FROM range((SELECT max(idx) + 1 FROM s)) t(i)), "
    f"h AS ({of(recursion_sql(_B, _A), 'u', 'h')}), v AS (SELECT idx, sqrt(sum(y0 * y0) OVER (ORDER BY idx)) AS spread FROM h) "
    "SELECT stream_id, idx, round(y0, 6) + 0.0 AS value, round(spread, 6) + 0.0 AS uncertainty FROM r JOIN v USING (idx)"
)

# a start is the first tag behind a run of views; of the other tags, a stop is the first behind a run of clicks
ORACLES["trigger_after"] = (
    STREAM
    + """, m AS (SELECT *, coalesce(event_type <> 'view' AND lag(event_type) OVER (PARTITION BY stream_id ORDER BY idx) = 'view', false) AS starts FROM s),
k AS (SELECT stream_id, idx, event_type <> 'click' AND lag(event_type) OVER (PARTITION BY stream_id ORDER BY idx) = 'click' AS stops FROM m WHERE NOT starts),
e AS (SELECT stream_id, idx, true AS opens FROM m WHERE starts UNION ALL SELECT stream_id, idx, false FROM k WHERE stops),
f AS (SELECT *, lag(opens) OVER w AS was, min(CASE WHEN NOT opens THEN idx END) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS until FROM e WINDOW w AS (PARTITION BY stream_id ORDER BY idx))
SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY idx) - 1 AS seg, idx AS i_start, coalesce(until, 4611686018427387904) AS i_end FROM f WHERE opens AND NOT coalesce(was, false)"""
)

ORACLES["drift_compensation"] = (
    STREAM
    + """, n AS (SELECT stream_id, max(idx) + 1 AS n FROM s GROUP BY stream_id), k AS (SELECT stream_id, n, unnest(range(0, CAST(n / 1.02 AS BIGINT) + 2)) AS k FROM n),
p AS (SELECT stream_id, n, k, least(CAST(floor(k * 1.02) AS BIGINT), greatest(n - 2, 0)) AS i, k * CAST(1.02 AS DOUBLE) AS place FROM k WHERE k * 1.02 <= n - 1 + 1e-9),
v AS (SELECT p.*, place - i AS u, a.value AS p0, b.value AS p1, c.value AS p2, d.value AS p3 FROM p JOIN s a ON a.stream_id = p.stream_id AND a.idx = greatest(i - 1, 0) JOIN s b ON b.stream_id = p.stream_id AND b.idx = i
    JOIN s c ON c.stream_id = p.stream_id AND c.idx = least(i + 1, n - 1) JOIN s d ON d.stream_id = p.stream_id AND d.idx = least(i + 2, n - 1))
SELECT stream_id, k AS idx, round(CASE WHEN n < 4 THEN p1 * (1 - u) + p2 * u ELSE (2 * u * u * u - 3 * u * u + 1) * p1 + (u * u * u - 2 * u * u + u) * (p2 - p0) / 2 + (3 * u * u - 2 * u * u * u) * p2 + (u * u * u - u * u) * (p3 - p1) / 2 END, 6) + 0.0 AS value FROM v"""
)


@query(
    f"{RECURSIVE}, r AS ({recursion_sql(_B, _A)}), e AS (SELECT stream_id, idx, value * value AS value FROM s), q AS ({of(recursion_sql(_B, _A), 'e', 'q')}) "
    "SELECT stream_id, idx, round(r.y0, 6) + 0.0 AS value, round(sqrt(abs(q.y0 - r.y0 * r.y0)), 6) + 0.0 AS uncertainty FROM r JOIN q USING (stream_id, idx)"
)
def error_propagating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered values with the scatter that the filter sees."""
    made = recursive.error_propagating(signal(spark, sf_dir), *design.iir_design("LOWPASS", 2, 0.1))
    return made.select("stream_id", "idx", r6("value.value", "value"), r6("value.uncertainty", "uncertainty"))


_HB, _HA = plainly(design.iir_design("HIGHPASS", 2, 2.0, 25.0, 100.0))
_LB, _LA = plainly(design.iir_design("LOWPASS", 2, 5.0, 25.0, 100.0))


@query(
    f"{RECURSIVE}, c AS (SELECT {{'s': stream_id, 'c': c}} AS stream_id, idx, CASE c WHEN 'u' THEN value ELSE value - idx % 7 END AS value FROM s, (VALUES ('u'), ('i')) t(c)), "
    f"h AS ({of(recursion_sql(_HB, _HA), 'c', 'h')}), g AS MATERIALIZED (SELECT u.stream_id.s AS stream_id, u.idx, u.y0 AS u, i.y0 AS i FROM h u JOIN h i ON u.stream_id.s = i.stream_id.s AND u.idx = i.idx AND u.stream_id.c = 'u' AND i.stream_id.c = 'i'), "
    "p AS (SELECT {'s': stream_id, 'c': c} AS stream_id, idx, CASE c WHEN 'p' THEN u * i WHEN 'u' THEN u * u ELSE i * i END AS value FROM g, (VALUES ('p'), ('u'), ('i')) t(c)), "
    f"l AS ({of(recursion_sql(_LB, _LA), 'p', 'l')}), "
    "w AS (SELECT stream_id.s AS stream_id, idx, max(CASE WHEN stream_id.c = 'p' THEN y0 END) AS p, sqrt(greatest(max(CASE WHEN stream_id.c = 'u' THEN y0 END), 0)) AS u, sqrt(greatest(max(CASE WHEN stream_id.c = 'i' THEN y0 END), 0)) AS i FROM l WHERE idx % 4 = 0 GROUP BY ALL) "
    'SELECT stream_id, idx // 4 AS idx, round(p, 5) + 0.0 AS "P", round(u * i, 5) + 0.0 AS "S", round(u, 5) + 0.0 AS u_rms, round(i, 5) + 0.0 AS i_rms FROM w'
)
def power_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active and apparent power of every stream, its values as a voltage and those less a saw as a current."""
    rows = signal(spark, sf_dir).select("stream_id", "idx", F.col("value").alias("u"), (F.col("value") - F.col("idx") % 7).alias("i"))
    made = power.power_metrics(rows, 100.0, 2.0, 5.0, 4)
    return made.select("stream_id", "idx", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("P", "S", "u_rms", "i_rms")))


@query(
    STREAM
    + """, c AS (SELECT *, idx // 32 AS c, count(*) OVER (PARTITION BY stream_id, idx // 32) AS n FROM s), z AS (SELECT DISTINCT stream_id, c, n, CASE WHEN n < 2 THEN n ELSE CAST(floor(n / 0.95 + 0.5) AS BIGINT) END AS m FROM c),
k AS (SELECT *, unnest(range(0, m)) AS k FROM z), p AS (SELECT *, CASE WHEN n = m THEN k + 0.0 ELSE k * CAST(n - 1 AS DOUBLE) / greatest(1, m - 1) END AS place FROM k), q AS (SELECT *, c * 32 AS o, CAST(floor(place) AS BIGINT) AS i, place - floor(place) AS t FROM p),
v AS (SELECT q.*, y0.value AS y0, y1.value AS y1, y2.value AS y2, y3.value AS y3 FROM q JOIN s y0 ON y0.stream_id = q.stream_id AND y0.idx = o + greatest(i - 1, 0) JOIN s y1 ON y1.stream_id = q.stream_id AND y1.idx = o + least(i, n - 1)
    JOIN s y2 ON y2.stream_id = q.stream_id AND y2.idx = o + least(i + 1, n - 1) JOIN s y3 ON y3.stream_id = q.stream_id AND y3.idx = o + least(i + 2, n - 1))
SELECT stream_id, c * 34 + k AS idx, round((((1.5 * y1 - 0.5 * y0 - 1.5 * y2 + 0.5 * y3) * t + (y0 - 2.5 * y1 + 2 * y2 - 0.5 * y3)) * t + (y2 - y0) / 2) * t + y1, 6) + 0.0 AS value FROM v"""
)
def drift_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 32 samples spread over 34."""
    made = timing.adaptively_resampled(signal(spark, sf_dir), 95.0, 100.0, 32)
    # short chunks put values on ties of the sixth place: rounded as SQL rounds a double, by the product with 10**6
    return made.withColumn("value", F.round(F.col("value") * 1e6, 0) / 1e6 + F.lit(0.0))


@query(
    RECURSIVE
    + """, z AS (SELECT stream_id, idx // 16 AS c, count(*) AS n FROM s GROUP BY ALL),
a AS (SELECT stream_id, c, n, greatest(n * -0.03, -2.0) AS raw FROM z WHERE c = 0
    UNION ALL SELECT z.stream_id, z.c, z.n, greatest(CASE WHEN a.raw <= -1 AND a.n >= 2 THEN a.raw + 1 ELSE a.raw END + z.n * -0.03, -2.0) FROM a JOIN z ON z.stream_id = a.stream_id AND z.c = a.c + 1),
b AS (SELECT *, raw <= -1 AND n >= 2 AS less FROM a), o AS (SELECT *, sum(CASE WHEN less THEN n - 1 ELSE n END) OVER (PARTITION BY stream_id ORDER BY c) - CASE WHEN less THEN n - 1 ELSE n END AS start FROM b),
p AS (SELECT s.*, lead(value) OVER (PARTITION BY s.stream_id ORDER BY idx) AS next, o.start, o.n, o.less, idx % 16 AS pos FROM s JOIN o ON o.stream_id = s.stream_id AND o.c = idx // 16)
SELECT stream_id, CAST(start + pos AS BIGINT) AS idx, round(CASE WHEN less AND pos = n - 2 THEN (value + next) / 2 ELSE value END, 6) + 0.0 AS value FROM p WHERE NOT (less AND pos = n - 1)"""
)
def drift_spliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clock 3 % slow: chunks of 16 lose a sample whenever a whole one has added up."""
    return rounded(timing.spliced(signal(spark, sf_dir), 97.0, 100.0, 16), "value")


@query(
    STREAM
    + """, n AS (SELECT stream_id, max(idx) AS last FROM s GROUP BY stream_id), z AS (SELECT stream_id, unnest(range(0, least(last, 2) + 1)) AS idx, 0.0 AS re FROM n)
SELECT stream_id, idx, re, 0.0 AS im FROM z UNION ALL SELECT stream_id, idx + 3, round(value / 1000 * pow(10, -0.3), 6) + 0.0, round(-value / 1000 * pow(10, -0.3), 6) + 0.0 FROM s JOIN n USING (stream_id) WHERE idx + 3 <= last"""
)
def loopback_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complex samples through a channel that weakens them by 6 dB and is three samples late."""
    part = F.col("value") / 1000
    sent = signal(spark, sf_dir).select("stream_id", "idx", F.struct(part.alias("re"), (-part).alias("im")).alias("value"))
    radio = loopback.Loopback(2)
    radio.model(1, loopback.chained([loopback.attenuation(-6.0), loopback.delay(3)]))
    return radio.received(1, sent).select("stream_id", "idx", r6("value.re", "re"), r6("value.im", "im"))


@query(STREAM + " SELECT stream_id, idx, CAST(least(greatest(round(value / 500 * 32767), -32768), 32767) AS INTEGER) AS cs16, CAST(least(greatest(round(value / 500 * 127.5 + 127.5), 0), 255) AS INTEGER) AS cu8 FROM s")
def device_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integers that two device formats send for a sample."""
    part = F.col("value") / 500
    rows = signal(spark, sf_dir).select("stream_id", "idx", F.struct(part.alias("re"), part.alias("im")).alias("v"))
    return rows.select("stream_id", "idx", loopback.to_format(F.col("v"), "CS16")["re"].alias("cs16"), loopback.to_format(F.col("v"), "CU8")["re"].alias("cu8"))


def scratch(spark: SparkSession) -> str:
    """A new folder for files that are read back: in the shared folder of the cluster, or on this machine where Spark runs in it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return f"file://{tempfile.mkdtemp()}"


@query(STREAM + ", n AS (SELECT stream_id, max(idx) + 1 AS n FROM s GROUP BY stream_id) SELECT stream_id, idx + r * n AS idx, value FROM s JOIN n USING (stream_id), range(2) t(r)")
def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams as raw compressed files of doubles, read back twice over."""
    folder = scratch(spark)
    files.binary_sink(signal(spark, sf_dir), folder, "float64", compress=True).write.format("noop").mode("overwrite").save()
    read = files.binary_source(spark, f"{folder}/*.bin.gz", "float64", compressed=True, repeat=2)
    return read.select(F.regexp_extract("stream_id", r"([^/]+)-\d+\.bin\.gz$", 1).cast("long").alias("stream_id"), "idx", "value")


@query(STREAM + " SELECT stream_id, idx, CAST(least(greatest(round_even(value / 1000 * 32767, 0), -32768), 32767) / 32768 AS DOUBLE) AS value, CAST(8000 AS DOUBLE) AS sample_rate FROM s")
def wav_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams as WAV files of 16 bits, read back."""
    folder = scratch(spark)
    files.wav_sink(signal(spark, sf_dir).withColumn("value", F.col("value") / 1000), folder, 8000, True).write.format("noop").mode("overwrite").save()
    read = files.wav_source(spark, f"{folder}/*.wav")
    return read.select(F.regexp_extract("stream_id", r"([^/]+)-\d+\.wav#0$", 1).cast("long").alias("stream_id"), "idx", "value", "sample_rate")


@query(
    STREAM
    + """, t AS (SELECT stream_id, count(*) AS n_tags, min(idx) AS first_tag, max(idx) AS last_tag FROM s WHERE event_type = 'error' GROUP BY stream_id), n AS (SELECT stream_id, count(*) AS n FROM s GROUP BY stream_id)
SELECT stream_id, n, coalesce(n_tags, 0) AS n_tags, first_tag, last_tag, n = 64 AS complete FROM n LEFT JOIN t USING (stream_id)"""
)
def tag_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and errors that reached the end of each stream."""
    return monitor.tag_sink(signal(spark, sf_dir), tags(spark, sf_dir).filter("name = 'error'"), 64)


@query(STREAM + " SELECT stream_id, idx // 32 AS part, list(value ORDER BY idx) AS values FROM s GROUP BY ALL")
def vector_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.vectors(signal(spark, sf_dir), 32)


@query(
    STREAM
    + """ SELECT stream_id, 0 AS port, idx, value FROM s WHERE idx < 40 UNION ALL SELECT stream_id, 1, idx // 3, value FROM s WHERE idx % 3 = 0 AND idx // 3 < 40"""
)
def ports_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ports that do not wait for one another, both ended by the one that stops after 40 samples."""
    rows = signal(spark, sf_dir)
    ports = select.stopped([rows, select.decimate(rows, 3, keep_rest=True)], [40, None])
    return align.async_ports(ports)


@query(STREAM + " SELECT stream_id, max_by(value * 3 + value * 2, idx) AS last_value, count(*) AS n FROM s GROUP BY stream_id")
def graph_of_demo_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A duplicate, two factors and an adder, up to a sink that tells the last value and the count."""
    g = Graph()
    blocks = [g.add("duplicate"), g.add("scale", scale=3.0), g.add("builtin_multiply", factor=2.0), g.add("adder"), g.add("ExpectSink")]
    g.export("in", blocks[0], "in")
    for a, out, b, to in ((0, "out0", 1, "original"), (0, "out1", 2, "in"), (1, "out", 3, "addend0"), (2, "out", 3, "addend1"), (3, "out", 4, "sink")):
        g.connect(blocks[a], out, blocks[b], to)
    return g.run(spark, blocks[4].name, **{"in": signal(spark, sf_dir)})
