"""Queries against their SQL in DuckDB, and what they do not show of their operators."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sampleweave.operators import align, monitor, recursive
from sampleweave.operators.frequency import from_neighbours
from sampleweave.plans import block_queries, registry
from sampleweave.plans.graph import Graph
from sampleweave.plans.sources_of_queries import signal
from sampleweave.sources import generators

SF = "/root/testdata/sf0.001"
OWN = [n for n, f in registry.QUERIES.items() if f.__module__ == block_queries.__name__] + ["iir_butterworth", "dataset_symmetric_filter", "fft_blocks", "settings_asof", "counting_sink"]


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        found.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return found


@pytest.mark.parametrize("name", OWN)
def test_against_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    asked = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in asked.fetchall()), key=str)


def test_merged_datasets_of_unequal_lengths(spark, tmp_path):
    """Streams that end before the fortieth sample, one without any value, one without a neighbour, ids below zero and null."""
    path, found = f"{tmp_path}/events.parquet", duckdb.connect()
    found.execute(f"""COPY (SELECT u * 100 + k AS event_id, TIMESTAMP '2024-01-01' + to_seconds(k) AS ts, u AS user_id, 'view' AS event_type, CASE WHEN k % 7 <> 3 AND u IS DISTINCT FROM 7 THEN (k * 37 % 101) / 4.0 + coalesce(u, 50) END::DOUBLE AS value
        FROM (VALUES (0, 45), (1, 12), (2, 39), (3, 60), (4, 5), (6, 40), (7, 40), (99998, 41), (99999, 44), (100000, 9), (-3, 50), (-2, 41), (NULL, 6)) t(u, n), range(n) r(k)) TO '{path}' (FORMAT parquet)""")
    found.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    rows = lambda r: {x[0]: (x[1], *x[2:]) for x in r}
    got = rows((r["pair"], r["n"], r["sums"], r["length"]) for r in entry.queries()["merged_datasets"](spark, str(tmp_path)).collect())
    want = rows((pair, n, sums, length) for pair, n, length, sums in found.execute(entry.oracle_sql()["merged_datasets"]).fetchall())
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    # of signals with unequal lengths the SQL leaves open whose it tells: here the first one's
    assert {k: v[2] for k, v in got.items()} == {k: v[2] for k, v in want.items()} | {0: 40, 1: 39}


def test_delivered_datasets_with_nulls(spark, tmp_path):
    """Streams with some values missing on either side of the mean, and one with none."""
    path, found = f"{tmp_path}/events.parquet", duckdb.connect()
    found.execute(f"""COPY (SELECT u * 100 + k AS event_id, TIMESTAMP '2024-01-01' + to_seconds(k) AS ts, u AS user_id, 'view' AS event_type, CASE WHEN k % 3 <> 1 AND u <> 4 THEN u * 20.0 + k END::DOUBLE AS value
        FROM range(6) t(u), range(5 + u) r(k)) TO '{path}' (FORMAT parquet)""")
    found.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    assert [tuple(r) for r in entry.queries()["delivered_datasets"](spark, str(tmp_path)).collect()] == found.execute(entry.oracle_sql()["delivered_datasets"]).fetchall()


def test_regression_edges_equal_sql_to_the_last_digit(spark, tmp_path):
    """An offset on a tie of its fifth place, a gap in the samples of a line, a line of one sample, a level line."""
    streams = [[52.16, 22.43, 0.03, 44.05, 28.36, 98.9, 90.1, 15.67, 70.27, 118.27], [30.0, 60.5, None, 80.25, 100.0], [30.0, None, 100.0], [30.0, 96.0, 66.0, 48.0, 102.0]]
    path, found = f"{tmp_path}/events.parquet", duckdb.connect()
    found.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    found.executemany("INSERT INTO events VALUES (?, TIMESTAMP '2024-01-01', ?, 'view', ?)", [(u * 100 + k, u, x) for u, values in enumerate(streams) for k, x in enumerate(values)])
    found.execute(f"COPY events TO '{path}' (FORMAT parquet)")
    columns = ("stream_id", "idx", "edge", "trigger_offset")
    got = sorted(tuple(plain(r[c]) for c in columns) for r in entry.queries()["schmitt_regression"](spark, str(tmp_path)).collect())
    assert got == sorted(tuple(map(plain, r)) for r in found.execute(entry.oracle_sql()["schmitt_regression"]).fetchall())
    assert len(got) >= 4 and (2, 2, "RISING", None) in got and (3, 4, "RISING", -math.inf) in got
    made = recursive.schmitt_regression(signal(spark, str(tmp_path)), 70.0, 30.0).filter("stream_id > 1").collect()
    assert {r["stream_id"]: r["trigger_time"] for r in made} == {2: None, 3: None}


def test_strict_merge_of_axes_that_differ_is_an_error(spark):
    sets = spark.createDataFrame([(0, "a", [0.0, 1.0], [5.0, 6.0]), (0, "b", [0.0], [7.0])], "group long, name string, axis array<double>, values array<double>")
    assert align.merge_datasets(sets, strict=False).first()["axis"] == [0.0, 1.0]
    with pytest.raises(Exception, match="axes of data sets"):
        align.merge_datasets(sets).collect()


def test_as_of_by_buckets(spark):
    draw = np.random.default_rng(2)
    rows = spark.createDataFrame([(int(k), int(t)) for k, t in zip(draw.integers(0, 3, 400), draw.integers(0, 1000, 400))], "k long, t long")
    presets = spark.createDataFrame([(int(k), int(t), float(v)) for k, t, v in zip(draw.integers(0, 2, 30), draw.choice(1000, 30, replace=False), draw.random(30))], "k long, valid_from long, p double")
    plainly = align.as_of(rows, presets, "k", "t", "p").collect()
    assert sorted(map(str, align.as_of(rows, presets, "k", "t", "p", bucket=lambda t: F.floor(t / 70)).collect())) == sorted(map(str, plainly))


def test_ramps_without_round_off_are_lines(spark):
    made = lambda kind: generators.ramp(F.lit(kind), F.col("id") / F.lit(10.0), F.lit(1.0), F.lit(3.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    rows = spark.range(14).select(made("ParabolicRamp").alias("a"), made("LinearRamp").alias("b")).collect()
    assert all(abs(r["a"] - r["b"]) < 1e-12 for r in rows)


def test_frequency_from_neighbours():
    for f in (3.0, 50.4, 240.0):
        assert abs(from_neighbours(2.5 * np.sin(2 * np.pi * f / 1000 * np.arange(300) + 0.7), 1000.0) - f) < 1e-6
    assert from_neighbours(np.zeros(50), 1000.0) is None and from_neighbours(np.ones(50), 1000.0) is None


def test_settings_changes_of_nulls(spark):
    rows = spark.createDataFrame([("s", 0, None, 1.0), ("s", 1, 2.0, 1.0), ("s", 2, 2.0, None)], "stream_id string, idx long, a double, b double")
    got = {(r["idx"], r["name"], r["before"], r["after"]) for r in monitor.settings_changes(rows, ["a", "b"]).collect()}
    assert got == {(0, "a", None, None), (0, "b", None, 1.0), (1, "a", None, 2.0), (2, "b", 1.0, None)}


def test_sum_of_32_ports(spark):
    g = Graph()
    total = g.add("Add32")
    for k in range(32):
        g.connect(g.add("ConstantSource", n_samples_max=3, default_value=float(k)), "out", total, f"in{k}")
    assert [r["value"] for r in g.run(spark, total.name).collect()] == [496.0] * 3


def test_a_fault_in_the_corpus_operators_is_not_hidden(tmp_path, monkeypatch):
    """Only the absence of the subpackage or of the pipeline is accepted."""
    import importlib
    import sys

    (tmp_path / "corpus_pipeline.py").write_text("from sampleweave.no_such_module import x\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    with pytest.raises(ImportError):
        importlib.reload(entry)
    (tmp_path / "corpus_pipeline.py").write_text("raise ModuleNotFoundError('gone', name='sampleweave.llm')\n")
    sys.modules.pop("corpus_pipeline", None)
    assert "range_statistics" in importlib.reload(entry).queries() and "pipeline" not in entry.queries()
    monkeypatch.undo()
    sys.modules.pop("corpus_pipeline", None)
    importlib.reload(entry)
