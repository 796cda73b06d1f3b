"""Operators over nested data sets: one row each, with axis and values as arrays. Array work without feedback is column
expressions; filters run as Arrow functions over the rows, a data set at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleweave.operators.estimators import signal_range
from sampleweave.operators.recursive import Recursion
from sampleweave.operators.window import savgol_zero_phase


def nested(rows: DataFrame) -> DataFrame:
    """(ds, axis, values) of rows (ds, idx, x, y)."""
    made = rows.groupBy("ds").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y"))).alias("_r"))
    return made.select("ds", F.transform("_r", lambda r: r["x"]).alias("axis"), F.transform("_r", lambda r: r["y"]).alias("values"))


def unnested(sets: DataFrame) -> DataFrame:
    """(ds, idx, x, y) of (ds, axis, values)."""
    return sets.select("ds", F.posexplode(F.arrays_zip("axis", "values"))).select("ds", F.col("pos").cast("long").alias("idx"), F.col("col.axis").alias("x"), F.col("col.values").alias("y"))


def mapped(sets: DataFrame, f: Callable[[np.ndarray], np.ndarray], column: str = "values") -> DataFrame:
    """A function of numpy arrays over an array column; the other columns pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            out = [None if v is None else np.asarray(f(np.asarray(v, float)), float).tolist() for v in batch.column(at).to_pylist()]
            columns = [pa.array(out, pa.list_(pa.float64())) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    fields = [T.StructField(x.name, T.ArrayType(T.DoubleType()) if x.name == column else x.dataType) for x in sets.schema]
    return sets.mapInArrow(run, T.StructType(fields))


def filtered(sets: DataFrame, b: Sequence[float], a: Sequence[float]) -> DataFrame:
    return mapped(sets, lambda v: Recursion(b, a).run(v)[0])


def symmetric_filtered(sets: DataFrame, b: Sequence[float], a: Sequence[float]) -> DataFrame:
    """The mean of a forward and a backward pass over the values as they were."""
    return mapped(sets, lambda v: (Recursion(b, a).run(v)[0] + Recursion(b, a).run(v[::-1])[0][::-1]) / 2)


def savitzky_golay(sets: DataFrame, size: int = 11, order: int = 4, derivative: int = 0, policy: str = "Reflect") -> DataFrame:
    return mapped(sets, lambda v: savgol_zero_phase(v, size, order, derivative, policy=policy))


def with_noise(sets: DataFrame, level: float, seed: int = 0) -> DataFrame:
    """Uniform noise between -level and level, from a seed and the row's place alone."""
    draw = lambda v, i: v + level * (2 * (F.pmod(F.xxhash64(F.lit(seed), F.col("ds"), i), F.lit(1 << 30)) / F.lit(float(1 << 30))) - 1)
    return sets.withColumn("values", F.transform("values", draw))


def with_range(sets: DataFrame) -> DataFrame:
    return sets.withColumn("range", signal_range(F.col("values")))


def part(values: Column, first: int, last: int) -> Column:
    return F.slice(values, first + 1, max(0, last - first))
