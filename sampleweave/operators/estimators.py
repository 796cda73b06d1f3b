"""Estimators over data sets as rows (ds, idx, x, y): one row per data set. Values that are not finite are left out.

Each function takes the rows and the name of the group column. Levels need the extremes first: they come from a window
without frame over the data set, which a shuffle on ds serves together with the aggregate that follows it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleweave.functions.scalars import divided, linear_interpolate
from sampleweave.functions.uncertain import finite


def nan() -> Column:
    return F.lit(float("nan"))


def value() -> Column:
    return F.col("y")



def usable(rows: DataFrame) -> DataFrame:
    return rows.filter(finite(value()))


def statistics(rows: DataFrame) -> DataFrame:
    """maximum and minimum with their first places, mean, median, range, rms (deviation of the population), centre of mass."""
    return usable(rows).groupBy("ds").agg(
        F.max("y").alias("maximum"), F.max_by("idx", F.struct("y", -F.col("idx"))).alias("maximum_idx"),
        F.min("y").alias("minimum"), F.min_by("idx", F.struct("y", "idx")).alias("minimum_idx"),
        F.avg("y").alias("mean"), F.percentile("y", 0.5).alias("median"), (F.max("y") - F.min("y")).alias("range"),
        F.stddev_pop("y").alias("rms"), divided(F.sum(F.col("x") * value()), F.sum("y")).alias("centre_of_mass"),
    )


def integral(rows: DataFrame) -> DataFrame:
    """By trapezoids along the axis."""
    w = Window.partitionBy("ds").orderBy("idx")
    steps = rows.select("ds", ((F.lead("x").over(w) - F.col("x")) * (F.lead("y").over(w) + value()) / 2).alias("part"))
    return steps.groupBy("ds").agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("integral"))


def with_extremes(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("ds")
    return usable(rows).withColumn("_min", F.min("y").over(w)).withColumn("_max", F.max("y").over(w))


def duty_cycle(rows: DataFrame) -> DataFrame:
    """Share of the samples above 55 % of the range among those above it or below 45 %."""
    made = with_extremes(rows).withColumn("_range", F.col("_max") - F.col("_min"))
    high = F.count(F.when((value() > F.col("_min") + 0.55 * F.col("_range")) & (F.col("_range") > 0), 1))
    low = F.count(F.when((value() < F.col("_min") + 0.45 * F.col("_range")) & (F.col("_range") > 0), 1))
    return made.groupBy("ds").agg(divided(high.cast("double"), (high + low).cast("double")).alias("duty_cycle"))


def edge_time(rows: DataFrame) -> DataFrame:
    """Time from the start until the middle of the range is crossed, in the direction from the first to the last value."""
    w = Window.partitionBy("ds")
    made = with_extremes(rows)
    made = made.withColumn("_first", F.min_by("y", "idx").over(w)).withColumn("_last", F.max_by("y", "idx").over(w)).withColumn("_start", F.min_by("x", "idx").over(w))
    half = (F.col("_max") + F.col("_min")) / 2
    falls = F.col("_first") > F.col("_last")
    crossed = F.when(falls, value() < half).otherwise(value() > half) & (F.col("_max") > F.col("_min"))
    return made.groupBy("ds").agg(F.coalesce(F.min_by(F.col("x") - F.col("_start"), F.when(crossed, F.col("idx"))), nan()).alias("edge_time"))


def edges(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Changes between above high and below low, with the state that they lead to (1 above); the state starts low."""
    w = Window.partitionBy("ds").orderBy("idx")
    mark = F.when(value() > high, 1).when(value() < low, 0)
    made = rows.withColumn("_state", F.coalesce(F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return made.withColumn("_was", F.lag("_state", 1, 0).over(w)).filter("_state <> _was").drop("_was")


def frequency_estimate(rows: DataFrame) -> DataFrame:
    """Number of periods over their total length, between edges of the same kind at 45 % and 55 % of the range."""
    made = with_extremes(rows).withColumn("_range", F.col("_max") - F.col("_min"))
    found = edges(made, F.col("_min") + 0.45 * F.col("_range"), F.col("_min") + 0.55 * F.col("_range"))
    same = Window.partitionBy("ds", "_state").orderBy("idx")
    found = found.withColumn("_period", F.col("x") - F.lag("x").over(same))
    return rows.select("ds").distinct().join(found.groupBy("ds").agg(divided(F.count("_period").cast("double"), F.sum("_period")).alias("frequency")), "ds", "left").withColumn("frequency", F.coalesce("frequency", nan()))


def zero_crossing(rows: DataFrame, threshold: float) -> DataFrame:
    """The interpolated x at which y first reaches the threshold from its side at the start; the last y where it never does."""
    w = Window.partitionBy("ds").orderBy("idx")
    whole = Window.partitionBy("ds")
    made = rows.withColumn("_y0", F.lag("y").over(w)).withColumn("_x0", F.lag("x").over(w)).withColumn("_first", F.min_by("y", "idx").over(whole))
    hit = F.when(F.col("_first") < threshold, value() >= threshold).otherwise(value() <= threshold) & finite(value()) & finite(F.col("_y0"))
    at = linear_interpolate(F.col("_y0"), value(), F.col("_x0"), F.col("x"), F.lit(float(threshold)))
    return made.groupBy("ds").agg(F.coalesce(F.min_by(at, F.when(hit, F.col("idx"))), F.max_by("y", "idx")).alias("crossing"))


def gauss_maximum(rows: DataFrame) -> DataFrame:
    """The place of the maximum, refined by a Gaussian through it and its neighbours."""
    w = Window.partitionBy("ds").orderBy("idx")
    made = rows.withColumn("_l", F.lag("y").over(w)).withColumn("_r", F.lead("y").over(w)).withColumn("_x1", F.lead("x").over(w))
    top = made.filter(finite(value())).groupBy("ds").agg(F.max_by(F.struct("x", "y", "_l", "_r", "_x1"), F.struct("y", -F.col("idx"))).alias("t"))
    l, c, r = F.col("t._l"), F.col("t.y"), F.col("t._r")
    fits = finite(l) & finite(r) & (l > 0) & (r > 0) & (c > 0) & (c * c != l * r)
    shift = F.when(fits, 0.5 * F.log(r / l) / F.nullif(F.log(c * c / (l * r)), F.lit(0.0))).otherwise(0.0)
    return top.select("ds", F.when(F.col("t._x1").isNull(), nan()).otherwise(F.col("t.x") + shift * (F.col("t._x1") - F.col("t.x"))).alias("location"))


def width_at_half_maximum(rows: DataFrame, interpolate: bool = True) -> DataFrame:
    """Samples between the two sides of the maximum at half its height; not a number where a side is missing."""
    whole, w = Window.partitionBy("ds"), Window.partitionBy("ds").orderBy("idx")
    made = rows.withColumn("_top", F.max(F.struct(value().alias("y"), (-F.col("idx")).alias("at"))).over(whole))
    half = F.col("_top.y") / 2
    at = -F.col("_top.at")
    made = made.withColumn("_l", F.lag("y").over(w)).withColumn("_r", F.lead("y").over(w))
    below = ~(value() > half)
    up = F.min(F.when(below & (F.col("idx") >= at), F.struct("idx", value().alias("y"), F.col("_l").alias("o"), half.alias("h"))))
    down = F.max(F.when(below & (F.col("idx") <= at), F.struct("idx", value().alias("y"), F.col("_r").alias("o"), half.alias("h"))))
    sides = made.groupBy("ds").agg(up.alias("u"), down.alias("d"), F.max("idx").alias("_n"), F.first(at).alias("_at"))
    hi, lo = F.col("u.idx").cast("double"), F.col("d.idx").cast("double")
    if interpolate:
        hi = linear_interpolate(F.col("u.o"), F.col("u.y"), hi - 1, hi, F.col("u.h"))
        lo = linear_interpolate(F.col("d.y"), F.col("d.o"), lo, lo + 1, F.col("d.h"))
    inner = (F.col("_at") > 0) & (F.col("_at") < F.col("_n")) & F.col("u").isNotNull() & F.col("d").isNotNull()
    return sides.select("ds", F.when(inner, hi - lo).otherwise(nan()).alias("width"))


def step_start(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The first place at which y reaches a share of its way from the start to the maximum, or else to the minimum."""
    whole = Window.partitionBy("ds")
    made = with_extremes(rows).withColumn("_first", F.min_by("y", "idx").over(whole))
    up = F.col("_first") + threshold * (F.col("_max") - F.col("_first"))
    down = F.col("_first") - threshold * (F.col("_first") - F.col("_min"))
    rising, falling = (F.col("_max") > F.col("_first")) & (value() >= up), (F.col("_min") < F.col("_first")) & (value() <= down)
    hit = F.struct(F.col("idx"))
    found = made.groupBy("ds").agg(F.min(F.when(rising, F.col("idx"))).alias("_r"), F.min(F.when(falling, F.col("idx"))).alias("_f"), F.min(hit).alias("_any"))
    return found.select("ds", F.coalesce("_r", "_f").alias("step_idx"))


def signal_range(values: Column) -> Column:
    """min and max of the finite values of an array."""
    good = F.filter(values, lambda v: finite(v))
    return F.struct(F.array_min(good).alias("min"), F.array_max(good).alias("max"))


def consistent(ds: Column) -> Column:
    """Whether a nested data set's parts fit together: names, units and values of axes and signals, and the extents' product."""
    signals = F.size(ds["signal_names"])
    count = F.aggregate(ds["extents"], F.lit(1), lambda a, b: a * b)
    return (F.size(ds["axis_names"]) == F.size(ds["axis_units"])) & (F.size(ds["axis_names"]) == F.size(ds["axis_values"])) & (signals == F.size(ds["signal_units"])) & (signals == F.size(ds["signal_ranges"])) & (F.size(ds["signal_values"]) == signals * count)


def settling(y: np.ndarray, window: int, tolerance: float = 0.0, first: int = 0, last: int | None = None) -> tuple[int, float] | None:
    """The middle of the first window whose deviation is within tolerance (2 % of the range), and the window's mean."""
    part = np.asarray(y, float)[first:last]
    if window < 1 or len(part) < window:
        return None
    views = np.lib.stride_tricks.sliding_window_view(part, window)
    calm = np.flatnonzero(views.std(axis=1) <= (tolerance or 0.02 * float(np.ptp(part))))
    return (first + int(calm[0]) + window // 2, float(views[calm[0]].mean())) if len(calm) else None


def crossing(x: np.ndarray, y: np.ndarray, level: float, last: int | None = None) -> float:
    """The interpolated x at which y first reaches a level from its side at the start; the last y where it never does."""
    last = len(y) if last is None else last
    there = (y >= level if y[0] < level else y <= level)[:last]
    there[0] = False
    hits = np.flatnonzero(there)
    if not len(hits):
        return float(y[last - 1])
    i = int(hits[0])
    return float(x[i]) if y[i] == y[i - 1] else float(x[i - 1] + (x[i] - x[i - 1]) * (level - y[i - 1]) / (y[i] - y[i - 1]))


def step_response(x: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Of a step or pulse: its direction and time, levels before and after, rise time from 10 % to 90 %, peak, overshoot (the
    peak's height in percent of the step: 100 for none), settling time, and whether it comes back. The levels come from rough edges at 20 %, 50 % and 80 % first."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    first, low, high = float(y[0]), float(y.min()), float(y.max())
    rising = first < high
    if not rising and not first > low:
        raise ValueError("no step in the signal")
    sign = 1.0 if rising else -1.0
    reach = high - first if rising else first - low
    at = [min(len(x) - 1, int(np.searchsorted(x, crossing(x, y, first + sign * share * reach)))) for share in (0.2, 0.5, 0.8)]
    rough, edge, least = at[2] - at[0], at[1], 0.02 * (high - low)
    lead = y[: max(1, edge - rough if edge > rough else 4)]
    start = crossing(x, y, float(lead.mean()) + sign * 2.5 * max(float(lead.std()), least), max(1, edge))
    v1 = float(y[: max(1, min(int(start), edge))].mean())
    near = sign * y[edge : max(edge + 1, min(edge + 2 * rough, len(y)))]
    top = edge + int(near.argmax())
    calm = settling(y, 4 * rough, least, top)
    v2 = calm[1] if calm else high
    step = v2 - v1
    times = {share: crossing(x, y, v1 + share * step) for share in (0.1, 0.5, 0.9)}
    return {
        "rising": float(rising), "trigger_time": times[0.5], "v1": v1, "v2": v2, "rise_time": times[0.9] - times[0.1],
        "peak_amplitude": float(y[top]) - v1, "peak_time": float(x[top]), "overshoot": (float(y[top]) - v1) / step * 100 if step else 0.0,
        "settling_time": float(calm[0]) if calm else float("nan"), "pulse": float(v2 - y[-1] > 3 * least),
    }


def step_responses(rows: DataFrame) -> DataFrame:
    """step_response of every data set (ds, idx, x, y); data sets without a step give nulls."""
    import pandas as pd

    kind = dict(rows.dtypes)["ds"]
    names = ["rising", "trigger_time", "v1", "v2", "rise_time", "peak_amplitude", "peak_time", "overshoot", "settling_time", "pulse"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        try:
            made = step_response(pdf["x"].to_numpy(), pdf["y"].to_numpy())
        except ValueError:
            made = {}
        return pd.DataFrame({"ds": [pdf["ds"].iloc[0]], **{n: [made.get(n)] for n in names}}).astype(dict.fromkeys(names, float))

    return rows.select("ds", "idx", "x", "y").groupBy("ds").applyInPandas(run, f"ds {kind}, " + ", ".join(f"{n} double" for n in names))
