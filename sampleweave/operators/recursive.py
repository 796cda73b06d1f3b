"""Operators whose output feeds back: recursive filters, hysteresis, recursive expressions.

A linear recursion over one long stream runs in parallel over blocks: each block is filtered from rest, the state at the
end of every block follows from the states at the starts by one small matrix per block, and a second pass adds what each
block's true start state contributes. Hysteresis is a forward fill. Only non-linear recursions take a stream in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleweave.functions.expressions import names_in, parsed_once, weighted
from sampleweave.model import BLOCK, carried

STEP = 64  #: samples that one matrix product filters


class Recursion:
    """y = b * x - a[1:] * y as a state-space system, applied STEP samples at a time."""

    def __init__(self, b: Sequence[float], a: Sequence[float]):
        a0 = float(a[0]) if len(a) else 1.0
        n = max(len(a), len(b)) - 1
        b, a = (np.concatenate([np.asarray(v, float) / a0, np.zeros(n + 1 - len(v))]) for v in (b, a))
        self.n = n
        self.step = np.eye(n, k=1)
        if n:
            self.step[:, 0] -= a[1:]
        self.drive = b[1:] - a[1:] * b[0] if n else np.zeros(0)
        self.through = b[0]
        powers = [np.eye(n)]
        for _ in range(STEP):
            powers.append(powers[-1] @ self.step)
        self.powers = powers
        response = [self.through] + [float((powers[k] @ self.drive)[0]) if n else 0.0 for k in range(STEP - 1)]
        self.toeplitz = np.array([[response[i - j] if i >= j else 0.0 for j in range(STEP)] for i in range(STEP)])
        self.observe = np.array([powers[k][0] if n else np.zeros(0) for k in range(STEP)]).reshape(STEP, n)
        self.gather = np.array([powers[STEP - 1 - k] @ self.drive for k in range(STEP)]).reshape(STEP, n).T

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The output and the state after the last sample."""
        s = np.zeros(self.n) if state is None else np.asarray(state, float)
        whole = len(x) // STEP
        out = np.empty(len(x))
        if whole and not np.isfinite(x).all():  # a product would spread what is not finite to the samples before it
            with np.errstate(invalid="ignore"):
                return out, self.one_by_one(x, s, out)
        blocks = x[: whole * STEP].reshape(whole, STEP)
        drives, starts = blocks @ self.gather.T, np.empty((whole, self.n))
        jump = self.powers[STEP]
        for i in range(whole):
            starts[i] = s
            s = jump @ s + drives[i]
        out[: whole * STEP] = (blocks @ self.toeplitz.T + starts @ self.observe.T).ravel()
        return out, self.one_by_one(x[whole * STEP :], s, out[whole * STEP :])

    def one_by_one(self, x: np.ndarray, s: np.ndarray, out: np.ndarray) -> np.ndarray:
        for k in range(len(x)):
            out[k] = self.through * x[k] + (s[0] if self.n else 0.0)
            s = self.step @ s + self.drive * x[k]
        return s

    def free(self, length: int, state: np.ndarray) -> np.ndarray:
        """The state after so many samples of zero input."""
        return np.linalg.matrix_power(self.step, length) @ state


def sosfilt(sections: Sequence[tuple[Sequence[float], Sequence[float]]], x: np.ndarray) -> np.ndarray:
    for b, a in sections:
        x = Recursion(b, a).run(np.asarray(x, float))[0]
    return x


def in_one_pass(samples: DataFrame, b: Sequence[float], a: Sequence[float]) -> DataFrame:
    """Every stream in one task, in order, batch by batch: the task holds a state and a batch, however long the stream is."""
    kind = dict(samples.dtypes)["stream_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, stream, state = Recursion(b, a), None, None
        for pdf in frames:
            ids, x = pdf["stream_id"].to_numpy(), pdf["value"].to_numpy(float)
            out = np.empty(len(x))
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(x)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i < j:
                    state = state if ids[i] == stream else None
                    out[i:j], state = system.run(x[i:j], state)
                    stream = ids[i]
            yield pd.DataFrame({"stream_id": ids, "idx": pdf["idx"], "value": out})

    ordered = samples.select("stream_id", "idx", "value").repartition("stream_id").sortWithinPartitions("stream_id", "idx")
    return ordered.mapInPandas(run, f"stream_id {kind}, idx long, value double")


def iir(samples: DataFrame, b: Sequence[float], a: Sequence[float], block: int = BLOCK) -> DataFrame:
    """The difference equation over every stream (the four classical forms differ in rounding only): in one pass where no
    stream has more than a block, as one look at the greatest index tells, else in parallel over the blocks of each."""
    if (samples.agg(F.max("idx")).first()[0] or 0) < block:
        return in_one_pass(samples, b, a)
    kind = dict(samples.dtypes)["stream_id"]
    order = max(len(a), len(b)) - 1

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        _, state = Recursion(b, a).run(pdf["value"].to_numpy(float))
        return pd.DataFrame({"stream_id": [pdf["stream_id"].iloc[0]], "_block": [pdf["_block"].iloc[0]], "_n": [len(pdf)], "_end": [state]})

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        system, state, out = Recursion(b, a), np.zeros(order), []
        for n, end in zip(pdf["_n"], pdf["_end"], strict=True):
            out.append(state)
            state = np.asarray(end) + system.free(int(n), state)
        return pd.DataFrame({"stream_id": pdf["stream_id"], "_block": pdf["_block"], "_start": out})

    def filtered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        out, _ = Recursion(b, a).run(pdf["value"].to_numpy(float), pdf["_start"].iloc[0])
        return pd.DataFrame({"stream_id": pdf["stream_id"], "idx": pdf["idx"], "value": out})

    rows = samples.select("stream_id", "idx", "value", F.expr(f"idx div {block}").alias("_block"))
    states = rows.groupBy("stream_id", "_block").applyInPandas(ends, f"stream_id {kind}, _block long, _n long, _end array<double>")
    starts = states.groupBy("stream_id").applyInPandas(chained, f"stream_id {kind}, _block long, _start array<double>")
    return rows.join(starts, ["stream_id", "_block"]).groupBy("stream_id", "_block").applyInPandas(filtered, f"stream_id {kind}, idx long, value double")


def iir_sections(samples: DataFrame, sections: Sequence[tuple[Sequence[float], Sequence[float]]]) -> DataFrame:
    for b, a in sections:
        samples = iir(samples, b, a)
    return samples


def fitted_line(points: Column) -> Column:
    """slope and level (at x = 0) of the straight line of least squares through (x, y) of an array; null for a single
    point. Means and moments run along the array as those of SQL's regr_slope do, so its order decides the last digits."""
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("n", "mx", "my", "xy", "xx", "sx", "sy")))

    def step(s: Column, p: Column) -> Column:
        n, x, y = s["n"] + 1.0, p["x"], p["y"]
        mx, my = s["mx"] + (x - s["mx"]) / n, s["my"] + (y - s["my"]) / n
        made = {"n": n, "mx": mx, "my": my, "xy": s["xy"] + (x - s["mx"]) * (y - my), "xx": s["xx"] + (x - mx) * (x - s["mx"]), "sx": s["sx"] + x, "sy": s["sy"] + y}
        return F.struct(*(c.alias(name) for name, c in made.items()))

    def line(s: Column) -> Column:
        slope = s["xy"] / s["n"] / F.nullif(s["xx"] / s["n"], F.lit(0.0))
        return F.struct(slope.alias("slope"), (s["sy"] / s["n"] - slope * (s["sx"] / s["n"])).alias("level"))

    return F.aggregate(points, zero, step, line)


def schmitt_regression(samples: DataFrame, offset: float = 0.0, threshold: float = 1.0, sample_rate: float = 1.0, most: int = 16) -> DataFrame:
    """Edges of a hysteresis, each where the straight line of least squares through the samples between the two levels,
    the last `most` of them and two at least, meets the offset; the columns of schmitt, trigger_offset from the edge's sample.

    An edge starts at the opposite level: a rise needs a sample at or below offset - threshold before it, and what
    falls before the first rise is none. A level line meets the offset infinitely far away, at no time.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above zero")
    mark = F.when(F.col("value") >= offset + threshold, 1).when(F.col("value") <= offset - threshold, 0)
    # what the sample before saw last: its level and place; and the first level of the stream
    filled = carried(samples, F.when(mark.isNotNull(), F.struct(mark.alias("level"), F.col("idx").alias("at"))), "_seen")
    late = filled.select("stream_id", (F.col("idx") + 1).alias("idx"), F.col("_seen").alias("_was"))
    turns = filled.withColumn("_mark", mark).filter("_mark is not null").join(late, ["stream_id", "idx"]).filter("_mark <> _was.level")
    risen = samples.filter(mark == 0).groupBy("stream_id").agg(F.min("idx").alias("_low"))
    edges = turns.join(risen, "stream_id").filter("idx > _low").select("stream_id", F.col("idx").alias("_edge"), "_mark", F.least(F.greatest(F.col("idx") - F.col("_was.at"), F.lit(2)), F.lit(most)).alias("_n"))
    asked = edges.select("*", F.explode(F.expr("sequence(_edge - _n + 1, _edge)")).alias("idx"))
    point = F.when(F.col("value").isNotNull(), F.struct((F.col("idx") - F.col("_edge")).cast("double").alias("x"), F.col("value").alias("y")))
    sets = asked.join(samples, ["stream_id", "idx"]).groupBy("stream_id", "_edge", "_mark").agg(F.sort_array(F.collect_list(point), asc=False).alias("_points"))
    lines = sets.withColumn("_line", fitted_line(F.col("_points")))
    rise, slope = F.lit(float(offset)) - F.col("_line.level"), F.col("_line.slope")
    lines = lines.withColumn("trigger_offset", F.when(slope == 0, rise * F.lit(float("inf"))).otherwise(rise / F.nullif(slope, F.lit(0.0))))
    time = ((F.col("_edge") + F.col("trigger_offset")) * F.lit(1e9 / sample_rate)).try_cast("long")
    return lines.select("stream_id", F.col("_edge").alias("idx"), F.when(F.col("_mark") == 1, "RISING").otherwise("FALLING").alias("edge"), time.alias("trigger_time"), "trigger_offset")


def schmitt(samples: DataFrame, offset: float = 0.0, threshold: float = 1.0, interpolate: bool = False, sample_rate: float = 1.0) -> DataFrame:
    """Edges of a hysteresis: rising at offset + threshold, falling at offset - threshold; the state starts low.

    stream_id, idx, edge, trigger_time (nanoseconds of the crossing from the stream's start), trigger_offset (its distance
    from the sample, in samples, where interpolate asks for the straight line through the offset level).
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above zero")
    mark = F.when(F.col("value") >= offset + threshold, 1).when(F.col("value") <= offset - threshold, 0)
    filled = carried(samples, mark, "_state", F.lit(0))
    # a state's neighbour may lie in the block before: forward fill of the state one sample late
    late = filled.select("stream_id", (F.col("idx") + 1).alias("idx"), F.col("_state").alias("_was"), F.col("value").alias("_x0"))
    both = filled.join(late, ["stream_id", "idx"], "left").filter("_state <> coalesce(_was, 0)")
    shift = F.when(F.col("_x0").isNull() | (F.col("value") == F.col("_x0")), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(0.0), (F.lit(offset) - F.col("value")) / (F.col("value") - F.col("_x0"))))) if interpolate else F.lit(0.0)
    both = both.withColumn("trigger_offset", shift)
    time = ((F.col("idx") + F.col("trigger_offset")) * F.lit(1e9 / sample_rate)).cast("long")
    return both.select("stream_id", "idx", F.when(F.col("_state") == 1, "RISING").otherwise("FALLING").alias("edge"), time.alias("trigger_time"), "trigger_offset")


def expression(samples: DataFrame, text: str, a: float = 1.0, b: float = 0.0, c: float = 0.0) -> DataFrame:
    """An expression of x and y, the output before it (0 at first). Without y it is element-wise and needs no kernel; a
    weighted sum of x, y and a constant is a recursive filter; any other takes a stream in one task, parsed once."""
    if "y" not in names_in(text):
        from sampleweave.operators.elementwise import expression as plain

        return plain(samples, text, a, b, c)
    weights = weighted(text, {"a": a, "b": b, "c": c})
    if weights is not None:
        of_x, of_y, rest = weights
        return iir(samples.withColumn("value", F.col("value") * F.lit(of_x) + F.lit(rest)), [1.0], [1.0, -of_y])
    kind = dict(samples.dtypes)["stream_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        out, y, step = np.empty(len(pdf)), np.float64(0), parsed_once(text)
        names = {"a": np.float64(a), "b": np.float64(b), "c": np.float64(c)}
        with np.errstate(all="ignore"):
            for i, x in enumerate(pdf["value"].to_numpy(float)):
                names["x"], names["y"] = x, y
                out[i] = y = np.float64(step(names))
        return pd.DataFrame({"stream_id": pdf["stream_id"], "idx": pdf["idx"], "value": out})

    return samples.select("stream_id", "idx", "value").groupBy("stream_id").applyInPandas(run, f"stream_id {kind}, idx long, value double")


def python_block(samples: DataFrame, process, outputs: str = "value double") -> DataFrame:
    """A user's function over the values of a stream in order (a numpy array in, one or several of equal length out). State lives within the call."""
    kind = dict(samples.dtypes)["stream_id"]
    names = [x.split()[0] for x in outputs.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        made = process(pdf["value"].to_numpy(float))
        made = made if isinstance(made, tuple) else (made,)
        return pd.DataFrame({"stream_id": pdf["stream_id"].iloc[0], "idx": range(len(made[0])), **dict(zip(names, made, strict=True))})

    return samples.select("stream_id", "idx", "value").groupBy("stream_id").applyInPandas(run, f"stream_id {kind}, idx long, {outputs}")


def previous(samples: DataFrame) -> DataFrame:
    """Each sample with the one before it."""
    return samples.withColumn("previous", F.lag("value").over(Window.partitionBy("stream_id").orderBy("idx")))


def expression_bulk(samples: DataFrame, program: str, size: int, a: float = 1.0, b: float = 0.0, c: float = 0.0) -> DataFrame:
    """A vector program over chunks of a stated size (the last one may be shorter): its result never depends on how a run cuts the stream."""
    from sampleweave.functions.expressions import vector_program

    kind = dict(samples.dtypes)["stream_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        return pd.DataFrame({"stream_id": pdf["stream_id"], "idx": pdf["idx"], "value": vector_program(program, pdf["value"].to_numpy(float), a, b, c)})

    return samples.select("stream_id", "idx", "value").groupBy("stream_id", F.expr(f"idx div {size}")).applyInPandas(run, f"stream_id {kind}, idx long, value double")


def squared_response(b: Sequence[float], a: Sequence[float]) -> tuple[np.ndarray, np.ndarray] | None:
    """Taps of the recursion whose impulse response is the square of that of b and a: its poles are their products, two at a time.

    None where rounding spoils it, as the response's first terms show (poles that nearly meet).
    """
    poles = np.roots(np.asarray(a, float))
    pairs = np.array([poles[i] * poles[j] for i in range(len(poles)) for j in range(i, len(poles))])
    down = np.real(np.poly(pairs)) if len(pairs) else np.ones(1)
    length = 64 * (len(down) + len(b))
    want = Recursion(b, a).run(np.eye(1, length)[0])[0] ** 2
    up = np.convolve(down, want)[: len(down) + max(0, len(b) - len(a) + 1)]
    made = Recursion(up, down).run(np.eye(1, length)[0])[0]
    return (up, down) if np.abs(made - want).max() <= 1e-10 * want.max() else None


def whole_response(b: Sequence[float], a: Sequence[float]) -> np.ndarray:
    """The impulse response up to where the energy that is left is below what doubles hold."""
    length = 256
    while length <= 1 << 20:
        response = Recursion(b, a).run(np.eye(1, length)[0])[0]
        energy = np.cumsum(response[::-1] ** 2)[::-1]
        if energy[length // 2] <= 1e-18 * energy[0]:
            return response[: length // 2]
        length *= 2
    raise ValueError("the impulse response does not fade: the filter is not stable")


def uncertain_iir(samples: DataFrame, b: Sequence[float], a: Sequence[float]) -> DataFrame:
    """A filter over values with independent uncertainties (value struct): variances pass through the square of its whole impulse response."""
    from sampleweave.operators.window import fir

    value = iir(samples.select("stream_id", "idx", F.col("value.value").alias("value")), b, a).withColumnRenamed("value", "_v")
    squares = samples.select("stream_id", "idx", (F.col("value.uncertainty") * F.col("value.uncertainty")).alias("value"))
    if len(a) <= 1:
        spread = fir(squares, ((np.asarray(b, float) / (a[0] if len(a) else 1.0)) ** 2).tolist())
    else:
        taps = squared_response(b, a)
        spread = iir(squares, *taps) if taps is not None else fir(squares, (whole_response(b, a) ** 2).tolist())
    spread = spread.withColumnRenamed("value", "_u")
    return value.join(spread, ["stream_id", "idx"]).select("stream_id", "idx", F.struct(F.col("_v").alias("value"), F.sqrt(F.greatest("_u", F.lit(0.0))).alias("uncertainty")).alias("value"))


def error_propagating(samples: DataFrame, b: Sequence[float], a: Sequence[float]) -> DataFrame:
    """The filtered value, and as its uncertainty the scatter that the filter sees: the filtered square less the square of the
    filtered value. Values with uncertainties (value struct) add their own, as the filter passes them."""
    own = dict(samples.dtypes)["value"].startswith("struct")
    x = F.col("value.value") if own else F.col("value")
    mean = iir(samples.select("stream_id", "idx", x.alias("value")), b, a).withColumnRenamed("value", "_v")
    square = iir(samples.select("stream_id", "idx", (x * x).alias("value")), b, a).withColumnRenamed("value", "_s")
    rows, scatter = mean.join(square, ["stream_id", "idx"]), F.abs(F.col("_s") - F.col("_v") * F.col("_v"))
    if own:
        passed = uncertain_iir(samples, b, a).select("stream_id", "idx", F.col("value.uncertainty").alias("_u"))
        rows, scatter = rows.join(passed, ["stream_id", "idx"]), scatter + F.col("_u") * F.col("_u")
    return rows.select("stream_id", "idx", F.struct(F.col("_v").alias("value"), F.sqrt(scatter).alias("uncertainty")).alias("value"))
