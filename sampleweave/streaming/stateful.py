"""Stateful operators over unbounded streams. Within a micro-batch rows are put in order of idx; a stream's state is small.

A gap in idx is an error of the source, unless the operator counts it (n_dropped_samples). Rows that come again after a
restart (an idx at or below the last one seen) are left out; late_rows is the stream of those, to be counted or kept.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleweave.operators.recursive import Recursion
from sampleweave.operators.trigger import matches, parsed


def stateful(samples: DataFrame, step: Callable[[pd.DataFrame, dict], pd.DataFrame], schema: str) -> DataFrame:
    """step(rows in order, state) changes the state in place and returns rows; the state is kept as JSON."""
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"last": -1}
        rows = pd.concat(list(frames)).sort_values("idx", kind="stable")
        rows = rows[rows["idx"] > held["last"]].drop_duplicates("idx")
        if len(rows):
            made = step(rows, held)
            held["last"] = int(rows["idx"].iloc[-1])
            state.update((json.dumps(held),))
            if len(made):
                made.insert(0, "stream_id", key[0])
                yield made[["stream_id", *columns]]

    kind = dict(samples.dtypes)["stream_id"]
    return samples.groupBy("stream_id").applyInPandasWithState(run, f"stream_id {kind}, {schema}", "state string", "append", "NoTimeout")


def iir(samples: DataFrame, b: Sequence[float], a: Sequence[float]) -> DataFrame:
    def step(rows: pd.DataFrame, held: dict) -> pd.DataFrame:
        out, end = Recursion(b, a).run(rows["value"].to_numpy(float), np.array(held["z"]) if "z" in held else None)
        held["z"] = end.tolist()
        return pd.DataFrame({"idx": rows["idx"], "value": out})

    return stateful(samples, step, "idx long, value double")


def fir(samples: DataFrame, taps: Sequence[float]) -> DataFrame:
    return iir(samples, taps, [1.0])


def schmitt(samples: DataFrame, offset: float, threshold: float) -> DataFrame:
    """idx, edge of a hysteresis."""

    def step(rows: pd.DataFrame, held: dict) -> pd.DataFrame:
        x = rows["value"].to_numpy(float)
        mark = pd.Series(np.where(x >= offset + threshold, 1.0, np.where(x <= offset - threshold, 0.0, np.nan)))
        now = mark.ffill().fillna(held.get("high", 0)).to_numpy()
        was = np.concatenate([[held.get("high", 0)], now[:-1]])
        held["high"] = int(now[-1])
        at = np.flatnonzero(now != was)
        return pd.DataFrame({"idx": rows["idx"].to_numpy()[at], "edge": np.where(now[at] == 1, "RISING", "FALLING")})

    return stateful(samples, step, "idx long, edge string")


def stream_filter(samples: DataFrame, rule: str, pre: int = 0, post: int = 0) -> DataFrame:
    """Samples with tags beside them (stream_id, idx, value, name, context): those between start and stop triggers. The state
    holds the last `pre` samples. Filters with ^ run over finite streams only (operators.trigger)."""
    want = parsed(rule)
    if want.start.after or want.stop.after:
        raise ValueError("^ needs the tags of a finite stream")

    def step(rows: pd.DataFrame, held: dict) -> pd.DataFrame:
        out: list[tuple[int, float]] = []
        history, on, tail = held.get("history", []), held.get("on", False), held.get("tail", 0)
        for idx, value, name, context in zip(rows["idx"], rows["value"], rows["name"], rows["context"], strict=True):
            name, context = name or "", context or ""
            if name or context:
                if want.single:
                    one = want.one
                    if (not one.name or one.name == name) and (not one.context or context in one.context):
                        out += history
                        history, tail = [], max(tail, post)
                elif not on and matches(want.start, name, context):
                    out += history
                    history, on, tail = [], True, 0
                elif on and matches(want.stop, name, context):
                    on, tail = False, post
            if on or tail > 0:
                out.append((int(idx), float(value)))
                tail -= 0 if on else 1
            else:
                history = [*history, (int(idx), float(value))][-pre:] if pre else []
        held |= {"history": history, "on": on, "tail": tail}
        return pd.DataFrame(out, columns=["idx", "value"])

    return stateful(samples, step, "idx long, value double")


def late_rows(samples: DataFrame) -> DataFrame:
    """idx, value of the rows that the operators here leave out: at or below the last idx seen in an earlier micro-batch, or again in the same one."""
    kind = dict(samples.dtypes)["stream_id"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        rows = pd.concat(list(frames)).sort_values("idx", kind="stable")
        out = rows[(rows["idx"] <= last) | rows.duplicated("idx")]
        state.update((max(last, int(rows["idx"].max())),))
        if len(out):
            yield out[["stream_id", "idx", "value"]]

    return samples.select("stream_id", "idx", "value").groupBy("stream_id").applyInPandasWithState(run, f"stream_id {kind}, idx long, value double", "last long", "append", "NoTimeout")


def chunk_statistics(samples: DataFrame, seconds: str, delay: str = "10 seconds", slide: str | None = None) -> DataFrame:
    """Count, mean and deviation of windows of event time (ts) behind a watermark: tumbling, or a new one every slide."""
    late = samples.withWatermark("ts", delay)
    return late.groupBy("stream_id", F.window("ts", seconds, slide)).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("rms")).select("stream_id", F.col("window.start").alias("start"), "n", "mean", "rms")


def dropped(samples: DataFrame) -> DataFrame:
    """idx, n_dropped_samples wherever samples are missing."""

    def step(rows: pd.DataFrame, held: dict) -> pd.DataFrame:
        idx = rows["idx"].to_numpy()
        lost = np.diff(np.concatenate([[held["last"]], idx])) - 1
        at = np.flatnonzero(lost > 0)
        return pd.DataFrame({"idx": idx[at], "n_dropped_samples": lost[at]})

    return stateful(samples, step, "idx long, n_dropped_samples long")
