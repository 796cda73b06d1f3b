"""A radio without hardware: what is sent to a channel passes a model of it and comes back as what is received.

Samples are complex (value struct of re and im), by stream and idx. Models are column expressions or shifts of idx, so a
chain of them needs one exchange for each delay and none for the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleweave.sources.generators import noise

Model = Callable[[DataFrame], DataFrame]
MODES = ("Loopback", "RxOnly", "TxOnly")
#: The sample formats of a device, as their full scale, offset and range of integers.
SCALES = {"CS16": (32767.0, 0.0, -32768, 32767), "CU8": (127.5, 127.5, 0, 255)}


def scaled(value: Column, factor: float) -> Column:
    return F.struct((value["re"] * F.lit(float(factor))).alias("re"), (value["im"] * F.lit(float(factor))).alias("im"))


def passthrough() -> Model:
    return lambda rows: rows


def attenuation(db: float) -> Model:
    """Amplitudes times 10^(db / 20); below 0 for a loss."""
    return lambda rows: rows.withColumn("value", scaled(F.col("value"), 10 ** (db / 20)))


def awgn(floor_dbfs: float, seed: int = 0) -> Model:
    """White noise of a stated level on both parts; the same for the same seed, stream and idx."""
    level = 10 ** (floor_dbfs / 20)
    part = lambda name, k: (F.col("value")[name] + F.lit(level) * noise("GaussianNoise", F.struct("stream_id", "idx"), seed + k)).alias(name)
    return lambda rows: rows.withColumn("value", F.struct(part("re", 0), part("im", 1)))


def delay(n: int) -> Model:
    """n samples late: as many zeros come first, and the last n of what was sent are never received."""

    def late(rows: DataFrame) -> DataFrame:
        if n == 0:
            return rows
        ends = rows.groupBy("stream_id").agg(F.max("idx").alias("_end"))
        zero = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
        lead = ends.select("stream_id", F.explode(F.expr(f"sequence(0L, least(_end, {n - 1}))")).alias("idx"), zero.alias("value"))
        moved = rows.withColumn("idx", F.col("idx") + n).join(ends, "stream_id").filter("idx <= _end")
        return lead.unionByName(moved.select("stream_id", "idx", "value"))

    return late


def chained(models: Sequence[Model]) -> Model:
    return lambda rows: reduce(lambda made, model: model(made), models, rows)


def to_format(value: Column, fmt: str) -> Column:
    """Complex numbers within -1 and 1 as a device's integers (CF32: as they are)."""
    if fmt == "CF32":
        return value
    scale, offset, low, high = SCALES[fmt]
    part = lambda name: F.least(F.greatest(F.round(value[name] * scale + offset), F.lit(float(low))), F.lit(float(high))).cast("int").alias(name)
    return F.struct(part("re"), part("im"))


def from_format(value: Column, fmt: str) -> Column:
    if fmt == "CF32":
        return value
    scale, offset, _, _ = SCALES[fmt]
    return F.struct(*(((value[name] - F.lit(offset)) / F.lit(scale)).alias(name) for name in ("re", "im")))


@dataclass
class Loopback:
    """A device of so many channels. Loopback: what is sent returns through the channel's model; RxOnly: a given tone does; TxOnly: nothing."""

    channels: int = 1
    mode: str = "Loopback"
    models: dict[int, Model] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode}")

    def model(self, channel: int, model: Model) -> None:
        if not 0 <= channel < self.channels:
            raise ValueError(f"no channel {channel}")
        self.models[channel] = model

    def received(self, channel: int, sent: DataFrame) -> DataFrame:
        """stream_id, idx, value of a channel: sent is what was transmitted on it, in RxOnly the device's own tone."""
        if not 0 <= channel < self.channels:
            raise ValueError(f"no channel {channel}")
        rows = sent.select("stream_id", "idx", "value")
        return rows.limit(0) if self.mode == "TxOnly" else self.models.get(channel, passthrough())(rows)


#: Devices by number: both ends of a loop find the same one.
DEVICES: dict[int, Loopback] = {}


def device(name: str = "loopback", **how) -> Loopback:
    """The device of a name: loopback for the first there is, loopback#3 for number 3; made if there is none."""
    head, _, number = name.partition("#")
    if head != "loopback":
        raise ValueError(f"unknown driver {head}")
    at = int(number) if number else min(DEVICES, default=0)
    return DEVICES.setdefault(at, Loopback(**how)) if at not in DEVICES else DEVICES[at]
