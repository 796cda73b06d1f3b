"""Sources and sinks of running streams: clocks, listeners, a registry of sinks, and performance figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener


def slow_source(spark: SparkSession, rows_per_second: int = 10, value: float = 0.0, stream: str = "s") -> DataFrame:
    """A constant at a steady pace: stream_id, idx, value, ts."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).option("numPartitions", 1).load()
    return rate.select(F.lit(stream).alias("stream_id"), F.col("value").alias("idx"), F.lit(value).alias("value"), F.col("timestamp").alias("ts"))


def pps_source(spark: SparkSession) -> DataFrame:
    """One tag a second with the time in nanoseconds."""
    clock = slow_source(spark, 1)
    return clock.select("stream_id", "idx", F.lit("PPS").alias("name"), F.lit("").alias("context"), (F.unix_micros("ts") * 1000).alias("time"), "ts")


class SinkRegistry:
    """Sinks by name or by the name of their signal; both must be unique."""

    def __init__(self) -> None:
        self.sinks: dict[str, tuple[str, DataFrame]] = {}

    def add(self, name: str, signal: str, frame: DataFrame) -> None:
        if name in self.sinks or any(s == signal for s, _ in self.sinks.values()):
            raise ValueError(f"a sink named {name} or of signal {signal} exists")
        self.sinks[name] = (signal, frame)

    def find(self, key: str) -> DataFrame:
        for name, (signal, frame) in self.sinks.items():
            if key in (name, signal):
                return frame
        raise KeyError(key)

    def remove(self, name: str) -> None:
        del self.sinks[name]


def listen(frame: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """call(rows, batch) for every micro-batch: a continuous listener. Spark never drops rows; a slow listener slows the source."""
    writer: DataStreamWriter = frame.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def monitored(frame: DataFrame, name: str = "monitor") -> tuple[DataFrame, Observation]:
    """frame, and the count, last index and extremes of what passes through it, ready when an action on it has ended."""
    seen = Observation(name)
    return frame.observe(seen, F.count(F.lit(1)).alias("n"), F.max("idx").alias("last"), F.min("value").alias("minimum"), F.max("value").alias("maximum")), seen


class PerformanceMonitor(StreamingQueryListener):
    """Rows, rates and state sizes of every micro-batch of the session's queries, as a list of dicts."""

    def __init__(self) -> None:
        self.seen: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.seen.append({"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
