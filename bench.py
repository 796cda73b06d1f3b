"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleweave.operators import recursive
from sampleweave.operators.design import iir_design
from sampleweave.plans import registry
from sampleweave.session import local_session
from sampleweave.sources import generators

HEADLINE = [
    "range_statistics", "stream_filter", "stream_to_dataset", "const_arith", "nary_arith", "sync_join", "decimate", "stride_tumbling", "stride_overlap", "fir_3tap", "moving_average", "moving_median", "schmitt_edges",
    "settings_asof", "selector_interleave", "sync_align", "dataset_stats", "dataset_frequency", "dataset_add", "power_factor", "dft_small", "iir_butterworth", "graph_of_blocks",
]




def chain(spark: SparkSession, n: int, times: int) -> DataFrame:
    """A generated stream through multiply, divide and add, so many times over; a sum is its sink."""
    value = F.col("idx").cast("double")
    for _ in range(times):
        value = value * 2.0 / 3.0 + 1.0
    return generators.samples(spark, n, value).agg(F.sum("value"))


def low_pass(spark: SparkSession, n: int) -> DataFrame:
    """A generated tone through a third-order low-pass, in parallel over the blocks of its one stream."""
    tone = generators.signal_generator(spark, n, "Sin", 1000.0, 5.0)
    return recursive.iir(tone, *iir_design("LOWPASS", 3, 50.0, 60.0, 1000.0)).agg(F.sum("value"))


#: The cases of the published figures: samples and plan.
CHAINS = {
    "source-copy-sink": (200_000_000, lambda spark: chain(spark, 200_000_000, 0)),
    "source-multiply-divide-add-sink": (200_000_000, lambda spark: chain(spark, 200_000_000, 1)),
    "source-(multiply-divide-add)^10-sink": (200_000_000, lambda spark: chain(spark, 200_000_000, 10)),
    "low-pass": (8_000_000, lambda spark: low_pass(spark, 8_000_000)),
}


def rate(make: Callable[[], DataFrame], n: int) -> float:
    """Samples a second, the better of two runs, each of a new plan (a frame that ran before would read its own shuffle files)."""
    best = 0.0
    for _ in range(2):
        began = time.perf_counter()
        frame = make()
        frame.collect()
        best = max(best, n / (time.perf_counter() - began))
    return best


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["const_arith"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the session's threads
    took = {}
    for name in HEADLINE:
        best = []
        for _ in range(2):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
        took[name] = round(min(best), 3)
    cases = {name: round(rate(lambda make=make: make(spark), n)) for name, (n, make) in CHAINS.items()}
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "samples_per_sec": cases}))


if __name__ == "__main__":
    main()
