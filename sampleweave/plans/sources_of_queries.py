"""The driver's tables as streams: events of a user in order of time are a stream, event types are trigger names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleweave.model import with_index


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id (user), idx, value."""
    return indexed(spark, sf_dir).select("stream_id", "idx", "value")


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type", "value")
    return with_index(events, "user_id", ["ts", "event_id"]).select("stream_id", "idx", "value", "event_type", "ts", "event_id")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tag per event: its type is the trigger name; time in nanoseconds."""
    made = indexed(spark, sf_dir)
    return made.select("stream_id", "idx", F.col("event_type").alias("name"), F.lit("").alias("context"), F.lit(0).alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time"))


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).select(F.col("stream_id").alias("ds"), "idx", F.col("idx").cast("double").alias("x"), F.col("value").alias("y"))


#: The same stream for the oracles.
STREAM = """WITH s AS (
    SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value, event_type, ts, event_id FROM events
)"""
