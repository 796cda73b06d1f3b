"""The corpus pipeline: the stages, in order, that turn documents into packed sequences.

Each stage takes (spark, docs, sf_dir) and all documents that its predecessor kept; all but the last return the columns of
documents. A caller that keeps the stages' results writes each before it runs the next, as run does.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleweave.llm import packing, secrets, shared, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Shingles of five words, of which near-duplicates share 0.8 or more.
SHINGLE, SIMILARITY = 5, 0.8
#: Most rows (an id and a hash) that are sent to every executor in place of a shuffle of whole texts.
BROADCAST = 1 << 20
KEY = "text hash"  #: a column of its own beside COLUMNS


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a model of the labels, but for those held out, scores at the threshold or above."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fitted(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.scored(docs.select(*COLUMNS), model).filter(F.col("toxicity") < toxicity.THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates one row: that with the smallest doc_id (of those with the smallest hash of the text).

    Rows go by their id and their text, so rows that share a doc_id go each by its own text. Of rows that repeat the one
    that stays, the smallest by all columns stays. A row without an id goes if its group has a row with one.
    """
    docs = docs.select(*COLUMNS).withColumn(KEY, F.xxhash64(F.coalesce("text", F.lit(""))))
    groups = shared.written(simhash.similar(docs, SHINGLE, SIMILARITY), "groups")

    def found(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        rows = shared.written(rows.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h")).distinct(), name)
        n = rows.count()
        return (F.broadcast(rows) if n <= BROADCAST else rows), n  # beyond it both sides are shuffled

    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col(KEY) == F.col("h"))
    lost, _ = found(groups.filter("not kept"), "lost")
    repeats, n = found(groups.filter("kept and doc_id is not null").groupBy("doc_id", "text_hash").count().filter("count > 1"), "repeats")
    kept = docs.join(lost, same, "left_anti")
    if n:
        one = kept.join(repeats, same, "left_semi").groupBy("doc_id", KEY).agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
        return kept.join(repeats, same, "left_anti").select(*COLUMNS).union(one.select(*COLUMNS))
    return kept.select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret; documents without one are untouched."""
    found = secrets.scan(docs.select(*COLUMNS), "found")
    changed = F.size("found") > 0
    made = found.withColumn("clean", secrets.redacted(F.col("text"), F.col("found")))
    made = made.withColumn("size", F.when(changed, F.length("clean").cast("long")).otherwise(F.col("n_chars")))
    return made.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.col("size").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 ids: one row per piece."""
    return packing.digests(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0))


STAGES = [("toxicity", toxic), ("near-duplicates", near_duplicates), ("secrets", without_secrets), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
