"""What the operators of this subpackage share: the shared folder, written intermediates and components.

Everything here survives lost executors: intermediates are Parquet tables in the folder that the cluster
names in ``spark.checkpoint.dir``, never blocks or files of one machine.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Folders that this driver has made and not removed.
MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for a local master that names none."""
    found = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sampleweave-')}"
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/") if "://" in found or found.startswith("file:") else f"file://{found.rstrip('/')}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    MADE.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.written_at = path
    return made


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours in the shared folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in MADE:
        MADE.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        removed(table.sparkSession, table.written_at)


def remove_all(spark: SparkSession) -> None:
    """Deletes every intermediate of this driver; call it when no result that reads one is needed any more."""
    for path in list(MADE):
        removed(spark, path)


def file_system(uri: str):
    """The pyarrow file system and the path in it of a URI (file, s3, gs, hdfs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


#: What holds memory in this Python worker between tasks: the operator that ran last and what it can let go.
HOLDING: dict[str, list[Callable[[], None]]] = {}


def at_work(name: str, *release: Callable[[], None]) -> None:
    """Called where an operator's tasks begin: what other operators left in this worker is let go. Workers live on from
    stage to stage; an operator's own caches serve its next task."""
    others = [x for x in HOLDING if x != name]
    for other in others:
        for let_go in HOLDING.pop(other):
            let_go()
    HOLDING[name] = list(release)
    if others:
        gc.collect()
        pyarrow.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns of the given names; extra ones, whatever their names, are dropped before anything is added."""
    return df.select(*names)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) for each node in an edge; component is the smallest node.

    Alternates two steps on an edge table (large-star and small-star): each node's larger neighbours move to its
    smallest neighbour, then its smaller ones do. Both are a minimum per node, combined before the shuffle, and an
    equi-join back. The minima are written first, so that both sides of the join come straight from exchanges and
    adaptive execution can split the partition of a node that holds many edges; no neighbour list is ever gathered.
    The number of rounds grows with the logarithm of the longest path. Each step is a written table.
    """
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = written(ordered.distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = written(both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        down = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        last, pairs = pairs, written(down.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        discard(smallest, large, least, last)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
