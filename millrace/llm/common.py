"""Helpers shared by the operators: the shared folder, lineage cuts and dense positions."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits that monotonically_increasing_id() keeps for the position inside a partition (fixed by Spark).
POSITION_BITS = 33


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only where that is unset and all is one machine, as in tests, a temporary folder is made and set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir().rstrip("/")


#: What fresh_path named in this process and clean_up has not deleted.
_NAMED: list[str] = []


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    _NAMED.append(f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return _NAMED[-1]


def clean_up(spark: SparkSession) -> int:
    """Delete the intermediate files written so far, once the results that were made of them are written or collected;
    returns how many paths. Checkpoints go by spark.cleaner.referenceTracking.cleanCheckpoints."""
    jvm, conf, gone = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _NAMED:
        path = jvm.org.apache.hadoop.fs.Path(_NAMED.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage; the rows are in the shared folder, so a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; for wide rows, which compress well."""
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many underscores before it as make it new."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name = "_" + name
    return name


def with_partition_position(df: DataFrame, *order: Column) -> DataFrame:
    """Sort df by order over range partitions and add pid (partition) and pos (0-based place in it).

    The pair (pid, pos) sorts as order does. Rows equal in order are told apart by their place in the input, so that
    any number of equal rows still spreads over partitions. The caller cuts the lineage before using both columns.
    """
    keys = [*order, F.col("_tie")]
    return (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("pid", F.spark_partition_id())
        .withColumn("pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << POSITION_BITS) - 1)))
        .drop("_tie")
    )


def u01(*parts: Column) -> Column:
    """A uniform in [0, 1) from an MD5 of the parts; DuckDB computes the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


#: A side of at most so many rows (of under 100 bytes each) may be broadcast; a larger one is shuffled.
BROADCAST_ROWS = 400_000


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df, counted before, as the side of a join: broadcast if it is known to be small, else joined by a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def row_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in small batches, so that a task holds the Python objects of a few texts at a time.

    At the end of the task free memory goes back to the system: a reused worker would keep it.
    """
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
    gc.collect()
    give_back()


def give_back() -> None:
    """Hand free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass
