"""Dense places of rows in an order, without a window over all rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def materialised(df: DataFrame) -> DataFrame:
    """df computed once and kept as Parquet in the folder that spark.checkpoint.dir names."""
    sc = df.sparkSession.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="millrace-"))
        folder = sc.getCheckpointDir()
    path = f"{folder.rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_place(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """df with the 0-based place of each row in the order.

    Rows are dealt to range partitions and sorted there; a place is the place inside the partition plus the rows of the
    partitions before, of which one count each is summed up. Rows that are equal in the order stand as in the input, so
    that any number of them spreads over partitions.
    """
    order = [*order, F.col("_tie")]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = materialised(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", place))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(counts), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: for few files whose rows are costly to work on."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
