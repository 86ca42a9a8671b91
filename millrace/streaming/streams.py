"""Structured Streaming twins: the operators are stateless maps, so the batch functions apply to streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import gates
from ..sources.jsonl import PAIR


def stream_pairs(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(PAIR).option("maxFilesPerTrigger", files_per_trigger).json(path)


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Trimmed lines that are not blank as `raw`."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("raw")).where("raw <> ''")


def wrap_stream(lines: DataFrame, accepted: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Lines through the wrap gates into two Parquet tables. A batch that is repeated after a failure overwrites its own
    part, so that no row is lost or doubled."""

    def write(batch: DataFrame, number: int) -> None:
        gated = gates.wrap(batch).persist()
        good, bad = gated.where("reason IS NULL").select("input", "target"), gated.where("reason IS NOT NULL").select("raw", "reason")
        good.write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        gated.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts by event-time window with a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), by, "n"
    )
