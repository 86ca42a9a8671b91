"""Session factory with the settings the engine is designed around."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession


def get_spark(
    master: str | None = None,
    app: str = "millrace",
    shuffle_partitions: int | None = None,
    driver_memory: str = "6g",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with adaptive execution on; on a cluster leave master unset, so that spark-submit decides."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": driver_memory,
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=conf | (extra or {})).getOrCreate()
