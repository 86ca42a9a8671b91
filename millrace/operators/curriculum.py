"""Training curricula: stage parameters, when a stage advances, and learning rates; folds over a run's ordered log.

A run's log has one row per epoch, so that one run fits a row; runs are independent groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stage, type, aug_ratio, special_prob, corrupt_pct, compact_pct, sample_pct, dict_word_pct,
#: drop_memory_pct, truncate_pct, pf_noise, val_max_batches (null: all).
STAGES = (
    (1, "all", 0, 0.0, 0.0, 50.0, 100.0, 0.0, 50.0, 0.0, 0.15, 50),
    (2, "all", 3, 0.15, 5.0, 50.0, 100.0, 0.0, 50.0, 5.0, 0.25, 500),
    (3, "all", 3, 0.25, 10.0, 50.0, 100.0, 0.0, 50.0, 10.0, 0.40, 5000),
    (4, "all", 3, 0.35, 15.0, 50.0, 100.0, 0.0, 50.0, 20.0, 0.55, None),
)
STAGE_SCHEMA = (
    "stage int, type string, aug_ratio int, special_prob double, corrupt_pct double, compact_pct double, sample_pct double, "
    "dict_word_pct double, drop_memory_pct double, truncate_pct double, pf_noise double, val_max_batches int"
)


def stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STAGES), STAGE_SCHEMA)


def with_parameters(df: DataFrame, stage: str = "stage") -> DataFrame:
    """df with the parameters of its stage."""
    return df.join(F.broadcast(stages(df.sparkSession)), stage, "left")


def advance(log: DataFrame, run: str, threshold: float, patience: int, last: int, epoch: str = "epoch", rate: str = "rate") -> DataFrame:
    """(run, epoch, rate) with stage before and after: `patience` epochs in a row at threshold or more lead to the next
    stage, where counting starts anew; the last stage stays."""

    def step(acc: Column, x: Column) -> Column:
        good = F.when((x["rate"] >= threshold) & (acc["stage"] < last), acc["streak"] + 1).otherwise(F.lit(0))
        up = good >= patience
        after = acc["stage"] + up.cast("int")
        row = F.struct(x["epoch"].alias("epoch"), x["rate"].alias("rate"), acc["stage"].alias("stage"), after.alias("stage_after"))
        return F.struct(after.alias("stage"), F.when(up, 0).otherwise(good).alias("streak"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    ordered = F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("bigint").alias("epoch"), F.col(rate).cast("double").alias("rate"))))
    none = F.expr("cast(array() as array<struct<epoch:bigint,rate:double,stage:int,stage_after:int>>)")
    start = F.struct(F.lit(1).alias("stage"), F.lit(0).alias("streak"), none.alias("rows"))
    folded = log.groupBy(run).agg(ordered.alias("_log")).withColumn("_end", F.aggregate("_log", start, step))
    return folded.select(run, F.explode("_end.rows").alias("r")).select(run, "r.*")


def streaks(log: DataFrame, run: str, threshold: float, epoch: str = "epoch", rate: str = "rate") -> DataFrame:
    """Runs of epochs at threshold or more: gaps and islands with windows."""
    w = Window.partitionBy(run).orderBy(epoch)
    marked = log.withColumn("_good", F.col(rate) >= threshold)
    island = marked.withColumn("_island", F.sum(F.when(F.col("_good"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.where("_good").groupBy(run, "_island").agg(F.min(epoch).alias("first_epoch"), F.max(epoch).alias("last_epoch"), F.count(F.lit(1)).alias("length")).drop("_island")


def loss_change(log: DataFrame, run: str, every: int = 2, epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """The loss and the one of `every` epochs before."""
    return log.withColumn("previous", F.lag(loss, every).over(Window.partitionBy(run).orderBy(epoch)))


def schedule(
    log: DataFrame, run: str, base: float, threshold: float, patience: int, last: int, lr_patience: int, factor: float = 0.5,
    least: float = 1e-6, epoch: str = "epoch", rate: str = "rate", error: str = "error",
) -> DataFrame:
    """(run, epoch) with the stage and the learning rate after each epoch, both together: the rate falls on plateaus as in
    `plateau`, stages rise as in `advance`, and a new stage starts over with half the base rate and nothing to beat.
    An epoch whose error is null does not count for the plateau."""

    def step(acc: Column, x: Column) -> Column:
        seen, better = x["error"].isNotNull(), F.coalesce(x["error"] < acc["best"] * (1 - 1e-4), F.lit(False))
        idle = F.when(~seen, acc["idle"]).when(better, 0).otherwise(acc["idle"] + 1)
        fall = seen & (idle > lr_patience)
        slower = F.when(fall, F.greatest(acc["lr"] * factor, F.lit(least))).otherwise(acc["lr"])
        good = F.when((x["rate"] >= threshold) & (acc["stage"] < last), acc["streak"] + 1).otherwise(F.lit(0))
        up = good >= patience
        stage = acc["stage"] + up.cast("int")
        lr = F.when(up, F.lit(base / 2)).otherwise(slower)
        best = F.when(up, F.lit(float("inf"))).when(better, x["error"]).otherwise(acc["best"])
        row = F.struct(x["epoch"].alias("epoch"), stage.alias("stage"), lr.alias("lr"))
        return F.struct(
            best.alias("best"), F.when(fall | up, 0).otherwise(idle).alias("idle"), lr.alias("lr"), stage.alias("stage"),
            F.when(up, 0).otherwise(good).alias("streak"), F.concat(acc["rows"], F.array(row)).alias("rows"),
        )

    entry = F.struct(F.col(epoch).cast("bigint").alias("epoch"), F.col(rate).cast("double").alias("rate"), F.col(error).cast("double").alias("error"))
    none = F.expr("cast(array() as array<struct<epoch:bigint,stage:int,lr:double>>)")
    start = F.struct(
        F.lit(float("inf")).alias("best"), F.lit(0).alias("idle"), F.lit(float(base)).alias("lr"), F.lit(1).alias("stage"),
        F.lit(0).alias("streak"), none.alias("rows"),
    )
    folded = log.groupBy(run).agg(F.array_sort(F.collect_list(entry)).alias("_log")).withColumn("_end", F.aggregate("_log", start, step))
    return folded.select(run, F.explode("_end.rows").alias("r")).select(run, "r.*")


def plateau(log: DataFrame, run: str, base: float, patience: int, factor: float = 0.5, least: float = 1e-6, epoch: str = "epoch", error: str = "error") -> DataFrame:
    """Learning rate after each epoch: multiplied by factor after more than `patience` epochs without a lower error.

    An epoch whose error is null (nothing was exact, so none was measured) changes nothing.
    """

    def step(acc: Column, x: Column) -> Column:
        seen, better = x["error"].isNotNull(), F.coalesce(x["error"] < acc["best"] * (1 - 1e-4), F.lit(False))
        bad = F.when(~seen, acc["bad"]).when(better, 0).otherwise(acc["bad"] + 1)
        cut = seen & (bad > patience)
        lr = F.when(cut, F.greatest(acc["lr"] * factor, F.lit(least))).otherwise(acc["lr"])
        row = F.struct(x["epoch"].alias("epoch"), lr.alias("lr"))
        return F.struct(
            F.when(better, x["error"]).otherwise(acc["best"]).alias("best"), F.when(cut, 0).otherwise(bad).alias("bad"),
            lr.alias("lr"), F.concat(acc["rows"], F.array(row)).alias("rows"),
        )

    ordered = F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("bigint").alias("epoch"), F.col(error).cast("double").alias("error"))))
    none = F.expr("cast(array() as array<struct<epoch:bigint,lr:double>>)")
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(float(base)).alias("lr"), none.alias("rows"))
    folded = log.groupBy(run).agg(ordered.alias("_log")).withColumn("_end", F.aggregate("_log", start, step))
    return folded.select(run, F.explode("_end.rows").alias("r")).select(run, "r.*")
