"""Samples, permutations, splits and batches whose order is a hash of seed and key."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.rng import u01

#: Lower bounds in bytes of the length strata after the first.
STRATA = (1500, 2500, 3500, 4500)
#: Rows of a bucket of hashes, and the most buckets.
BUCKET, MOST_BUCKETS = 10_000, 1 << 16


def length_range(df: DataFrame, column: str = "input", least: int = 0, most: int = 4769) -> DataFrame:
    """Rows whose text has least to most bytes; 0 lifts a bound."""
    n = F.octet_length(column)
    keep = F.lit(True)
    if least:
        keep = keep & (n >= least)
    if most:
        keep = keep & (n <= most)
    return df.where(keep)


def stratum(n: Column, bounds: Sequence[int] = STRATA) -> Column:
    """Number of the stratum of a length: 0 below the first bound."""
    return let(n, lambda n: functools.reduce(lambda found, b: found + (n >= b).cast("int"), bounds, F.lit(0)))


def _drawn(df: DataFrame, group: str, key: str, seed: int, draw: str) -> DataFrame:
    """The group, the key and the uniform `_u` of each row, kept beside the texts: all that ranks need."""
    from .placing import materialised

    return materialised(df.select(group, u01(seed, key, draw).alias("_u"), F.col(key).alias("_key")))


def _first(df: DataFrame, drawn: DataFrame, takes: DataFrame, group: str, key: str, seed: int, draw: str) -> DataFrame:
    """Rows whose rank by uniform and key within the group is at most the group's `_take`, without ranking whole groups in one task.

    The uniform is cut into buckets of about BUCKET rows; counts per bucket say in which bucket the last row taken lies, and
    only that bucket is ranked. The last row of each of the few groups is then a bound in a filter, so that the rows are read
    once more and nothing is made of those left out. Rows that share a group's last key are ranked if not all of them fit.
    """
    buckets = min(MOST_BUCKETS, max(256, drawn.count() // BUCKET))
    drawn = drawn.withColumn("_bucket", F.floor(F.col("_u") * buckets).cast("int"))
    counts = drawn.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    edge = counts.join(takes, group).where((F.col("_before") < F.col("_take")) & (F.col("_before") + F.col("_n") >= F.col("_take")))
    edge = drawn.join(F.broadcast(edge.select(group, "_bucket", (F.col("_take") - F.col("_before")).alias("_left"))), [group, "_bucket"])
    edge = edge.withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("_u", "_key")))
    tied = edge.groupBy(group, "_left", "_u", "_key").agg(F.min("_rank").alias("_from"), F.count(F.lit(1)).alias("_equal"))
    last = tied.where((F.col("_from") <= F.col("_left")) & (F.col("_from") + F.col("_equal") > F.col("_left")))
    last = last.withColumn("_fit", F.col("_left") - F.col("_from") + 1).collect()  # a row for each group at most
    split = {r[group]: r["_fit"] for r in last if r["_fit"] < r["_equal"]}
    row = F.struct(F.col(group).alias("_group"), F.struct(u01(seed, key, draw).alias("_u"), F.col(key).alias("_key")).alias("_place"))

    def compared(row: Column, those: list, how: Callable[[Column, Column, object], Column]) -> Column:
        found = F.lit(False)
        for r in those:
            bound = F.struct(F.lit(r["_u"]).alias("_u"), F.lit(r["_key"]).cast(drawn.schema["_key"].dataType).alias("_key"))
            found = found | (row["_group"].eqNullSafe(F.lit(r[group])) & how(row["_place"], bound, r[group]))
        return found

    below = lambda place, bound, g: place < bound if g in split else place <= bound
    most = max((r["_u"] for r in last), default=-1.0)
    kept = df.where((u01(seed, key, draw) <= most) & let(row, lambda r: compared(r, last, below)))
    if not split:
        return kept
    fit = F.create_map(*[F.lit(x) for pair in split.items() for x in pair])
    at = let(row, lambda r: compared(r, [x for x in last if x[group] in split], lambda place, bound, g: place == bound))
    ranked = df.where(at).withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(key)))
    return kept.unionByName(ranked.where(F.col("_rank") <= fit[F.col(group)]).drop("_rank"))


def stratified_sample(df: DataFrame, pct: float, column: str = "input", key: str = "sample_id", seed: int = 42, bounds: Sequence[int] = STRATA) -> DataFrame:
    """The same number of rows from each length stratum, floor(keep / strata) with keep = floor(n * pct / 100).

    What a short stratum lacks is taken from the others' spare rows, lower strata first. Adds `stratum`.
    """
    spark, strata = df.sparkSession, len(bounds) + 1
    rows = df.withColumn("stratum", stratum(F.octet_length(column), bounds))
    every = spark.range(strata).select(F.col("id").cast("int").alias("stratum"))
    drawn = _drawn(rows, "stratum", key, seed, "stratified")
    counts = every.join(drawn.groupBy("stratum").agg(F.count(F.lit(1)).alias("cnt")), "stratum", "left").fillna(0)
    whole = Window.orderBy("stratum").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # `strata` rows
    lower = Window.orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
    quota = F.floor(F.floor(F.sum("cnt").over(whole) * pct / 100) / strata)
    plan = counts.withColumn("q", quota).select(
        "stratum", "cnt", "q", F.greatest(F.col("cnt") - F.col("q"), F.lit(0)).alias("spare"), F.greatest(F.col("q") - F.col("cnt"), F.lit(0)).alias("short")
    )
    plan = plan.withColumn("missing", F.sum("short").over(whole)).withColumn("before", F.coalesce(F.sum("spare").over(lower), F.lit(0)))
    extra = F.least(F.col("spare"), F.greatest(F.col("missing") - F.col("before"), F.lit(0)))
    takes = plan.select("stratum", (F.least("cnt", "q") + extra).alias("_take"))
    return _first(rows, drawn, takes, "stratum", key, seed, "stratified")


def random_sample(df: DataFrame, pct: float, key: str = "sample_id", seed: int = 42) -> DataFrame:
    """Exactly floor(n * pct / 100) rows."""
    one = df.withColumn("_all", F.lit(1))
    drawn = _drawn(one, "_all", key, seed, "random")
    takes = drawn.groupBy("_all").agg(F.floor(F.count(F.lit(1)) * pct / 100).alias("_take"))
    return _first(one, drawn, takes, "_all", key, seed, "random").drop("_all")


def permutation(df: DataFrame, key: str = "sample_id", seed: int = 42, skip: int = 0) -> DataFrame:
    """Rows with `place`, their 0-based place in a seeded order, from `skip` on; places come from range partitions."""
    from .placing import with_place

    placed = with_place(df.withColumn("_u", u01(seed, key, "permutation")), [F.col("_u"), F.col(key)], "place").drop("_u")
    return placed.where(F.col("place") >= skip)


def split(df: DataFrame, order: Column, val_share: float = 0.1) -> DataFrame:
    """Rows with `split`: the last floor(n * val_share) in order are val, the others train."""
    from .placing import with_place

    placed = with_place(df, [order], "_place")
    n = df.count()
    return placed.withColumn("split", F.when(F.col("_place") >= n - int(n * val_share), "val").otherwise("train")).drop("_place")


def hash_split(df: DataFrame, key: str = "sample_id", seed: int = 42, val_pct: float = 10.0) -> DataFrame:
    """Disjoint train and val by a hash of the key: no row in both, whatever else is sampled."""
    return df.withColumn("split", F.when(u01(seed, key, "split") * 100 < val_pct, "val").otherwise("train"))


def bernoulli(df: DataFrame, pct: float, key: str = "sample_id", seed: int = 42, draw: str = "gate") -> DataFrame:
    return df.where(u01(seed, key, draw) * 100 < pct)


def fan_out(df: DataFrame, variants: int, name: str = "variant_no") -> DataFrame:
    """Each row 1 + variants times, numbered from 0, the natural one."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(variants))))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "k") -> DataFrame:
    """The first k rows of each group in the order, numbered from 1. Each task cuts its part of a group to k rows before the
    shuffle, so that a group of any size comes down to k rows a task; equal rows stand in any order."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, place).where(F.col(name) <= k)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of tables with the same columns, by name; repeated rows stay."""
    for df in others:
        first = first.unionByName(df)
    return first


def batches(df: DataFrame, size: int, order: Column, name: str = "batch_id") -> DataFrame:
    from .placing import with_place

    return with_place(df, [order], "_place").withColumn(name, F.floor(F.col("_place") / size)).drop("_place")
