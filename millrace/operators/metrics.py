"""Scores of predictions, and reports over them."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as fn


def word_edits(predicted: Sequence[str], expected: Sequence[str]) -> int:
    """Edit distance of words in characters: a change costs the longer word, a word left out or added its length."""
    row = [0]
    for w in predicted:
        row.append(row[-1] + len(w))
    for r in expected:
        last, row[0] = row[0], row[0] + len(r)
        for j, p in enumerate(predicted, 1):
            change = last if p == r else min(last + max(len(r), len(p)), row[j] + len(r), row[j - 1] + len(p))
            last, row[j] = row[j], change
    return row[-1]


@F.pandas_udf(T.LongType())
def word_edits_udf(predicted: pd.Series, expected: pd.Series) -> pd.Series:
    """Null where either is null."""
    pairs = zip(predicted, expected)
    return pd.Series([None if p is None or e is None else word_edits(p.split(), e.split()) for p, e in pairs], dtype="Int64")


def tier(exact: Column, semantic: Column, xml_ok: Column) -> Column:
    return F.when(exact, "EXACT").when(semantic, "SEMANTIC").when(xml_ok, "XML_OK").otherwise("FAIL")


def score(predictions: DataFrame) -> DataFrame:
    """(sample_id, expected, predicted) with exact, semantic, xml_ok, char_edits, word_edits, their lengths and tier.

    Texts are compared with white space collapsed; distances are only computed where they differ. A null text counts as
    an empty one, which is no document; equal rows are scored each; an empty table gives an empty table.
    """
    filled = predictions.withColumns({c: F.coalesce(c, F.lit("")) for c in ("predicted", "expected")})
    norm = filled.withColumn("_p", fn.normalise_space("predicted")).withColumn("_e", fn.normalise_space("expected"))
    exact = F.col("_p") == F.col("_e")
    scored = norm.withColumn("exact", exact).withColumn("xml_ok", fn.xml_document("predicted"))
    scored = scored.withColumn("semantic", F.col("exact") | fn.xml_same_meaning("predicted", "expected"))
    scored = scored.withColumn("char_edits", F.when(F.col("exact"), 0).otherwise(F.levenshtein("_p", "_e")))
    scored = scored.withColumn("word_edits", F.coalesce(word_edits_udf(F.when(~F.col("exact"), F.col("_p")), F.when(~F.col("exact"), F.col("_e"))), F.lit(0)))
    return scored.withColumn("ref_chars", F.length("_e")).withColumn("tier", tier(F.col("exact"), F.col("semantic"), F.col("xml_ok"))).drop("_p", "_e")


def error_rates(scored: DataFrame) -> DataFrame:
    """Micro averages: all edits over all characters expected."""
    size = F.greatest(F.sum("ref_chars"), F.lit(1))
    return scored.agg(
        (F.sum("char_edits") / size).alias("cer"), (F.sum("word_edits") / size).alias("wer"),
        (F.count_if(F.col("exact")) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("exact_rate"), F.count(F.lit(1)).alias("n"),
    )


def by_tier(scored: DataFrame) -> DataFrame:
    return scored.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def length_bucket(n: Column) -> Column:
    return F.when(n < 256, "<256").when(n < 512, "<512").when(n < 1024, "<1024").otherwise(">=1024")


def length_report(rows: DataFrame, ok: str = "xml_ok", src: str = "src_len", tgt: str = "tgt_len", time: str = "elapsed") -> DataFrame:
    return rows.groupBy(length_bucket(F.col(src)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(ok)).alias("ok"), F.avg(src).alias("avg_src"), F.avg(tgt).alias("avg_tgt"), F.avg(time).alias("avg_time")
    )


def index_percentiles(df: DataFrame, column: str, shares: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """For each share q the element at place int(n * q) of the sorted values, and min and max; exact at any size.

    Values are counted first; only the distinct ones are placed, over range partitions.
    """
    from .placing import materialised

    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    dealt = materialised(counts.repartitionByRange("v").withColumn("_part", F.spark_partition_id()))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(F.sum("c").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    inside = Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("_upto", F.sum("c").over(inside)).join(F.broadcast(parts.select("_part", "_before")), "_part")
    end = F.col("_before") + F.col("_upto")
    n = F.broadcast(parts.agg(F.sum("_c").alias("_n")))
    hits = placed.select("v", "c", end.alias("_end")).join(n)
    at = [F.floor(F.col("_n") * F.lit(q)) for q in shares]
    return hits.agg(
        *[F.max(F.when((F.col("_end") > a) & (F.col("_end") - F.col("c") <= a), F.col("v"))).alias(f"p{round(q * 100)}") for q, a in zip(shares, at)],
        F.min("v").alias("min"), F.max("v").alias("max"),
    )


def running_max(df: DataFrame, group: Sequence[str], order: str, column: str, name: str = "running_max") -> DataFrame:
    """df with the largest value so far within the group, as for peak memory over steps; nulls do not count. A group is
    one run's log."""
    upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.max(column).over(upto))


def weighted_loss(tokens: DataFrame, group: Sequence[str], content_weight: float, structural_max: int = 15) -> DataFrame:
    """(label, loss) to sum(loss * weight) / max(sum(weight), 1); label -100 does not count, structural ones weigh 1."""
    w = F.when(F.col("label") == -100, 0.0).when(F.col("label") <= structural_max, 1.0).otherwise(F.lit(float(content_weight)))
    return tokens.groupBy(*group).agg((F.sum(F.col("loss") * w) / F.greatest(F.sum(w), F.lit(1.0))).alias("loss"))


def token_mean_loss(batches: DataFrame) -> DataFrame:
    """sum(loss * n) / sum(n) of batches; 0 where there is no token."""
    total = F.sum("n")
    return batches.agg(F.when(total > 0, F.sum(F.col("loss") * F.col("n")) / total).otherwise(F.lit(0.0)).alias("mean_loss"))


def best_epoch(log: DataFrame) -> DataFrame:
    """The epoch with the most exact answers, the lower loss where equal."""
    return log.agg(F.max_by("epoch", F.struct(F.col("ar_exact"), (-F.col("val_loss")).alias("l"), (-F.col("epoch")).alias("e"))).alias("best_epoch"))
