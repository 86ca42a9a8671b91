"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Within a source every document has the same expected number of copies, target / source size. The documents of a source
are put in the order of size and id, their expected copies are prefix-summed, one random offset of the source is added,
and a document is emitted once for each integer that its stretch of the sum crosses. Ordering by size makes the sample
stratified by size, so that the words taken come close to the target.

No source is gathered in one task: places within a source come from range partitions over (source, size, id), whose
row counts per partition and source are the only thing that is prefix-summed as a table (partitions + sources rows).

Defined results: a null text has size 0; a null source is a source of its own, last in order; a source of size 0 has
target 0 and none of its documents is emitted; repeated rows are documents of their own; a very long text is one document
that is taken whole; an empty table gives an empty table. Extra columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored, u01, with_partition_position

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row per source.

    The weights are dealt to the sources by code point, null last, and repeat. The targets share `share` times all
    sizes by weight; none exceeds `cap` times its source's size, and the excess is shared anew by weight until none is
    above. That fixed point is min(cap * size, level * weight) for one level, found from prefix sums over the sources
    in the order of cap * size / weight.
    """
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    ordered = sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    capped = ordered.select(
        "source",
        "source_size",
        F.element_at(dealt, ((F.col("_n") - 1) % len(weights) + 1).cast("int")).alias("_w"),
        (F.col("source_size") * F.lit(float(cap))).alias("_cap"),
        "_n",
    ).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio = Window.orderBy("_ratio", "_n")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = capped.select(
        "*",
        (
            (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
            / F.sum("_w").over(onward)
        ).alias("_level"),
    )
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_n", "_level"))).over(every)
    return levels.select("*", level.getField("_level").alias("_at")).select(
        "source", "source_size", F.least(F.col("_cap"), F.col("_at") * F.col("_w")).alias("target")
    )


def plan_mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 42,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies and taken, with the columns in `keep`
    as fields r0, r1 .. of a struct _rest."""
    reserved = [c for c in keep if c not in (id_col, source_col)]
    rest = F.struct(*[F.col(f"`{c}`").alias(f"r{k}") for k, c in enumerate(reserved)])
    rows = df.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.col(f"`{source_col}`").alias("_source"),
        word_count(F.col(f"`{text_col}`")).alias("_size"),
        *([rest.alias("_rest")] if reserved else []),
    )
    if not reserved:
        rows = cut(rows)  # range partitions are sampled first: words are counted once
    placed = with_partition_position(rows, F.col("_source"), F.col("_size"), F.col("_id"))
    placed = stored(placed, "mix") if reserved else cut(placed)
    parts = placed.groupBy("_source", "pid").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("pos").alias("_first"), F.sum("_size").alias("_part")
    )
    upto = Window.partitionBy("_source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(parts.withColumn("_before", F.coalesce(F.sum("_rows").over(upto), F.lit(0))))
    totals = parts.groupBy(F.col("_source").alias("source")).agg(F.sum("_part").alias("source_size"))
    targets = source_targets(totals, weights, share, cap).withColumnsRenamed({"source": "_of"})
    offsets = parts.join(targets, F.col("_source").eqNullSafe(F.col("_of"))).select(
        F.col("_source").alias("_of"),
        F.col("pid").alias("_pid"),
        (F.col("_before") - F.col("_first")).alias("_shift"),
        "source_size",
        "target",
        u01(F.lit(str(seed)), F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("n"))).alias("_offset"),
    )
    joined = placed.join(offsets, (F.col("pid") == F.col("_pid")) & F.col("_source").eqNullSafe(F.col("_of")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("pos") + F.col("_shift")
    crossed = F.floor(each * (place + 1) + F.col("_offset")) - F.floor(each * place + F.col("_offset"))
    copies = F.least(crossed, F.ceil(each)).cast("int")
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("_source").alias(source_col),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("_size")).cast("bigint").alias("taken"),
        *([F.col("_rest")] if reserved else []),
    )


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of df, each as often as it is taken, with df's columns."""
    numbered = df.toDF(*[f"c{k}" for k in range(len(df.columns))])  # names that cannot clash
    own = dict(zip(df.columns, numbered.columns))
    others = [c for c in numbered.columns if c not in (own[id_col], own[source_col])]
    planned = plan_mix(numbered, own[id_col], own[text_col], own[source_col], keep=others, **options)
    taken = planned.where(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    place = {c: f"_rest.r{k}" for k, c in enumerate(others)}
    return taken.select(*[F.col(place.get(c, c)) for c in numbered.columns]).toDF(*df.columns)
