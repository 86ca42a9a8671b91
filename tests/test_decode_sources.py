from pyspark.sql import functions as F

from millrace.operators import decode


def test_equal_sources_are_searched_once_a_task(spark):
    calls = spark.sparkContext.accumulator(0)

    def make():
        copy = decode.copy_step(20)()

        def step(source, ids):
            calls.add(1)
            return copy(source, ids)

        return step

    source = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.array().cast("array<int>")).otherwise(F.array(*map(F.lit, (5, 6, 7))))
    rows = spark.range(3000).coalesce(1).select("id", source.alias("src_ids"), F.lit("x").alias("more"))
    got = decode.decode(rows, make, 10, width=2).collect()
    assert len(got) == 3000 and all(r.decoded == (None, [], [5, 6, 7])[r.id % 3] and r.src_ids == r.decoded and r.more == "x" for r in got)
    assert 0 < calls.value < 50


def test_best_takes_earlier_ones_first():
    assert decode.best([1.0, 3.0, 3.0, 2.0, 3.0], 3) == [1, 2, 4] and decode.best([1.0], 3) == [0]
