import pytest
from pyspark.sql import functions as F

from millrace.functions import columns as fn
from millrace.functions.rng import u01
from millrace.operators import sampling


def test_a_sample_makes_nothing_of_rows_left_out(spark):
    rows = spark.range(400).select(F.col("id").alias("sample_id"), F.repeat(F.lit("x"), (F.col("id") * 12).cast("int")).alias("input"))
    rows = rows.withColumn("target", fn.json_to_xml("input"))
    made = sampling.stratified_sample(rows, 50)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert made.count() == 200


@pytest.mark.parametrize("pct", [0, 10, 37, 100])
def test_rows_that_share_keys_and_null_keys(spark, pct):
    rows = spark.range(300).select(F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("sample_id"), F.col("id").alias("n"))
    got = sampling.random_sample(rows, pct).collect()
    order = [r.sample_id for r in rows.withColumn("u", u01(42, "sample_id", "random")).orderBy("u", "sample_id").collect()]
    assert len({r.n for r in got}) == len(got) and sorted(map(str, (r.sample_id for r in got))) == sorted(map(str, order[: 300 * pct // 100]))
