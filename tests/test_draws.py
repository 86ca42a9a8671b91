from pyspark.sql import functions as F

from millrace.functions.rng import u01
from millrace.operators import corrupt


def test_draws_made_once_are_the_same(spark):
    d = corrupt.Draws(42, F.col("id"), F.concat(F.lit("text:"), F.col("p")))
    places = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: u01(42, "id", F.concat(F.lit("text:"), F.col("p"), F.lit(".t"), i.cast("string"))))
    once = d.once(("t",), lambda d: F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: d.u("t", i)))
    hits = d.once(("t",), lambda d: F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: d.hit(0.3, "t", i)))
    rows = spark.createDataFrame([(1, "/a"), (None, "/b")], "id long, p string").select(places.alias("a"), once.alias("b"), hits.alias("c")).collect()
    assert all(r.a == r.b and r.c == [u < 0.3 for u in r.a] for r in rows)
