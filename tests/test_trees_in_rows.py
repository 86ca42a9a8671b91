import json
import random

from pyspark.sql import functions as F

from millrace.operators import augment, trees

from .test_trees import forms, tree


def test_trees_inside_rows(spark):
    rng = random.Random(7)
    texts = [
        json.dumps([tree(rng, 0), {"k": tree(rng, 0)}], ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(60)
    ]
    texts += ['{"a":1} x', "{", "", "1 2", " 3 ", '"s" ', '"s" "t"', "[1] ]", "[] {}", '{"a":1e400}', "nul", "null", None, '"a b"', "true false", '{"a":[{}]}', "[" * 12 + "]" * 12]
    texts += [json.dumps({f"k{i}": [i, str(i)] for i in range(3 * trees.CHUNK)}), json.dumps([[], {}, [[]], {"b": {}, "a": [{}]}])]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: tuple(r.x) for r in df.select("id", trees.rendered(trees.parsed(F.col("t"))).alias("x")).collect() if r.x is not None}
    assert got == {k: forms(t) for k, t in enumerate(texts) if forms(t) is not None}


def test_places_are_those_of_rows(spark):
    texts = ['{"b":[1,{"x/~":"s"},"t"],"a":{"c":null,"":true}}', '[[],["u"]]', '"root"']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    fields = ("path", "top", "depth", "level", "kind", "name", "leaf", "number")
    rows = {tuple(r) for r in trees.shred(df, ["id"], "t").select("id", *fields).collect()}
    inside = df.select("id", F.explode(trees.parsed(F.col("t"))).alias("n")).select("id", *[F.col(f"n.{c}").alias(c) for c in fields])
    assert {tuple(r) for r in inside.collect()} == rows


def test_variants_are_made_without_shuffle_or_files(spark):
    pairs = spark.range(8).select(F.col("id").alias("sample_id"), F.lit('{"thought":"a b","memory":["x"]}').alias("input"), F.lit("<x/>").alias("target"))
    plan = augment.make_variants(pairs, augment.Settings())._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "parquet" not in plan.lower()
