import json
import random

from pyspark.sql import functions as F

from millrace.functions import columns as fn
from millrace.functions import jsontext, xmltext
from millrace.operators import trees

SCALARS = [
    None, True, False, 0, 1, -5, 1.5, 1e-7, -2.5e-10, 1e21, 123456789.25, 0.0001, 0.00001, 1e15, 1e16, 1234567.5, 12345678901234567, "x",
    "a\nb\t\"\\ <&> \u2028 \x1f \x7f é 😀", "", "]]>",
]
NAMES = ["a", "b", "é", "Z/~", "<k>", '"q"', "\x01", ""]


def tree(rng, depth):
    kind = rng.randint(4, 9) if depth > 5 else rng.randint(0, 9)
    if kind < 2:
        return {rng.choice(NAMES) + str(rng.randint(0, 3)): tree(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if kind < 4:
        return [tree(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return rng.choice(SCALARS)


def forms(text):
    try:
        value = jsontext.parse(text)
    except ValueError:
        return None
    return jsontext.pretty(value), jsontext.compact(value), xmltext.to_xml(value)


def test_taken_apart_and_put_together(spark, monkeypatch):
    rng = random.Random(1)
    texts = [
        json.dumps([tree(rng, 0), tree(rng, 0), {"k": tree(rng, 0)}], ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(60)
    ]
    texts += ['{"a":1} x', "{", "", "1 2", " 3 ", '"s" ', '"s" "t"', "[1] ]", "[] {}", '{"a":1e400}', "nul", "null", None, '"a b"', "true false", '{"a":[{}]}', "[" * 12 + "]" * 12]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    monkeypatch.setattr(trees, "FOLDS", 4)
    got = {r.id: (r.pretty, r.compact, r.xml) for r in trees.assemble(trees.shred(df, ["id"], "t"), ["id"]).collect()}
    assert got == {k: forms(t) for k, t in enumerate(texts) if forms(t) is not None}


def test_rewrite_changes_strings_inside_only(spark):
    value = {"s": "t", "n": {"s": ["u", 1, None, {"k": "v"}]}}
    df = spark.createDataFrame([(1, json.dumps(value)), (2, '"root"'), (3, "no")], "id long, path string")
    got = {r.id: r.compact for r in trees.rewrite(df, "id", "path", lambda leaf, path: F.concat(leaf, F.lit("@"), path)).collect()}
    assert got == {1: '{"n":{"s":["u@/n/s/0",1,null,{"k":"v@/n/s/3/k"}]},"s":"t@/s"}', 2: '"root"'}
    assert trees.rewrite(df.where("false"), "id", "path", lambda leaf, path: leaf).count() == 0


def test_numbers_as_text(spark):
    rng = random.Random(2)
    values = [rng.choice([1, -1]) * rng.randint(1, 10**6) * 10.0 ** rng.randint(-20, 25) for _ in range(400)] + [0.0, -0.0, 1e15, 1e15 + 1, 1e21, 999999.5, 0.1, 1 / 3, 5e-324]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", fn.json_number("v").alias("j"), fn.xml_number("v").alias("x")).collect()
    assert [float(r.j) for r in rows] == values and [float(r.x) for r in rows] == [v if v else 0.0 for v in values]
    short = [r for r in rows if repr(r.v) == repr(float(f"{r.v:.6g}"))]
    assert len(short) > 300 and all(r.j == jsontext.number(r.v) and r.x == xmltext.number_text(r.v) for r in short if r.v != 5e-324)
