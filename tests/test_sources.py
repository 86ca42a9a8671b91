import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import jsonl
from millrace.streaming import streams


def test_pairs_round_trip(spark, tmp_path):
    rows = [("a <b> & \" \\ \n \u00e9 \u2028", "t1"), ("{}", "t2")]
    df = spark.createDataFrame(rows, jsonl.PAIR)
    jsonl.write_pairs(df, f"{tmp_path}/out", shards=2)
    lines = [line for f in (tmp_path / "out").glob("part-*") for line in f.read_text().splitlines()]
    assert sorted((json.loads(x)["input"], json.loads(x)["target"]) for x in lines) == sorted(rows)
    assert all("<" not in x and "&" not in x and "\u2028" not in x for x in lines)


def test_reading_skips_what_is_no_pair(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"input":"x","target":"y","more":1}\n\nnot json\n{"input":"","target":"y"}\n{"input":"{\\"tool\\":{}}","target":"z"}\n')
    (tmp_path / "b.txt").write_text('{"input":"no","target":"no"}\n')
    assert sorted(r.target for r in jsonl.read_pairs(spark, str(tmp_path)).collect()) == ['y', 'z']
    assert jsonl.read_pairs(spark, str(tmp_path)).count() == 2
    assert [r.target for r in jsonl.read_pairs(spark, str(tmp_path), "tool").collect()] == ["z"]
    assert [r.target for r in jsonl.read_pairs(spark, str(tmp_path), "answer").collect()] == ["y"]
    with pytest.raises(Exception):
        jsonl.read_pairs(spark, str(tmp_path), strict=True).collect()


def test_lines_and_dictionary(spark, tmp_path):
    (tmp_path / "x.txt").write_text("  one \n\n\ttwo\n")
    got = jsonl.read_lines(spark, f"{tmp_path}/x.txt", numbered=True).collect()
    assert sorted(map(tuple, got)) == [(1, "one"), (3, "two")]
    (tmp_path / "words").write_text("Apple\nit's\nab\nÖl\nzoo \n")
    assert sorted(r.word for r in jsonl.read_dictionary(spark, f"{tmp_path}/words").collect()) == ["apple", "zoo", "öl"]


def test_wrap_stream(spark, tmp_path):
    good = json.dumps({"thought": "long enough text", "answer": "a"})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text(f"{good}\nbroken\n\n")
    q = streams.wrap_stream(streams.stream_lines(spark, f"{tmp_path}/in"), f"{tmp_path}/ok", f"{tmp_path}/bad", f"{tmp_path}/cp")
    q.awaitTermination(120)
    (tmp_path / "in" / "2.txt").write_text(f"{good}\n")
    q = streams.wrap_stream(streams.stream_lines(spark, f"{tmp_path}/in"), f"{tmp_path}/ok", f"{tmp_path}/bad", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/ok").count() == 2
    assert [r.reason for r in spark.read.parquet(f"{tmp_path}/bad").select("reason").collect()] == ["invalid_json"]


def test_windowed_counts(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 120).alias("ts"), F.lit("a").alias("event_type"))
    rows.write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/ev")
    q = streams.windowed_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from counted").first()[0] == 100


def test_heads_orders_dictionaries_and_counts(spark, tmp_path):
    for name, text in (("b.jsonl", "3\n4\n"), ("a.jsonl", "1\n\n2\n"), ("c.jsonl", "5\n")):
        (tmp_path / name).write_text(text)
    got = jsonl.read_head(spark, str(tmp_path), 4).orderBy("line_no").collect()
    assert [tuple(r) for r in got] == [(1, "1"), (2, ""), (3, "2"), (4, "3")]
    assert jsonl.line_count(spark, str(tmp_path)).first().n == 6
    assert jsonl.newest(spark, str(tmp_path)).endswith("c.jsonl") and jsonl.newest(spark, str(tmp_path), "*.none") is None
    lines = spark.createDataFrame([("b",), (None,), ("B",), ("é",)], "value string")
    assert [r.value for r in jsonl.sorted_lines(lines).collect()] == [None, "B", "b", "é"]
    words = tmp_path / "words"
    words.write_text("ab\nDon't\n Apple \n")
    assert [r.word for r in jsonl.read_dictionary(spark, str(words), ["x"]).collect()] == ["apple"]
    words.write_text("ab\n")
    assert [r.word for r in jsonl.read_dictionary(spark, str(words), ["pool"]).collect()] == ["pool"]
    assert [r.word for r in jsonl.read_dictionary(spark, str(tmp_path / "none"), ["pool"]).collect()] == ["pool"]
    with pytest.raises(ValueError):
        jsonl.read_pairs(spark, str(tmp_path), required=True)
    log = spark.createDataFrame([(1, 0.5), (2, 0.4)], "epoch int, loss double")
    for _ in range(2):
        jsonl.write_log(log, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
