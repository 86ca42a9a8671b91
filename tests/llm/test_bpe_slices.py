import pyarrow as pa

from millrace.llm import bpe
from millrace.llm.queries import tokenizer_path


def test_texts_of_a_task_come_a_few_at_a_time(spark):
    vocabulary = bpe.Vocabulary.load(tokenizer_path("word_bpe_49k.json"))
    df = spark.range(1000).coalesce(1).selectExpr("id AS doc_id", "'a text' AS text")
    work = lambda v: lambda texts: [pa.array([len(texts)] * len(texts), pa.int64())]
    rows = bpe._mapped(df, vocabulary, ["doc_id"], "text", {"n": "bigint"}, work).collect()
    assert len(rows) == 1000 and max(r.n for r in rows) <= 256
