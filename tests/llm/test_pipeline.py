import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import quality
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash import brute_components, brute_fingerprint

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(6, 14)))
    rows, labels = [], []
    for i in range(160):
        text = "\n".join(sentence() for _ in range(rng.randint(1, 8)))
        bad = i % 5 == 0
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, "en", f"s{i % 3}"))
        labels.append((i, int(not bad), 0))
    rows += [(200 + k, rows[3][1], "en", "s1") for k in range(4)] + [(300, rows[4][1].replace(rows[4][1][5], "q", 1), "en", "s0")]
    rows += [(400, None, None, None), (401, "", "de", "s2")]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.withColumn("n_chars", F.length("text").cast("bigint")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_each_stage_is_its_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    good = stages[0](spark, docs, folder).cache()
    assert good.columns == first and {r.doc_id for r in good.collect()} == want
    clean = [i for i in range(160) if i % 5]
    assert len([i for i in clean if i in want]) > 0.9 * len(clean) and not any(i in want for i in range(0, 160, 5))
    lined = stages[1](spark, good, folder).cache()
    assert lined.columns == first
    texts = {r.doc_id: r.text for r in lined.collect()}
    before = [(r.doc_id, r.text) for r in good.collect()]
    assert {i: t for i, t in texts.items() if t is not None} == brute_lines(before, 20)
    single = stages[2](spark, lined, folder).cache()
    assert single.columns == first
    assert {r.doc_id for r in single.collect()} == set(brute_components({i: brute_fingerprint(t) for i, t in texts.items()}).values())
    mixed = stages[3](spark, single, folder).cache()
    assert mixed.columns == first and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in single.collect()}
    last = stages[4](spark, mixed, folder).collect()
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert len(last) == mixed.count()
    for r in last:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_run_is_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, docs.collect()))
