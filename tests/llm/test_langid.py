import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid

SCHEMA = "doc_id long, text string, lang string"
WORDS = {
    "a": "the of and thing shore ringly was from".split(),
    "b": "die und schön für über zeit ungen bei".split(),
    "c": "что это как время слово дом привет и".split(),
    "d": "日本語 東京に 今日は です ます 言葉".split(),
}


def made(seed=1, n=240):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(1, 25))), lang) for i in range(n) for lang in [rng.choice("aabcd")]]


def brute_path(scores, ids, penalty):
    """The best path of one text by a plain loop; ties as the operator's: the first language, and staying before moving."""
    value, back = list(scores[ids[0]].astype(float)), []
    for w in ids[1:]:
        top = max(range(len(value)), key=lambda k: (value[k], -k))
        from_ = [top if value[top] - penalty > v else k for k, v in enumerate(value)]
        value = [max(v, value[top] - penalty) + float(s) for v, s in zip(value, scores[w])]
        back.append(from_)
    state = max(range(len(value)), key=lambda k: (value[k], -k))
    out = [state]
    for from_ in reversed(back):
        state = from_[state]
        out.append(state)
    return out[::-1]


def test_paths_equal_a_loop():
    rng = np.random.default_rng(1)
    for languages in (1, 2, 5):
        scores = -rng.integers(0, 7, (40, languages)).astype(np.float32)
        sizes = np.array([3, 0, 50, 1, 0, 17, 17, 200])
        ids = rng.integers(0, 40, sizes.sum())
        got = langid.paths(scores, ids, sizes, 4.0)
        first = 0
        for n in sizes:
            if n:
                assert got[first : first + n].tolist() == brute_path(scores, ids[first : first + n], 4.0)
            first += n
    assert len(langid.paths(np.zeros((0, 2), np.float32), np.zeros(0, int), np.zeros(3, int), 1.0)) == 0


def test_words_do_not_depend_on_pieces(monkeypatch):
    text = "Über die ½ Dörfer, été 日本語東京に" + "語" * 60 + " x" * 30 + " " + "y" * 55
    whole = langid._WORD.findall(text)
    for piece in (1, 2, 7, 24, 30, 1000):
        monkeypatch.setattr(langid, "PIECE", piece)
        if piece < 30:  # a piece holds a word at least
            continue
        pairs = [p for some in langid.words_of(text) for p in some]
        assert [w for w, _ in pairs] == whole and all(text[at : at + len(w)] == w for w, at in pairs)


def test_word_scores_equal_a_loop():
    rng = np.random.default_rng(3)
    model = langid.Model.of_counts(["p", "q"], rng.integers(0, 50, (2, 512)), np.eye(2, len(langid._NAMES)) * 100)
    words = ["Ab", "été", "x", "я", "ab"]
    got = model.word_scores(words)
    for w, row in zip(words, got):
        bucket, _, script, _ = langid.features([w], 512)
        total = model.logs[bucket].sum(axis=0) / 3
        mine = model.scripts[script].any(axis=0)
        mine = mine if mine.any() else ~mine
        want = [max(t - max(total[mine]), -langid.FLOOR) if ok else -langid.OUT for t, ok in zip(total, mine)]
        assert np.allclose(row, want, atol=1e-4)
    assert (got[0] == got[4]).all()
    assert len(langid.features(["ab"], 512)[0]) == 1 + 2 + 3 + 2 + 1  # the word, and 1 to 4 code points with its edges


def test_predicts_and_keeps_to_the_contract(spark):
    rows = made() + [(1000, None, "a"), (1001, "", "b"), (1002, " ½ 12 ².", None), (1003, "die zeit und the of and thing shore was", None), (None, "привет", None), (2000, "the", "a"), (2000, "the", "a")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = langid.train(df)
    assert model.languages == ["a", "b", "c", "d"]
    got = langid.identify(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002)) and by[None].lang_pred == "c"
    assert by[1003].lang_pred == "a" and 0 < by[1003].score < 1
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([by[i].lang_pred == lang for i, _, lang in rows[:240]]) == 1


def test_held_out_rows_and_labels_are_not_inputs(spark):
    rows = made(2)
    away = [(i, t, "b" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    one, two = (langid.train(spark.createDataFrame(r, SCHEMA).repartition(2)) for r in (rows, away))
    assert one.languages == two.languages and (one.logs == two.logs).all() and (one.scripts == two.scripts).all()
    df = spark.createDataFrame(rows, SCHEMA)
    held = {r.doc_id: r.h for r in df.select("doc_id", langid.held_out(F.col("doc_id")).alias("h")).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in held}


def test_spans_of_a_mixed_text(spark):
    model = langid.train(spark.createDataFrame(made(3), SCHEMA))
    parts = ["the thing was from shore", "und für die zeit über", "что это как время"]
    text = ", ".join(parts) + ". 今日は"
    df = spark.createDataFrame([("k", text), ("none", None), ("empty", "12")], "name string, `t.x` string")
    got = langid.spans(df, model, "name", "t.x").orderBy("span").collect()
    assert [(r.lang, text[r.begin : r.begin + r.length]) for r in got] == [*zip("abc", parts), ("d", "今日は")]
    assert [r.span for r in got] == [0, 1, 2, 3]


def test_long_texts_small_batches_and_clashing_names(spark):
    model = langid.train(spark.createDataFrame(made(4), SCHEMA))
    long = " ".join(random.Random(1).choices(WORDS["b"], k=60_000)) + "時" * 100
    rows = [(1, long), (2, "z" * 200_000), (3, "the"), (4, long[:-100])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as id", "2 as score", "3 as lang_pred").repartition(1)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, model).collect()}
    assert got[1][0] == got[4][0] == "b" and got[3][0] == "a" and got[4][1] > 0.99 and len(got) == 4
    labeller = [x for x in langid._labelled(model, 8.0, iter([t for _, t in rows] * 3), lambda t: (None, langid._plain_words(t)))]
    assert sum(len(x[0]) for x in labeller) == 12


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = langid.train(none)
    assert model.languages == [] and langid.identify(none, model).count() == 0
    unknown = langid.identify(spark.createDataFrame([(1, "text", None)], SCHEMA), model).collect()
    assert [tuple(r) for r in unknown] == [(1, "und", 0.0)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy(spark):
    from millrace.llm.queries import QUERIES

    found = QUERIES["op13_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = found.where("held_out").join(docs, "doc_id")
    assert held.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
