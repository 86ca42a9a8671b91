import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import quality


def corpus(n=240, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 300))]
        bad = i % 3 == 0
        if bad:  # one bad passage makes a bad document
            at = rng.randrange(len(text))
            text[at : at + 64] = [w.upper() + "!!" for w in text[at : at + 64] or ["no"]]
        rows.append((i, " ".join(text)))
        labels.append((i, int(not bad)))
    return rows, labels


def test_held_out_accuracy_and_order(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(docs, known)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert set(got) == {i for i, _ in rows}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    flags = {r.doc_id: r.h for r in docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()}
    assert [i for i in flags if flags[i]] == held
    truth = dict(labels)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.85
    again = {r.doc_id: r.score for r in quality.score(docs.repartition(3), quality.train(docs, known)).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in again)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    x, bag, y = rng.normal(size=(9, 5)), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    model = quality.fit(x, bag, y, 0.5, hidden=4, gate=3, steps=1)

    def loss():
        p = model.scores(x, bag, 3)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, g in model.gradients(x, bag, y).items():
        flat, g = model.weights[k].reshape(-1), g.reshape(-1)
        for j in range(len(flat)):
            kept = flat[j]
            flat[j] = kept + 1e-6
            up = loss()
            flat[j] = kept - 1e-6
            down = loss()
            flat[j] = kept
            assert abs((up - down) / 2e-6 - g[j]) < 1e-6


def test_slices_do_not_change_encodings(monkeypatch):
    texts = [t.encode() for _, t in corpus(30)[0]] + [b"", b" \n", b"x"]
    x, owner = quality.encode_passages(texts)
    parts = [(a + first, e) for first, some in (monkeypatch.setattr(quality, "SLICE", 700) or quality._slices(texts))
             for e, a in [quality.encode_passages(some)]]
    assert np.allclose(np.concatenate([e for _, e in parts]), x)
    assert np.array_equal(np.concatenate([a for a, _ in parts]), owner)


def test_nulls_unlabelled_and_empty(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (None, "a b", 0.2), (1, None, 0.3), (2, "", 0.4)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert model is None
    assert sorted(r.score for r in quality.score(docs, model).collect()) == [0.5] * 4
    rows, labels = corpus(60)
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = quality.score(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.where(F.lit(False)), model).count() == 0


def naive_features(text):
    """One encoding per passage, word by word and byte by byte."""
    data = text.encode()
    spans, at = [], 0
    for k, b in enumerate(data + b" "):
        if b == 32 or 9 <= b <= 13:
            if at < k:
                spans.append((at, k))
            at = k + 1
    if not spans:
        return [np.zeros(quality.FEATURES)]
    mask, mix = 2**64 - 1, int(quality._MIX)

    def mixed(h):
        h = h * mix & mask
        return (h ^ (h >> 32)) * mix & mask

    low = lambda b: (b + 32 if 65 <= b <= 90 else b) + 1
    out = []
    for first in range(0, len(spans), quality.PASSAGE):
        some = spans[first : first + quality.PASSAGE]
        start = 0 if first == 0 else some[0][0]
        end = len(data) if first + quality.PASSAGE >= len(spans) else spans[first + quality.PASSAGE][0]
        inside, words = data[start:end], [data[s:e] for s, e in some]
        classes = np.bincount([quality._CLASS[b] for b in inside], minlength=quality._CLASSES)
        hashes = [mixed((sum(low(b) * int(quality._PLACES[k % 4096]) for k, b in enumerate(w)) + len(w)) & mask) for w in words]
        tri = [mixed(low(inside[k]) << 18 | low(inside[k + 1]) << 9 | low(inside[k + 2])) for k in range(len(inside) - 2)]
        lengths = np.array([len(w) for w in words], dtype=float)
        big = [65 <= w[0] <= 90 for w in words]
        shout = [b and len(w) > 1 and 65 <= w[1] <= 90 for b, w in zip(big, words)]
        dense = [len(words), lengths.mean() / 10, min(lengths.std() / 10, 5), len(set(hashes)) / len(words)]
        dense += [sum(a == b for a, b in zip(hashes, hashes[1:])) / len(words), np.mean(big), np.mean(shout)]
        dense += [np.mean([quality._CLASS[w[-1]] >= 7 for w in words])]
        dense[0] = np.log1p(dense[0])
        buckets = [np.bincount([h >> 56 for h in some], minlength=256) / max(1, len(some)) for some in (hashes, tri)]
        out.append(np.concatenate([np.sqrt(classes / classes.sum()), dense, *map(np.sqrt, buckets)]))
    return out


def test_features_and_scores_are_those_of_a_loop():
    texts = [t for _, t in corpus(8)[0]] + ["", " \n\t", "Ab, AB! ab ab", "naïve 中文 " * 70, "x" * 5000 + " y"]
    x, owner = quality.encode_passages([t.encode() for t in texts])
    want = [naive_features(t) for t in texts]
    assert owner.tolist() == [k for k, some in enumerate(want) for _ in some]
    assert np.allclose(x, np.concatenate(want))
    model = quality.fit(x, owner, np.arange(len(texts)) % 2.0, 0.5, steps=5)
    w = model.weights
    for k, score in enumerate(model.scores(x, owner, len(texts))):
        hidden, weight = [], []
        for features in want[k]:
            z = np.clip((features - model.centre) / model.scale, -6, 6)
            h = np.tanh(z @ w["encode"] + w["encode_b"])
            gate = 1 / (1 + np.exp(-(h @ w["u"])))
            hidden.append(h)
            weight.append(np.exp((np.tanh(h @ w["v"]) * gate) @ w["attend"]))
        r = sum(a / sum(weight) * h for a, h in zip(weight, hidden))
        assert abs(score - 1 / (1 + np.exp(-(r @ w["score"] + w["score_b"][0])))) < 1e-9


def test_words_are_learnt(spark):
    """Two kinds of documents that differ in nothing but which words they have."""
    rng = random.Random(6)
    kinds = [["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(40)] for _ in range(2)]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(rng.randint(30, 200)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int"))
    got = {r.doc_id: r.predicted for r in quality.score(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i] == i % 2 for i in held]) > 0.95


def test_the_sample_is_bounded(spark, monkeypatch):
    rows, labels = corpus(120)
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, *rest: seen.append(x.shape) or fit(x, *rest))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    quality.train(docs, known, max_passages=40)
    quality.train(docs, known, longest=2)
    assert seen[0][0] <= 40 and seen[0][0] > 20 and 0 < seen[1][0] < 120


def test_any_names(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5, 3, "x")], "doc_id long, text string, score double, Predicted int, `_text` string")
    assert quality.score(docs, None, keep=tuple(docs.columns)).columns == ["doc_id", "text", "_text", "score", "predicted"]
    good = quality.keep_good(docs, None)
    assert good.columns == docs.columns and [tuple(r) for r in good.collect()] == [(1, "a b", 0.5, 3, "x")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "`i.d` long, `q.y` int")
    dotted = spark.createDataFrame([(1, "a b c"), (2, "### !!!")], "`i.d` long, `t.x` string")
    model = quality.train(dotted, labels, "i.d", "t.x", "q.y")
    assert quality.score(dotted, model, "t.x", keep=("i.d",)).columns == ["i.d", "score", "predicted"]
