import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.components import connected_components


def brute_fingerprint(text):
    table = {c: c + 32 for c in range(65, 91)}
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in (text or "").translate(table)).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(prints[a] ^ prints[b]).count("1") <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_near_dedup_is_brute_force(spark):
    rng = random.Random(1)
    words = [f"W{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base[:6]:
        for _ in range(3):
            c = list(b)
            c[rng.randrange(60)] = "x"
            texts.append("\n".join(c))
    texts += [None, "", " \t", "one", "ONE", "one two", texts[0], "Ä Ö ü", "a\x1cb c"]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.fp & (2**64 - 1), r.component) for r in simhash.near_dedup(df).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: g[0] for i, g in got.items()} == prints
    assert {i: g[1] for i, g in got.items()} == brute_components(prints)
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert kept == set(brute_components(prints).values())


def test_index_finds_all_within_radius(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_SIZE", 64)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.int64)
    flips = np.int64(1) << rng.integers(0, 63, (600, 2)).astype(np.int64)
    prints = np.unique(np.concatenate([base, rng.choice(base, 600) ^ flips[:, 0] ^ flips[:, 1], np.arange(40)]))
    df = spark.createDataFrame([(int(f), i) for i, f in enumerate(prints)], "fp long, rep long")
    found = {r.node: r.component for r in connected_components(simhash.link_fingerprints(df)).collect()}
    near = np.bitwise_count((prints[:, None] ^ prints[None, :]).view(np.uint64)) <= 2
    label = np.arange(len(prints))
    while True:
        new = np.where(near, label[None, :], len(prints)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert [found.get(i, i) for i in range(len(prints))] == label.tolist()


def test_pieces_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = simhash.fingerprint(text)
    pieces = simhash._pieces
    monkeypatch.setattr(simhash, "_pieces", lambda data: pieces(data, 50))
    assert simhash.fingerprint(text) == whole


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d", 1), (5, "a b c d", 2), (5, "a b c d", 2)], "doc_id long, text string, fp int")
    rows = sorted(simhash.near_dedup(df).collect(), key=str)
    assert [r.component for r in rows if r.id is None] == [None] and [r.component for r in rows if r.id == 5] == [5, 5]
    assert simhash.near_dedup(df.where(F.lit(False))).count() == 0
    assert simhash.keep_one(df).columns == df.columns


def test_any_ids_and_names(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([("7", text, 1, 2), ("x", text, 3, 4), ("9", text, 5, 6)], "doc_id string, text string, gone int, _gone int")
    got = {r.id: r.component for r in simhash.near_dedup(df).collect()}
    assert got == {7: 7, 9: 7, None: None}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == [("7", text, 1, 2), ("x", text, 3, 4)]
