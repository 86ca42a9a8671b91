import hashlib
import random
import re
import zlib

import pytest

from millrace.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    children = {p: 0 for p in members}
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, some in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(some) - 1) * words(p[-1][1]) if p else 0
    return sorted(
        (min(some), len(p), min(members[p[:-1]]) if p else None, len(some), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(some) if len(built[c]) == len(p)).encode()).hexdigest())
        for p, some in members.items()
    )


def got(df, **names):
    return sorted(map(tuple, trie.prefix_trie(df, **names).select(COLUMNS).collect()))


def made(seed, convs=60, low=-25):
    rng = random.Random(seed)
    rows = []
    for c in range(low, low + convs):
        n = rng.choice([0, 1, 1, 2, 3, 4, 5, 9])
        for k in range(n):
            rows.append((c, rng.choice([k, k, k, None]), rng.choice(["u", "a", None]), rng.choice(["", "x", "x y", "z  z\tz", None])))
    twin = [(k, "u", "same same") for k in range(7)]
    rows += [(c, *t) for c in (300, 301, 302, 303, 340, 341) for t in twin] + [(360, *t) for t in twin + [(8, "u", "more")]]
    rows += [rows[0], rows[0], (None, 1, "u", "lost"), (10**15, 1, "u", "far"), (999, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def many_partitions(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def test_equals_brute_force_over_many_partitions(spark, many_partitions, monkeypatch):
    for seed, block in ((1, 64), (2, 2)):
        monkeypatch.setattr(trie, "BLOCK", block)
        monkeypatch.setattr(trie, "SPAN", 4)
        monkeypatch.setattr(trie, "PIECE", 2)
        rows = made(seed)
        assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_one_long_conversation_and_many_equal_ones(spark, many_partitions, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 8)
    long = [(k, "u", f"turn {k % 7}") for k in range(300)]
    rows = [(0, *t) for t in long] + [(100, *t) for t in long[:290]] + [(200, *t) for t in long[:-1] + [(299, "u", "other")]]
    rows += [(1000 + 20 * c, k, "u", "hot") for c in range(150) for k in range(2)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


def test_clashing_names_long_texts_and_empty_tables(spark):
    rows = [(1, 0, "u", "w " * 300_000), (20, 0, "u", "w " * 300_000), (40, 0, "a", "b"), (40, 1, "b", "")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("conv_id as `c.d`", "turn as place", "role as words", "text as code", "1 as conv", "2 as d", "3 as m")
    names = {"conv_col": "c.d", "turn_col": "place", "role_col": "words", "text_col": "code"}
    assert got(df, **names) == brute(rows)
    assert got(df.where("false"), **names) == []
    lone = spark.createDataFrame([(21, 0, "u", "taken away" if zlib.crc32(b"21") % 4 else "stays")], SCHEMA)
    assert got(lone) == brute([tuple(r) for r in lone.collect()])


def test_shared_prefixes_of_keys():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice(["p", "q"]) * trie.CODE for _ in range(rng.randint(0, 9))) for _ in range(2))
        want = 0
        while want < min(len(a), len(b)) // trie.CODE and a[want * trie.CODE] == b[want * trie.CODE]:
            want += 1
        assert trie.shared(a, b) == want
