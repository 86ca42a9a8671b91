import random

from pyspark.sql import functions as F

from millrace.llm import common, lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows, min_chars, max_edits=1):
    """The lines that stay, by comparing every line with all before it."""
    seen, result = [], {}
    for i, text in sorted((i, t) for i, t in rows if t is not None):
        kept = []
        for line in text.split("\n"):
            if line.strip():
                allowed = lambda s: min(max_edits, min(len(s), len(line)) // min_chars)
                near = any(line == s or (abs(len(s) - len(line)) <= allowed(s) and distance(s, line) <= allowed(s)) for s in seen)
                seen.append(line)
                if near:
                    continue
            kept.append(line)
        result[i] = "\n".join(kept)
    return result


def made(seed, n=40):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 30))) for _ in range(25)]
    base += ["same but for the last 0", "aaaaaaaaaaaaaaaaaaaaaaaaaa"]
    rows = []
    for i in range(n):
        some = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(base)
            kind, at = rng.randrange(5), rng.randrange(len(s))
            some.append([s, s[:at] + s[at + 1 :], s[:at] + "x" + s[at:], s[:at] + rng.choice("yz") + s[at + 1 :], "  "][kind])
        rows.append((i, "\n".join(some)))
    return rows


def test_is_brute_force(spark, monkeypatch):
    for seed, rows_broadcast in ((1, 400_000), (2, 0)):
        monkeypatch.setattr(common, "BROADCAST_ROWS", rows_broadcast)
        rows = made(seed) + [(900, None), (901, ""), (902, "\n\n"), (903, "same but for the last 7\nsame but for the last 8")]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r.doc_id: r for r in lines.dedup_lines(df, min_chars=10).collect()}
        want = brute(rows, 10)
        assert {i: r.text for i, r in got.items() if r.text is not None} == want
        assert got[900].text is None and got[900].n_lines == 0 and got[901].n_kept == 1
        assert all(r.n_kept == len(r.text.split("\n")) for i, r in got.items() if want.get(i))


def test_exact_only_nulls_repeats_and_clashing_names(spark):
    rows = [(None, "a\na", 1), (1, "a\na\nb", 2), (2, "b\nc", 3), (2, "b\nc", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    got = lines.dedup_lines(df, max_edits=0)
    assert got.columns == ["doc_id", "text", "n_lines", "_n_lines", "n_kept"]
    assert sorted((r.doc_id or 0, r.text, r._n_lines, r.n_kept) for r in got.collect()) == [
        (0, "a\na", 2, 2), (1, "a\nb", 3, 2), (2, "c", 2, 1), (2, "c", 2, 1),
    ]
    assert lines.dedup_lines(df.where(F.lit(False))).count() == 0


def test_variants_are_deletions():
    weights = lines._weights(50)
    for line in ("abcdef", "aab", "é", "ab"):
        keys, places = lines.variants(line, True, True, weights)
        assert places.tolist() == [-1, *range(len(line))]
        for key, at in zip(keys[1:], places[1:]):
            assert key == lines.variants(line[:at] + line[at + 1 :], False, False, weights)[0][0]


def test_very_long_lines_match_within_one_edit(spark):
    rng = random.Random(5)
    long = "".join(rng.choices("abcé ", k=130_000))
    texts = [long, long[:90_000] + "x" + long[90_001:], long[:40] + long[41:], long + "y", long[:5] + "zz" + long[7:], long[::-1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_kept for r in lines.dedup_lines(df).collect()} == {0: 1, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1}


def test_variants_in_blocks_and_close_texts():
    rng = random.Random(6)
    weights = lines._weights(100)
    assert (lines._weights(1000)[:100] == weights).all()
    for n in (8, 9, 14, 40):
        line = "".join(rng.choices("abé", k=n))
        for first, second in ((True, True), (True, False), (False, True), (False, False)):
            keys, places = (sum((p.tolist() for p in parts), []) for parts in zip(*lines.variant_blocks(line, first, second, weights, 7)))
            want = lines.variants(line, first, second, weights)
            assert keys == want[0].tolist() and places == want[1].tolist()
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randrange(6))) for _ in range(2))
        assert lines.within_one(a, b) == (distance(a, b) <= 1)


def test_two_edits_are_brute_force(spark):
    rng = random.Random(8)
    rows = []
    base = ["".join(rng.choice("ab") for _ in range(rng.randint(4, 14))) for _ in range(12)]
    base += ["".join(rng.choice("abé ") for _ in range(rng.randint(8, 30))) for _ in range(25)]
    for i in range(60):
        some = []
        for _ in range(rng.randint(1, 5)):
            s = rng.choice(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(s) + 1)
                s = [s[:at] + s[at + 1 :], s[:at] + rng.choice("ax") + s[at:], s[:at] + rng.choice("by") + s[at + 1 :]][rng.randrange(3)]
            some.append(s)
        rows.append((i, "\n".join(some)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for min_chars in (4, 8):
        got = {r.doc_id: r.text for r in lines.dedup_lines(df, max_edits=2, min_chars=min_chars).collect()}
        assert got == brute(rows, min_chars, 2)
        assert got != brute(rows, min_chars, 1)


def test_distances():
    rng = random.Random(3)
    for _ in range(4000):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(8))) for _ in range(2))
        assert [lines.within(a, b, k) for k in range(3)] == [distance(a, b) <= k for k in range(3)]


def test_one_header_before_many_lines(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lines, "small_side", lambda df, rows: seen.append(rows) or common.small_side(df, rows))
    header = "This file is distributed under the license named below, part "
    text = "\n".join(f"{header}{i:06d} {i * 7919 % 1000003:07d}" for i in range(100_000))
    df = spark.createDataFrame([(1, text), (2, text[:1000])], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_kept) for r in lines.dedup_lines(df).collect()}
    assert max(seen) >= 100_000  # what is guarded are the lines, not the keys that they share
    assert got[1] == (100_000, 100_000)


def test_any_names(spark):
    df = spark.createDataFrame([(1, "a", 1, 2, 3, 4)], "doc_id long, text string, n_lines int, _n_lines int, _lines int, doc int")
    got = lines.dedup_lines(df)
    assert got.columns == [*df.columns, "__n_lines", "n_kept"] and got.collect()[0][:6] == (1, "a", 1, 2, 3, 4)
