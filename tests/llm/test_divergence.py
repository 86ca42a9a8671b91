import random
from collections import Counter, defaultdict

import numpy as np

from millrace.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def terms_of(text):
    out, word = [], ""
    for ch in text + " ":
        if ch > "\x7f" or ("a" <= ch.lower() <= "z" and ch.isascii()):
            word += ch.lower() if ch.isascii() else ch
        elif word:
            out.append(word)
            word = ""
    return out


def brute(rows, min_docs, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source, found = lang or "", source or "", terms_of(text or "")
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    want = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        v = len(kept)
        total = sum((counts[lang, s] for s in sources), Counter())
        p = {}
        for s, c in [*((s, counts[lang, s]) for s in sources), (None, total)]:
            n = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            parts = {
                "pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s],
                "term": [(f(p[s][t], p[None][t]), t) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]],
            }
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                for k, (value, item) in enumerate(found[: top if part == "term" else None], 1):
                    want.append((lang, s, part, item, value, k))
    return sorted(want)


def made(seed, n=150):
    rng = random.Random(seed)
    words = ["Ab", "aB", "zoo", "été", "ÉTÉ", "x1y", "über-all", "Z", "日本", "a b", "it's"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [
        (i, rng.choice([" ", "\n", ", "]).join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S2", "ü", None]))
        for i in range(n)
    ]
    rows += [(n, None, "en", "s1"), (n + 1, "", "none", "q"), (n + 2, "1 2", "none", "r"), (None, "zoo zoo", "en", "only"), rows[0], rows[0]]
    return rows


def got(df, **options):
    return sorted(map(tuple, divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()))


def test_equals_brute_force(spark, monkeypatch):
    rows = made(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(df, min_docs=10, top=10) == brute(rows, 10, 10)
    monkeypatch.setattr(divergence, "CELLS", 30)  # many blocks
    monkeypatch.setattr(divergence, "PAIRS", 7)  # many bands
    assert got(df, min_docs=2, top=3) == brute(rows, 2, 3)


def test_nothing_kept_and_nothing_given(spark):
    rows = made(2)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df, min_docs=10_000) == brute(rows, 10_000, 10)
    assert got(df.where("false")) == []


def test_names_may_clash_and_texts_be_long(spark):
    rows = [(0, "aa bb " * 400_000, "en", "x"), (1, "aa " + "c" * 3_000_000, "en", "y"), (2, "ééé", "en", "y")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("text as `t.x`", "lang as term", "source as n", "doc_id as source", "1 as lang", "2 as d")
    assert got(df, lang_col="term", source_col="n", text_col="t.x", min_docs=1) == brute(rows, 1, 10)


def test_shares_are_exact_beyond_64_bits_of_product():
    rng = random.Random(3)
    for _ in range(300):
        total, v = rng.randint(1, 10**15), rng.randint(1, 10**9)
        count = rng.randint(0, total)
        want = 1 + 10**9 * (count + 2) // (total + 2 * v)
        if count + 2 <= total + 2 * v:
            assert int(divergence.shares(np.array([count]), np.array([total]), v)[0]) == want
    big = np.array([10**9 + 1]), np.array([1])
    assert int(divergence.divergence(*big)[0]) == 10**18 // (10**9 + 2)


def test_long_texts_are_split_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 5)
    text = "Aa bbbbbbbbb, c É-dd  eeeee"
    assert [t for some in divergence.term_lists(text.encode()) for t in some] == [t.encode() for t in terms_of(text)]
