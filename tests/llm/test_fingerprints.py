import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from millrace.llm import fingerprints as fp


def chain(values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else (v & (2**64 - 1)).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]


def brute_units(text):
    return [u for w in brute_words(text) for u in ([w] if len(w) <= fp.LONGEST else w)]


def brute_anchors(text, k=fp.K, s=fp.S):
    h = [chain([u]) for u in brute_units(text)]
    out = []
    for i in range(len(h) - k + 1):
        inner = [signed(chain(h[i + j : i + j + s])) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, chain(h[i : i + k])))
    return out


def brute_letters(text):
    n = len(brute_units(text))
    out = set()
    for w in set(brute_words(text)):
        seed = xxhash.xxh64_intdigest(w.encode(), 42)
        if xxhash.xxh64_intdigest((1).to_bytes(4, "little"), seed) >> 33 < 2**31 * fp.LETTERED / n:
            marked = f"\x02{w}\x03"
            out |= {chain([marked[i : i + 2]]) >> 32 for i in range(len(marked) - 1)}
    return out


def brute_sketch(text):
    return sorted({h >> 32 for _, h in brute_anchors(text)} | brute_letters(text))


def brute_likeness(a, b):
    return 2 * len({*a} & {*b}) / (len({*a}) + len({*b})) if a or b else 1.0


def brute_aligned(text, other):
    a, b = ([(i, h >> 32) for i, h in brute_anchors(t)] for t in (text, other))
    if not a and not b:
        return 1.0
    here = len({*a} & {*b})
    if 2 * here >= min(len(a), len(b)):
        return 2 * here / (len(a) + len(b))
    first = lambda x: {h: i for i, h in reversed(x)}
    counts = {}
    for h, i in first(a).items():
        if h in first(b):
            shift = first(b)[h] - i
            counts[shift] = counts.get(shift, 0) + 1
    shift = min(counts, key=lambda s: (-counts[s], s)) if counts else 0
    return 2 * len({(i + shift, h) for i, h in a} & {*b}) / (len(a) + len(b))


def made(n=30, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["é", "中文", "W1"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 40, 300]))) for _ in range(n)]
    han = lambda n: "".join(rng.choice("中文字符的一是不了人我在有他这为之大来以个") for _ in range(n))
    texts += [han(n) for n in (3, 17, 60, 300)] + [f"{han(40)} ab {han(5)}\tC{han(30)} d" * 3, "ΑΣ ΣΑΣ " * 9 + "x" * 40, "ab\n" * 30]
    texts += ["".join(rng.choice("ab \t") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    return [(i * 3, t) for i, t in enumerate(texts)] + [(1, None), (2, " \n"), (4, "x"), (500, texts[-1])]


def test_anchors_are_closed_syncmers(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(a.place, a.hash & (2**64 - 1)) for a in r.a] for r in df.select("doc_id", fp.anchors(F.col("text")).alias("a")).collect()}
    assert got == {i: brute_anchors(t) for i, t in rows}


def test_query_is_brute_force(spark, tmp_path):
    from millrace.llm.queries import queries

    rows = made()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries()["op10_document_fingerprints"](spark, str(tmp_path)).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r, own, new, other = got[i], brute_sketch(text), brute_sketch(edited), brute_sketch(after)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{h:08x}" for h in own)
        assert r.edited_fingerprint == "".join(f"{h:08x}" for h in new)
        assert abs(r.aligned_edited - brute_aligned(text, edited)) < 1e-12
        assert abs(r.near_edited - brute_likeness(own, new)) < 1e-12 and abs(r.near_next - brute_likeness(own, other)) < 1e-12


def test_edits_stay_near(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(400))) for i in range(20)]
    found = fp.with_next(spark.createDataFrame(rows, "doc_id long, text string"))
    found = found.select(
        fp.likeness(F.col("sketch"), fp.sketch(F.col("edited"))).alias("e"), fp.likeness(F.col("sketch"), F.col("next_sketch")).alias("n")
    ).collect()
    assert all(r.e > 0.5 and r.n < 0.2 for r in found)


def test_repeats_nulls_single_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, None), (1, "abcd"), (1, "efgh"), (2, "xyzw")], "doc_id long, text string")
    got = sorted((r.id or 0, r.text, r.edited) for r in fp.with_next(df).collect())
    assert got == [(0, "", ""), (0, "a b c d", "a b c "), (1, "abcd", "abcx"), (1, "efgh", "efgx"), (2, "xyzw", "xyza")]
    one = df.where("doc_id = 2")
    assert [r.edited for r in fp.with_next(one).collect()] == ["xyzx"]
    assert fp.with_next(df.where(F.lit(False))).count() == 0


def test_no_length_at_which_likeness_breaks_off(spark):
    rng = random.Random(1)
    rows = []
    for n in [*range(1, 40), 60, 100, 200, 400]:
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(n)]
        rows.append((n, " ".join(words), " ".join([*words, "added"]), " ".join(["first", *words])))
    df = spark.createDataFrame(rows, "n int, a string, b string, c string")
    near = [fp.likeness(fp.sketch(F.col("a")), fp.sketch(F.col(x))).alias(x) for x in "bc"]
    for r in df.select("n", *near).collect():
        assert r.b > 0.4 and r.c > 0.4, r
    packed = df.select("n", *[fp.packed_anchors(F.col(x)).alias(x) for x in "ac"]).collect()
    held = spark.createDataFrame([tuple(r) for r in packed], "n int, a array<bigint>, c array<bigint>")
    moved = {r.n: r.m for r in held.select("n", fp.aligned(F.col("a"), F.col("c")).alias("m")).collect()}
    for n, a, b, c in rows:
        assert abs(moved[n] - brute_aligned(a, c)) < 1e-12 and (n < 12 or moved[n] > 0.6)
    short = df.where("n < 6").select(fp.sketch(F.col("a")).alias("a")).collect()
    assert all(r.a for r in short) and len({tuple(r.a) for r in short}) == 5
    unlike = df.where("n = 4").select(fp.likeness(fp.sketch(F.col("a")), fp.sketch(F.lit("zzz yyy xxxx www"))).alias("l")).first()
    assert unlike.l == 0.0


def test_very_long_texts_through_the_query(spark, tmp_path):
    from millrace.llm.queries import queries

    rng = random.Random(5)
    rows = [(1, " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))), (2, "x" * 300_000), (3, "short one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries()["op10_document_fingerprints"](spark, str(tmp_path)).collect()}
    assert got[1].n_chars == len(rows[0][1]) and got[1].near_edited > 0.5 and got[1].aligned_edited > 0.3 and got[2].n_chars == 300_000


def test_texts_without_white_space(spark):
    rng = random.Random(4)
    han = [chr(c) for c in range(0x4E00, 0x5200)]
    rows = [(i, "".join(rng.choice(han) for _ in range(1200))) for i in range(8)] + [(100, "abcd efgh ijkl"), (101, "mnop qrst uvwx")]
    found = fp.with_next(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.id: (r.e, r.n) for r in found.select("id", fp.likeness(F.col("sketch"), fp.sketch_of(F.col("edited_marks.packed"), F.col("edited_marks.letters"))).alias("e"), fp.likeness(F.col("sketch"), F.col("next_sketch")).alias("n")).collect()}
    assert all(got[i][0] > (0.6 if i < 100 else 0.2) and got[i][1] < 0.1 for i in got), got


def test_a_passage_shared_by_long_texts_counts(spark):
    rng = random.Random(2)
    made_up = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    rows = []
    for i in range(12):
        shared, a, b = made_up(60), made_up(2000), made_up(2000)
        rows.append((i, " ".join(a[:700] + shared + a[700:]), " ".join(b[:1500] + shared + b[1500:])))
    inside, long = made_up(200), made_up(20_000)
    rows.append((12, " ".join(inside), " ".join(long[:9000] + inside + long[9000:])))
    df = spark.createDataFrame(rows, "doc_id long, a string, b string").select("doc_id", *[fp.sketch(F.col(c)).alias(c) for c in "ab"])
    got = {r.doc_id: (len(r.a), len(r.b), r.l) for r in df.withColumn("l", fp.likeness(F.col("a"), F.col("b"))).collect()}
    for i, a, b in rows:
        x, y = ({*brute_sketch(t)} for t in (a, b))
        assert got[i][:2] == (len(x), len(y)) and len(x & y) >= 15
        assert abs(got[i][2] - 2 * len(x & y) / (len(x) + len(y))) < 1e-12
