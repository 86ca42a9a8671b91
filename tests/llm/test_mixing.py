import random
import re

from pyspark.sql import functions as F

from millrace.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Sharing and resharing as the rule says, until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, total, target = set(names), share * sum(sizes.values()), {}
    while left:
        unit = total / sum(weight[s] for s in left)
        above = {s for s in left if unit * weight[s] > cap * sizes[s]}
        if not above:
            target |= {s: unit * weight[s] for s in left}
            break
        for s in above:
            target[s] = cap * sizes[s]
            total -= target[s]
        left -= above
    return target


def made(seed=1, n=400):
    rng = random.Random(seed)
    sources = ["a", "b", "é", "Z", None, "c"]
    rows = []
    for i in range(n):
        source = rng.choices(sources, [10, 1, 3, 1, 2, 5])[0]
        rows.append((i, " \n".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), source))
    return rows + [(n, None, "a"), (n + 1, "", "empty"), (0, "again w", "a"), (0, "again w", "a"), (None, "x y", "b")]


def test_plan_follows_the_rules(spark):
    for seed in (1, 2, 3):
        rows = made(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(1)).repartition(4)
        got = mixing.plan_mix(df).collect()
        assert len(got) == len(rows)
        sizes = {}
        for _, t, s in rows:
            sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        want = brute_targets(sizes)
        taken, most = {}, max(r.size for r in got)
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
            assert r.taken == r.copies * r.size and r.copies <= 2
            taken[r.source] = taken.get(r.source, 0) + r.taken
        assert all(abs(taken[s] - want[s]) <= 2 * most for s in sizes)
        again = mixing.plan_mix(df.repartition(7)).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))


def test_copies_are_prefix_sum_crossings(spark):
    rows = made(5)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan_mix(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for some in by.values():
        total = sum(r.copies for r in some)
        each = some[0].target / some[0].source_size if some[0].source_size else 0
        assert abs(total - each * len(some)) <= 1
        assert {r.copies for r in some} <= {int(each), int(each) + 1} or each in (0, 1, 2)


def test_mix_emits_rows(spark):
    rows = made(7)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    plan = mixing.plan_mix(df)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == plan.agg(F.sum("copies")).first()[0]
    words = mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == plan.agg(F.sum("taken")).first()[0]
    assert mixing.mix(df.where(F.lit(False))).count() == 0 and mixing.plan_mix(df.where(F.lit(False))).count() == 0


def test_main_path_is_native(spark):
    df = spark.createDataFrame(made(), "doc_id long, text string, source string")
    plan = mixing.plan_mix(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_names_of_other_columns_do_not_matter(spark):
    rows = made(9, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(str, (tuple(r) for r in mixing.mix(df).collect())))
    names = ("_id", "_of", "_rest", "_source", "_size", "copies", "target", "pid", "pos", "c0", "a.b", "size")
    wide = df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    got = mixing.mix(wide)
    assert got.columns == wide.columns and sorted(str(tuple(r)[:3]) for r in got.collect()) == want
    assert all(tuple(r)[3:] == tuple(range(len(names))) for r in got.collect())
    dotted = df.toDF("i.d", "t.x", "s.c")
    got = mixing.mix(dotted, "i.d", "t.x", "s.c")
    assert got.columns == dotted.columns and sorted(str(tuple(r)) for r in got.collect()) == want
