import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import columns as fn
from millrace.functions import jsontext, xmltext
from millrace.functions.rng import u01
from millrace.operators import augment, corrupt, curriculum, decode, enrich, gates, generate, metrics, sampling, tokens, wording

SAMPLE = json.dumps({"title": "a, b: {c}", "name": "q\"uote", "n": [1, 2, 3], "o": {"s": "x y", "t": True, "k": [[1], [2]]}}, indent=2)


def seeded(spark, text, step, n=200):
    """What a column function makes of one text for n keys; step takes the text and the key."""
    df = spark.range(n).select("id", F.lit(text).alias("t"))
    return [r.x for r in df.select(step(F.col("t"), F.col("id")).alias("x")).collect()]


def test_corruptions_touch_structure_only(spark):
    strings = ('"a, b: {c}"', '"q\\"uote"')
    for name, _ in corrupt.STEPS:
        outs = seeded(spark, SAMPLE, lambda t, k, name=name: corrupt.single(name, t, k, 7))
        assert len(set(outs)) > 1 and outs == seeded(spark, SAMPLE, lambda t, k, name=name: corrupt.single(name, t, k, 7)), name
        assert all(isinstance(x, str) for x in seeded(spark, "", lambda t, k, name=name: corrupt.single(name, t, k, 7), 5))
        assert seeded(spark, None, lambda t, k, name=name: corrupt.single(name, t.cast("string"), k, 7), 2) == [None, None]
        if name in ("comma", "colon", "trailing", "whitespace", "bracket"):
            assert all(s in o for o in outs for s in strings), name
        if name == "quote":
            assert all(o.count('"') <= SAMPLE.count('"') for o in outs)
        if name == "bracket":
            assert all(abs(len(o) - len(SAMPLE)) <= len(SAMPLE) for o in outs)
    draws = lambda k: corrupt.Draws(1, k, "x")
    for text in ('{"a b": "http://x"}', '{"abc'):
        assert set(seeded(spark, text, lambda t, k: corrupt.strip_quotes(t, draws(k), 1.0), 3)) == {text}
    assert {x.replace(" ", "") for x in seeded(spark, "1,2", lambda t, k: corrupt.drop_commas(t, draws(k), 1.0), 9)} == {"12"}
    assert set(seeded(spark, '{"a":[1,{}] \n}', lambda t, k: corrupt.add_trailing_commas(t, draws(k), 1.0), 3)) == {'{"a":[1,{},] \n,}'}
    runs = seeded(spark, '{"a":[[1] ]}', lambda t, k: corrupt.mangle_brackets(t, draws(k)), 400)
    assert len(set(runs)) > 8 and '{"a":[[1] ]}' in runs and all(x.startswith('{"a":[[1') for x in runs)


def test_literals_of_any_length(spark):
    for n, inside in ((0, True), (1, False), (2, True), (3, False)):
        text = '"' + "\\" * n + '", x'
        assert seeded(spark, text, lambda t, k: corrupt.drop_commas(t, corrupt.Draws(1, k, "x"), 1.0), 1)[0].count(",") == (not inside)
    long = json.dumps({"a": "\n\"x, " * 100_000, "b": [[]] * 20_000})
    out = seeded(spark, long, lambda t, k: corrupt.drop_commas(t, corrupt.Draws(1, k, "x"), 1.0), 1)[0]
    assert out.count(",") == 100_000 and all(seeded(spark, long, lambda t, k: corrupt.corrupted(t, F.lit("heavy"), k, 1), 4))


def test_profiles(spark):
    by = lambda name, n=200: seeded(spark, SAMPLE, lambda t, k: corrupt.corrupted(t, F.lit(name), k, 3), n)
    assert set(by("none", 20)) == set(by("no such name", 20)) == {SAMPLE}
    assert corrupt.named("light+wrapper").wrapper == 1.0 and corrupt.named("light").quote == 0.3
    assert sum(x != SAMPLE for x in by("heavy")) > 190
    df = spark.range(300).select(F.col("id").alias("sample_id"), F.lit(SAMPLE).alias("input"), F.lit("t").alias("target"))
    one = {r.sample_id: r.input for r in corrupt.corrupt_lines(df.repartition(1), 7).collect()}
    many = {r.sample_id: r.input for r in corrupt.corrupt_lines(df.repartition(8), 7).collect()}
    assert one == many and len(set(one.values())) > 50


def test_wrap_gates(spark):
    good = {"thought": "0123456789", "answer": "x"}
    cases = [
        ("{", "invalid_json"), ("[1]", "not_object"), ("null", "missing_thought"), ("{}", "missing_thought"),
        (json.dumps({"thought": "0123456789"}), "answer_or_tool"), (json.dumps({**good, "tool": {}}), "answer_or_tool"),
        (json.dumps({**good, "thought": "012345678"}), "short_thought"), (json.dumps({**good, "thought": "éé€€"}), None),
        (json.dumps({**good, "thought": 5}), "short_thought"), (json.dumps({**good, "memory": []}), "bad_memory"),
        (json.dumps({**good, "memory": "m"}), "bad_memory"), (json.dumps({**good, "memory": None}), None),
        (json.dumps({**good, "answer": "\u0001"}), "invalid_xml"), ("  " + json.dumps(good) + "\t", None),
    ]
    df = spark.createDataFrame([(k, raw) for k, (raw, _) in enumerate(cases)] + [(99, "  ")], "line_no long, raw string")
    got = {r.line_no: r for r in gates.wrap(df).collect()}
    assert {k: r.reason for k, r in got.items()} == {k: reason for k, (_, reason) in enumerate(cases)}
    assert got[13].input == jsontext.pretty(good) and got[13].target == xmltext.to_xml(good)


def test_repair_gates(spark):
    text = json.dumps({"a": "x" * 600})
    cases = [
        (None, text, text, "bad_record"), (text, text + "]", text, "fix_a_invalid_json"), (text, text, "{", "fix_b_invalid_json"),
        (text, text, json.dumps({"a": "x" * 550}), None), (text, text, json.dumps({"a": "x" * 549}), "fixes_disagree"),
        (text[:-1], text, text, None), ("y" * 600, text, text, "too_many_changes"), ('{"a":1', '{"a":1}', '{"a":1}', "too_many_changes"),
    ]
    df = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "k long, original string, fix_a string, fix_b string")
    assert {r.k: r.reason for r in gates.repair(df).collect()} == {k: c[3] for k, c in enumerate(cases)}


def test_byte_distance_is_brute_force(spark):
    rng = random.Random(3)

    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    pairs = [("".join(rng.choice("aé中") for _ in range(rng.randint(0, 9))), "".join(rng.choice("aé中") for _ in range(rng.randint(0, 9)))) for _ in range(200)]
    for a, b in pairs:
        want = brute(a.encode(), b.encode())
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fn.byte_levenshtein("a", "b").alias("d")).collect()
    assert all(r.d == brute(r.a.encode(), r.b.encode()) for r in rows)


def test_stratified_sample_is_the_procedure(spark):
    for n, pct, seed in ((300, 40, 1), (40, 100, 2), (20, 10, 3)):
        rng = random.Random(seed)
        rows = [(i, "x" * rng.choice([10, 1499, 1500, 2600, 3600, 4600])) for i in range(n)]
        df = spark.createDataFrame(rows, "sample_id long, input string").repartition(3)
        got = sampling.stratified_sample(df, pct, seed=seed).groupBy("stratum").count().collect()
        bins = [0] * 5
        for _, t in rows:
            bins[sum(len(t) >= b for b in sampling.STRATA)] += 1
        quota = n * pct // 100 // 5
        take = [min(c, quota) for c in bins]
        left = sum(quota - t for t in take)
        for k in range(5):
            more = min(bins[k] - take[k], left)
            take[k] += more
            left -= more
        assert {r.stratum: r["count"] for r in got} == {k: t for k, t in enumerate(take) if t}


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("sample_id"))
    for make in (lambda d: sampling.random_sample(d, 33), lambda d: sampling.permutation(d, skip=450), lambda d: sampling.bernoulli(d, 20)):
        assert sorted(map(tuple, make(df.repartition(1)).collect())) == sorted(map(tuple, make(df.repartition(7)).collect()))
    assert sampling.random_sample(df, 33).count() == 165
    assert sampling.split(df, F.col("sample_id")).where("split = 'val'").agg(F.min("sample_id"), F.count("*")).first() == (450, 50)


def test_augmentation(spark):
    value = {"thought": "one two three", "answer": "four five", "memory": ["m n"], "n": 3}
    text = json.dumps(value)
    pairs = spark.range(40).select(F.col("id").alias("sample_id"), F.lit(text).alias("input"), F.lit(xmltext.json_to_xml(text)).alias("target"))
    plain = augment.Settings(variants=1, special=0.5, dict_pct=50.0, corrupt_pct=0.0, truncate_pct=0.0)
    made = [r for r in augment.make_variants(pairs, plain).collect() if r.variant_no]
    for r in made:
        got = jsontext.parse(r.input)
        assert set(got) >= {"thought", "answer", "n"} and got["n"] == 3 and xmltext.xml_to_value(r.target) == got
    assert len({r.input for r in made}) > 30 and {"memory" in jsontext.parse(r.input) for r in made} == {True, False}
    draws = lambda k: corrupt.Draws(1, k, "x")
    words = seeded(spark, " b a  c", lambda t, k: F.array_join(augment.shuffled(augment.words_of(t), draws(k)), " "), 30)
    assert {tuple(sorted(w.split())) for w in words} == {("a", "b", "c")} and len(set(words)) > 3
    assert set(seeded(spark, " ", lambda t, k: augment.new_text(t, draws(k), 1.0, 0.0), 3)) == {" "}
    assert {len(x.split()) for x in seeded(spark, "", lambda t, k: augment.new_text(t, draws(k), 0.0, 100.0, ["w"]), 60)} == {1, 2, 3}
    assert set(seeded(spark, "a b", lambda t, k: augment.new_text(t, draws(k), 0.0, 100.0, ["w"]), 5)) == {"w w"}
    for cut in seeded(spark, SAMPLE, lambda t, k: augment.truncate_json(t, draws(k)), 100):
        assert SAMPLE.startswith(cut) and len(SAMPLE) // 2 <= len(cut) <= len(SAMPLE) * 9 // 10 + 1
    wide = "é€😀" * 40
    assert all(wide.startswith(x) and len(x.encode()) >= len(wide.encode()) // 2 - 3 for x in seeded(spark, wide, lambda t, k: augment.truncate_json(t, draws(k)), 60))
    assert seeded(spark, "short", lambda t, k: augment.truncate_json(t, draws(k)), 1) == ["short"]
    for names, sizes in ((["a"], {0}), (["a", "b"], {1}), (["a", "b", "c"], {1, 2})):
        assert {len(x) for x in seeded(spark, "", lambda t, k, names=names: augment.dropped_keys(F.array(*map(F.lit, names)), draws(k)), 60)} == sizes


def test_augmentation_of_other_texts(spark):
    rows = [(1, "{", "t"), (2, '{"a":"\\u0001"}', "t"), (3, '["x y", 5]', "t"), (4, '"root"', "t"), (5, '{"memory":["m"]}', "t"), (6, "{}", "t"), (6, "{}", "t")]
    pairs = spark.createDataFrame(rows, "sample_id long, input string, target string").withColumn("kind", F.lit(1))
    s = augment.Settings(variants=2, corrupt_pct=0.0, truncate_pct=100.0, compact_pct=0.0, drop_memory_pct=100.0)
    got = {}
    for r in augment.make_variants(pairs, s).collect():
        got.setdefault(r.sample_id, []).append((r.variant_no, r.input, r.truncated))
    assert sorted(got[1]) == [(0, "{", False), (1, None, False), (2, None, False)] and [x[1] for x in sorted(got[2])][1:] == [None, None]
    assert all(not x[2] for x in got[3] + got[4]) and {x[1] for x in got[4]} == {'"root"'} and len(got[6]) == 6
    assert [x[1] for x in sorted(got[5])][1:] == ["{}", "{}"]


def test_a_dictionary_of_any_size(spark):
    words = spark.range(500).select(F.format_string("w%05d", "id").alias("value")).unionByName(spark.createDataFrame([("w00001",), (None,)], "value string"))
    numbered = augment.numbered(words)
    assert sorted(map(tuple, numbered.collect())) == [(f"w{k:05d}", k) for k in range(500)]
    text = json.dumps({"a": "x y z", "b": ["", "q"]})
    pairs = spark.range(30).select(F.col("id").alias("sample_id"), F.lit(text).alias("input"), F.lit("t").alias("target"))
    s = augment.Settings(variants=1, special=0.0, dict_pct=100.0, corrupt_pct=0.0, truncate_pct=0.0)
    table = {r.sample_id: r.input for r in augment.make_variants(pairs, s, words=numbered).where("variant_no = 1").collect()}
    listed = {r.sample_id: r.input for r in augment.make_variants(pairs, s, words=[f"w{k:05d}" for k in range(500)]).where("variant_no = 1").collect()}
    assert table == listed and len(set(table.values())) == 30


def test_augment_run(spark):
    rows = [(i, json.dumps({"thought": f"think about it {i}", ("answer" if i % 2 else "tool"): "x y z"})) for i in range(60)]
    pairs = spark.createDataFrame([(i, t, xmltext.json_to_xml(t)) for i, t in rows], "sample_id long, input string, target string")
    s = augment.Settings(variants=2, corrupt_pct=30.0, truncate_pct=30.0)
    made = augment.run(pairs, s).collect()
    assert len(made) == 180 and sorted({r.variant_no for r in made}) == [0, 1, 2]
    assert all(xmltext.well_formed(r.target) for r in made)
    assert sorted(map(tuple, made)) == sorted(map(tuple, augment.run(pairs.repartition(6), s).collect()))
    assert augment.of_kind(pairs, "tool").count() == 30
    c = augment.counters(augment.run(pairs, s)).first()
    assert c.natural == 60 and c.augmented == 120 and c.failed == 0


def test_enrich(spark):
    call = lambda t: json.dumps({"thought": "x", "tool": {"tool_name": t, "arguments": {"code": "1"}}})
    texts = [call("execute_sql"), call("nothing"), json.dumps({"answer": "a"}), "broken"] * 20
    pairs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "sample_id long, input string, target string")
    got = enrich.enrich(pairs, 100.0).collect()
    for r in got:
        if r.sample_id % 4 == 0:
            value = jsontext.parse(r.input)
            assert r.enriched and len(value["tool"]["arguments"]) > 1 and r.target == xmltext.to_xml(value)
        else:
            assert not r.enriched and r.target == "old" and r.input == texts[r.sample_id]
    share = enrich.enriched_share(enrich.enrich(pairs, 100.0)).first()
    assert (share.enriched, share.tools, share.pct) == (20, 40, 50.0)
    assert sum(len(v) for v in enrich.VARIANTS.values()) == 30 and len(enrich.VARIANTS) == 9


def test_word_edits():
    assert metrics.word_edits([], ["ab", "c"]) == 3 and metrics.word_edits(["ab"], []) == 2 and metrics.word_edits([], []) == 0
    assert metrics.word_edits("a bcd e".split(), "a bx e".split()) == 3 and metrics.word_edits("a b".split(), "b".split()) == 1


def test_percentiles_by_index(spark):
    rng = random.Random(4)
    values = [rng.randint(0, 40) for _ in range(777)]
    r = metrics.index_percentiles(spark.createDataFrame([(v,) for v in values], "v int"), "v").first()
    s = sorted(values)
    assert (r.p50, r.p95, r.p99, r.min, r.max) == (s[int(777 * 0.5)], s[int(777 * 0.95)], s[int(777 * 0.99)], s[0], s[-1])


def test_stage_advance_and_plateau(spark):
    rng = random.Random(5)
    logs = {run: [rng.choice([0.2, 0.9, 0.95]) for _ in range(30)] for run in range(5)}
    df = spark.createDataFrame([(run, e, x) for run, xs in logs.items() for e, x in enumerate(xs)], "run int, epoch int, rate double")
    got = {(r.run, r.epoch): (r.stage, r.stage_after) for r in curriculum.advance(df, "run", 0.5, 3, 4).collect()}
    for run, xs in logs.items():
        stage, good = 1, 0
        for e, x in enumerate(xs):
            before = stage
            good = good + 1 if x >= 0.5 and stage < 4 else 0
            if good >= 3:
                stage, good = stage + 1, 0
            assert got[run, e] == (before, stage)
    errors = df.withColumn("error", 1 - F.col("rate"))
    lrs = {(r.run, r.epoch): r.lr for r in curriculum.plateau(errors, "run", 1.0, 2).collect()}
    for run, xs in logs.items():
        best, bad, lr = float("inf"), 0, 1.0
        for e, x in enumerate(xs):
            if 1 - x < best * (1 - 1e-4):
                best, bad = 1 - x, 0
            else:
                bad += 1
            if bad > 2:
                lr, bad = max(lr * 0.5, 1e-6), 0
            assert lrs[run, e] == lr
    assert curriculum.stages(spark).count() == 4


def test_tokenizer_is_the_library():
    sp = pytest.importorskip("sentencepiece")
    P = pytest.importorskip("public_tokenizers")
    path = P.path("piece_bpe_32k.model")
    model = tokens.Model.load(path)
    library = sp.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    texts = ["Hello world", "naïve café 中文 🙂", "a b c", "x" * 40] + ["".join(rng.choice("abcdehi no") for _ in range(30)).strip() or "a" for _ in range(200)]
    for text in texts:
        text = " ".join(text.split())
        assert model.encode(text) == library.encode(text)
        assert model.decode(model.encode(text)) == text


def _message(*fields):
    """A protocol buffer message of (number, value): bytes, text, floats or whole numbers."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        value = value.encode() if isinstance(value, str) else value
        kind = 2 if isinstance(value, bytes) else 5 if isinstance(value, float) else 0
        body = varint(len(value)) + value if kind == 2 else struct.pack("<f", value) if kind == 5 else varint(value)
        out += varint(number << 3 | kind) + body
    return out


def test_loaded_model_with_symbols_is_the_library(tmp_path):
    sp = pytest.importorskip("sentencepiece")
    letters = "abcdefgkjovruwxyst/<>lm"
    merges = ["ab", "abc", "so", "some", "ke", "key", "wo", "▁wo", "▁so", "<k", "</", "▁<"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((s, 0.0, 4) for s in ("<object>", "</object>", "<key>", "</key>"))]
    pieces += [(f"<0x{k:02X}>", 0.0, 6) for k in range(256)] + [(m, -float(k), 1) for k, m in enumerate(merges)] + [(c, -100.0 - k, 1) for k, c in enumerate("▁" + letters)]
    for prefix, strip in ((1, 1), (0, 0), (1, 0)):
        trainer, spaces = _message((3, 2), (35, 1)), _message((1, "identity"), (3, prefix), (4, strip), (5, 1))
        (tmp_path / "m.model").write_bytes(_message(*((1, _message((1, p), (2, s), (3, k))) for p, s, k in pieces), (2, trainer), (3, spaces)))
        model, library = tokens.Model.load(str(tmp_path / "m.model")), sp.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
        rng = random.Random(4)
        texts = ["<object><key>abc</key></object> some words", "<object", "abc <key> some", "é<key>é"]
        texts += ["".join(rng.choice(["<key>", "</key>", "<object>", "<", "ab", "abc", "some ", "wo", " ", "é", "z"]) for _ in range(rng.randint(1, 25))) for _ in range(300)]
        texts = [" ".join(t.split()) if strip else t for t in texts]
        for text in texts:
            assert model.encode(text) == library.encode(text), (prefix, strip, text)
    assert model.decode([10**6, -1, 0]) == "⁇⁇⁇"


def test_gates_replace_columns_of_their_names(spark):
    lines = spark.createDataFrame([(1, "{", "old", "x")], "id int, raw string, reason string, `a.b` string")
    assert [tuple(r) for r in gates.wrap(lines).collect()] == [(1, "{", "x", "invalid_json", None, None)]
    records = spark.createDataFrame([("{'a': 1}", '{"a": 1}', '{"a": 1}', "old")], "original string, fix_a string, fix_b string, input string")
    got = gates.repair(records, max_change=30.0)
    assert got.columns == ["original", "fix_a", "fix_b", "reason", "input", "target"] and got.first().reason is None and got.first().input == "{'a': 1}"
    assert gates.repair(records, max_change=20.0).first().reason == "too_many_changes"
    assert metrics.token_mean_loss(spark.createDataFrame([], "loss double, n long")).first()[0] == 0.0


def test_trained_tokenizer(spark):
    docs = [(i, f"<object>the cat sat {i} the mat</object>", "the hat") for i in range(30)]
    df = spark.createDataFrame(docs, "sample_id long, input string, target string")
    model = tokens.train_bpe(tokens.corpus_lines(df, df.limit(0), 1000), 320)
    assert tokens.STRUCTURAL_MAX == 15 and [model.ids[s] for s in tokens.SYMBOLS] == list(range(4, 16))
    text = "<object>the cat é</object>"
    ids = model.encode(text, bos=True, eos=True)
    assert ids[0] == tokens.BOS and ids[-1] == tokens.EOS and model.decode(ids).replace(" ", "") == text.replace(" ", "")
    assert len(model.encode("the the the")) <= 4
    with pytest.raises(ValueError):
        tokens.Model([("a", 0.0, tokens.NORMAL)])


def test_decoding():
    step = decode.copy_step(30)()
    source = [5, 9, 7, 12]
    assert decode.greedy(step, source, 10) == source and decode.greedy(step, source, 2) == source[:2]
    for over_all in (False, True):
        assert decode.beam(step, source, 10, 3, over_all=over_all) == source
    rng = random.Random(1)
    table = {}

    def noisy(src, ids):
        return table.setdefault(tuple(ids), [rng.random() * 3 for _ in range(6)])

    greedy, wide = decode.greedy(noisy, source, 6), decode.beam(noisy, source, 6, 3)
    total = lambda ids: sum(decode.log_softmax(noisy(source, [1, *ids[:k]]))[t] for k, t in enumerate([*ids, 2][: 6]))
    assert decode.beam(noisy, source, 6, 1) and total(wide) <= 0 and total(greedy) <= 0


def test_generators(spark):
    for stage in range(1, 6):
        for seed in range(40):
            r = random.Random(seed)
            text, xml = generate.agent_pair(r, stage, augment=seed % 2 == 0)
            value = jsontext.parse(text)
            assert ("answer" in value) != ("tool" in value) and len(value["thought"]) >= 10
            assert xmltext.well_formed(xml) and xmltext.xml_to_value(xml) == value
            assert not (stage == 1 and "tool" in value)
    assert sum("tool" in generate.agent_response(random.Random(s), 2) for s in range(200)) >= 50
    for seed in range(100):
        shape = generate.random_shape(random.Random(seed))
        tree = generate.Tree(shape, random.Random(seed))
        value = tree.root()

        def depth(v):
            inner = v.values() if isinstance(v, dict) else v if isinstance(v, list) else None
            return 0 if inner is None else 1 + max(map(depth, inner), default=0)

        assert isinstance(value, (dict, list)) and depth(value) <= shape.depth + 1 and tree.nodes <= shape.budget + shape.breadth + 1
        assert jsontext.parse(generate.ordered_json(value)) == jsontext.parse(jsontext.compact(value))
    assert len(wording.LANGUAGES) == 10
    for name in wording.LANGUAGES:
        made = {wording.snippet(random.Random(s), name) for s in range(40)}
        assert len(made) > 5 and all(made)
    assert wording.snippet(random.Random(1), "bash") and wording.snippet(random.Random(1), "cobol").startswith("#")
    a, b = (sorted(map(tuple, generate.pairs(spark, 40, "tree", partitions=p).collect())) for p in (1, 5))
    assert a == b


def test_sql_surface(spark):
    generate.register(spark)
    assert spark.sql("SELECT count(*) FROM synthetic_pairs(5, 'agent', 1)").first()[0] == 5
    assert spark.sql("SELECT json_to_xml('[1]') AS x").first().x == "<array>\n  <value>1</value>\n</array>\n"


def test_uniform_is_pinned(spark):
    assert spark.range(1).select(u01(42, F.lit("1"), 0)).first()[0] == 0.38433072925545275


def test_array_functions(spark):
    row = spark.createDataFrame([([1.0, 3.0, 3.0, 2.0],)], "v array<double>").select(
        fn.argmax("v").alias("a"), fn.top_k("v", 3).alias("t"), fn.log_softmax("v").alias("l"), fn.boost(F.lit(1.0), F.lit(0.95)).alias("b"), fn.boost(F.lit(0.0), F.lit(1.0)).alias("z")
    ).first()
    assert row.a == 1 and row.t == [1, 2, 3] and abs(sum(2.718281828459045**x for x in row.l) - 1) < 1e-9
    assert abs(row.b - 0.5) < 1e-9 and row.z == 0.0
    noise = spark.range(50).select(F.array(*map(F.lit, [1, 20, 30, 0])).alias("ids"), "id").select(fn.token_noise("ids", "id", 0.5, 100).alias("n")).collect()
    assert all(r.n[0] == 1 and r.n[3] == 0 and all(15 < t < 100 for t in r.n[1:3]) for r in noise) and len({tuple(r.n) for r in noise}) > 10


def test_nulls_have_a_result(spark):
    from millrace.operators import augment, decode, gates, metrics

    scored = metrics.score(spark.createDataFrame([(1, None, "<a/>"), (2, "<a/>", None), (3, None, None), (4, "a b", "a c")], "sample_id int, expected string, predicted string"))
    got = {r.sample_id: (r.exact, r.xml_ok, r.char_edits, r.word_edits, r.tier) for r in scored.collect()}
    assert got[1] == (False, True, 4, 4, "XML_OK") and got[3][0] and got[4][2:4] == (1, 1) and got[2][3] == 4
    rows = spark.createDataFrame([(1, None), (2, [5, 6, 7])], "id int, src_ids array<int>")
    assert {r.id: r.decoded for r in decode.decode(rows, decode.copy_step(20), 10).collect()} == {1: None, 2: [5, 6, 7]}
    pairs = spark.createDataFrame([(1, None, "x"), (2, '{"thought":"t"}', None)], "sample_id int, input string, target string")
    made = augment.make_variants(pairs, augment.Settings(variants=2)).collect()
    assert len(made) == 6 and all(r.input is None for r in made)
    gated = gates.wrap(spark.createDataFrame([(1, None), (2, "  "), (3, "{")], "id int, raw string"))
    assert sorted((r.id, r.reason) for r in gated.collect()) == [(1, "invalid_json"), (3, "invalid_json")]


def test_places_of_equal_rows_and_many_buckets(spark, monkeypatch):
    from millrace.operators import sampling, tokens
    from millrace.operators.placing import with_place

    rows = spark.range(1000).select(F.col("id").alias("sample_id"), F.lit(1).alias("k")).repartition(5)
    assert sorted(r.place for r in with_place(rows, [F.col("k")]).collect()) == list(range(1000))
    want = {r.sample_id for r in sampling.random_sample(rows, 37.0).collect()}
    monkeypatch.setattr(sampling, "BUCKET", 2)
    assert {r.sample_id for r in sampling.random_sample(rows, 37.0).collect()} == want and len(want) == 370
    pairs = spark.createDataFrame([(k, f"i{k}", f"t{k}") for k in range(30)], "sample_id long, input string, target string")
    first = tokens.corpus_lines(pairs.where("sample_id >= 10"), pairs.where("sample_id < 10"), 22)
    assert {r.value for r in first.collect()} == {f"{c}{k}" for k in [*range(10, 30), 0, 1] for c in "it"}
    assert tokens.corpus_lines(pairs, pairs, None).count() == 120


def test_wording_is_seeded_and_varied():
    simple = [
        wording.sentence, wording.intro, wording.list_item, wording.table_cell, wording.json_body, wording.key, wording.function_name, wording.snake_function_name,
        wording.variable_name, wording.column_name, wording.integer, wording.decimal, wording.port, wording.string_literal, wording.sql_value,
        wording.augmented_thought, wording.augmented_header, wording.augmented_item, wording.augmented_cell,
    ]
    for f in simple:
        some = [f(random.Random(k)) for k in range(60)]
        assert some == [f(random.Random(k)) for k in range(60)] and len(set(some)) > 7 and all(some)
    for f, low, high in ((wording.memory, 4, 6), (wording.augmented_memory, 4, 6), (wording.table_header, 3, 5)):
        assert all(low <= len(f(random.Random(k))) <= high for k in range(60))
    assert len(wording.SENTENCES) == 25 and len(wording.MEMORIES) == 18
    assert all(json.loads(wording.json_body(random.Random(k))) for k in range(60))
    assert all(json.loads(wording.string_literal(random.Random(k))) for k in range(60))
