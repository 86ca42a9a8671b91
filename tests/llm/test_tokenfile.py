import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chunks, tokenfile

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


def test_words_round_trip():
    rng = random.Random(3)
    for _ in range(60):
        some = [
            np.array([rng.choice([0, 1, 3, 200, 4095, 50256, 2**30, 2**60 - 1, 2**60, 2**64 - 1][: rng.randint(1, 10)]) for _ in range(rng.randint(0, 150))], dtype=np.uint64)
            for _ in range(rng.randint(0, 6))
        ]
        words, per, escapes = tokenfile.pack(some)
        assert per.sum() == len(words)
        values, first = tokenfile.unpack(words, escapes)
        begins = np.append(first, len(values))[np.cumsum(per) - per] if len(per) else []
        assert all(np.array_equal(values[b : b + len(x)], x) for b, x in zip(begins, some))


def test_density():
    words, _, _ = tokenfile.pack([np.ones(600, dtype=np.uint64)])
    assert len(words) == 10
    words, _, _ = tokenfile.pack([np.full(600, 50_000, dtype=np.uint64)])
    assert len(words) == 200


def test_encoder_is_the_library(monkeypatch):
    path = P.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    encoder = tokenfile.LibraryEncoder(open(path, encoding="utf-8").read())
    rng = random.Random(8)
    letters = "abé 's\n!<|>1中\t  "
    texts = [None, "", " ", " a", "a ", "a  b", "a\n b", "a \nb", "x<|endoftext|> y", "it's Bob's\n\nend"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for batch in (chunks.BATCH, 100):
        monkeypatch.setattr(chunks, "BATCH", batch)
        monkeypatch.setattr(chunks, "REMEMBERED", 50 if batch == 100 else 1_000_000)
        for text, ids in zip(texts * 2, encoder.encode(texts * 2)):
            want = library.encode(text or "", add_special_tokens=False).ids
            assert ids.tolist() == want, repr(text)


def test_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_WORDS", 16)
    path = P.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(5)
    rows = [(i * 7, " ".join(rng.choice(["the", "of", "zebra", "é"]) for _ in range(rng.randint(0, 90))), 1) for i in range(120)]
    rows += [(None, "null id", 0), (5, None, 0), (7, "twice", 0), (7, "twice", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    files = tokenfile.write_token_files(df, str(tmp_path), path, docs_per_file=25)
    assert files.count() > 3
    got = tokenfile.read_token_files(files).select("id", "start", "n_ids", F.crc32("ids").alias("crc")).orderBy("start").collect()
    place, want = 0, []
    ids_of = lambda t: library.encode(t or "", add_special_tokens=False).ids + [2]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(ids_of(r[1])), ids_of(r[1])))
    for doc, text, _ in ordered:
        ids = np.array(ids_of(text), dtype="<u4")
        want.append((doc, place, len(ids), zlib.crc32(ids.tobytes())))
        place += len(ids)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert [r.id for r in got if r.id is not None] == sorted(r[0] for r in rows if r[0] is not None)
    assert tokenfile.read_token_files(tokenfile.write_token_files(df.where(F.lit(False)), str(tmp_path / "e"), path)).count() == 0


def test_a_file_is_its_own_index():
    out = io.BytesIO()
    writer = tokenfile.Writer(out)
    writer.add(1, np.array([1, 2, 3], dtype=np.uint32))
    writer.close()
    data = out.getvalue()
    assert data.startswith(tokenfile.MAGIC) and data.endswith(tokenfile.MAGIC)


def test_one_id_fills_several_files(spark, tmp_path):
    path = P.path("byte_bpe_50k.json")
    rows = [(5, f"word {i % 7}") for i in range(600)] + [(i, "other") for i in range(10, 210)] + [(None, "x")] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    files = tokenfile.write_token_files(df, str(tmp_path), path, docs_per_file=100)
    counts = [r.n_docs for r in files.collect()]
    assert sum(counts) == len(rows) and max(counts) <= 250 and len(counts) >= 7
    got = tokenfile.read_token_files(files).orderBy("start").collect()
    assert [r.id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_ids for r in got])[:-1].tolist()


def test_dealing():
    bounds = np.array([3, 7, 7, 7, 9])
    assert tokenfile.deal(np.array([1, 3, 5, 9, 12]), bounds, 0).tolist() == [0, 1, 1, 5, 5]
    assert tokenfile.deal(np.array([7, 7, 7, 7]), bounds, 0).tolist() == [2, 3, 4, 2]


def test_long_and_short_documents_pack_alike():
    rng = np.random.default_rng(4)
    some = [rng.integers(0, 1 << int(rng.integers(1, 40)), int(n), dtype=np.uint64) for n in [100_000, 0, 1, *rng.integers(0, 300, 80)]]
    words, per, escapes = tokenfile.pack(some)
    assert words.tolist() == [w for x in some for w in tokenfile.pack([x])[0].tolist()]
    assert not len(escapes)
