import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

HARD = [
    None, "", "  ", "Hello  World's 123 naïve\n<|endoftext|>foo<|startoftext|>  ", "ΑΣ ΣΑΣ. İstanbul ÀÉ á",
    "한국어 ᄒ ᅡᆫ 🙂👍🏽", "\x1c\x1d a\x85b​﻿\x00", "x" * 3000, "aaaaab" * 700, "\n\n\n  \n a  b \n", "1２３ ² <|endof",
]


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def both(request):
    path = P.path(request.param)
    return bpe.Vocabulary.load(path), tokenizers.Tokenizer.from_file(path)


def agree(vocabulary, library, texts):
    encoder, decoder = bpe.Encoder(vocabulary), bpe.Decoder(vocabulary)
    for text in texts:
        ids = encoder.encode(text)
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr((text or "")[:60])
        assert decoder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_agrees_with_the_library(both):
    rng = random.Random(4)
    letters = "abcdeéèß 's\n!?.<|>1２ñ中한́\t  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    agree(*both, HARD + texts)


def test_long_words_are_emitted_on_the_way(both, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("thesinaro") for _ in range(25_000)), "ab" * 12_000, "a" * 20_000]
    agree(*both, words)
    monkeypatch.setattr(bpe, "SHORT", 0)
    agree(*both, ["".join(rng.choice("thesinaro") for _ in range(12)) for _ in range(300)])


def test_window_is_bounded(both):
    vocabulary, _ = both
    transducer = bpe.Transducer(vocabulary)
    seen = []
    emit = transducer._emit
    transducer._emit = lambda base, last, out: seen.append(len(last)) or emit(base, last, out)
    transducer.encode("tion" * 10_000)
    assert seen and max(seen) <= transducer.window + 1


def test_pieces_do_not_change_ids(both, monkeypatch):
    vocabulary, library = both
    text = " ".join(f"Word{i % 13}, it's\n\nnew  " for i in range(400))
    monkeypatch.setattr(bpe, "PIECE", 50)
    agree(vocabulary, library, [text, text + "<|endoftext|>" + text, "x" * 500])


def test_decoding_is_incremental(both, monkeypatch):
    vocabulary, library = both
    monkeypatch.setattr(bpe, "DECODED", 1)
    agree(vocabulary, library, ["中文 한국어 🙂 naïve", ""])
    if vocabulary.joiner is None:  # cut inside a character
        ids = bpe.Encoder(vocabulary).encode("🙂")[:4]
        assert bpe.Decoder(vocabulary).decode(ids) == library.decode(np.frombuffer(ids, "<u4").tolist())


def test_operators(spark, both):
    vocabulary, library = both
    rows = [(i, t, i) for i, t in enumerate(HARD)] + [(0, "a", 5), (None, "b c", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.decode(bpe.encode(df, vocabulary), vocabulary, keep=("doc_id", "ids")).collect()
    assert len(got) == len(rows)
    both_ways = bpe.round_trip(df, vocabulary).select("doc_id", "ids", "decoded").collect()
    assert sorted(map(str, both_ways)) == sorted(map(str, got))
    want = sorted(
        (str(i), library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False))
        for i, t, _ in rows
    )
    assert sorted((str(r.doc_id), r.decoded) for r in got) == want
    assert bpe.encode(df.where(F.lit(False)), vocabulary).count() == 0
    digest = hashlib.sha256(b"").hexdigest()
    assert [r[0] for r in bpe.encode(df.where("doc_id = 1"), vocabulary).select(F.sha2("ids", 256)).collect()] == [digest]


def test_a_long_text_without_white_space_takes_bounded_memory(both, monkeypatch):
    vocabulary, library = both
    rng = random.Random(2)
    words = ["".join(rng.choice("thesinaro") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    monkeypatch.setattr(bpe, "PIECE", 1 << 12)
    word = "".join(rng.choice(words) for _ in range(20_000))  # one word
    mixed = "".join(rng.choice(words) + rng.choice(["1", "é", "-", "."]) for _ in range(5_000))  # many words
    agree(vocabulary, library, [word, mixed, "a" + word[:5000] + " " + word[5000:9000]])
    transducer = bpe.Transducer(vocabulary)
    held, emit = [], transducer._emit
    transducer._emit = lambda base, last, out: held.append(len(last)) or emit(base, last, out)
    parts = list(transducer.stream(word[k : k + bpe.PIECE] for k in range(0, len(word), bpe.PIECE)))
    assert sum(map(len, parts)) == len(library.encode(word, add_special_tokens=False).ids) and len(parts) > 3
    assert max(held) < 10 * vocabulary.longest  # emitted long before the bound of the merge list


def test_columns_called_as_results(spark, both):
    vocabulary, library = both
    df = spark.createDataFrame([(1, "a b", "x", 7, 3)], "doc_id long, text string, decoded string, IDS int, `odd.name` int")
    got = bpe.round_trip(df, vocabulary, keep=df.columns)
    assert got.columns == ["doc_id", "text", "odd.name", "ids", "decoded"]
    ids = library.encode("a b", add_special_tokens=False).ids
    row = got.collect()[0]
    assert np.frombuffer(row.ids, "<u4").tolist() == ids and row.decoded == library.decode(ids) and row["odd.name"] == 3


def test_batches_and_a_full_table(both, monkeypatch):
    import pyarrow as pa

    from millrace.llm import chunks

    vocabulary, library = both
    monkeypatch.setattr(chunks, "REMEMBERED", 40)
    monkeypatch.setattr(chunks, "BATCH", 200)
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 30)
    monkeypatch.setattr(bpe, "PIECE", 60)
    rng = random.Random(5)
    letters = "abéß 's\n!<|>1中\t\x1c  "
    texts = HARD[:7] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(300)] + ["x" * 500]
    encoder, decoder = bpe.Encoder(vocabulary), bpe.Decoder(vocabulary)
    ids, sizes = encoder.encode_flat(pa.array(texts, pa.string()))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert decoder.decode_flat(ids, sizes) == [library.decode(w, skip_special_tokens=False) for w in want]
