import pyarrow as pa

from millrace.functions import columns as fn
from millrace.operators import tokens


def model():
    pieces = [("<unk>", 0.0, tokens.UNKNOWN), *((f"<0x{k:02X}>", 0.0, tokens.BYTE) for k in range(256)), ("▁a", -1.0, tokens.NORMAL), ("▁", -2.0, tokens.NORMAL), ("a", -3.0, tokens.NORMAL)]
    return tokens.Model(pieces)


def test_few_texts_at_a_time():
    m = model()
    out = list(m.encoder().func(iter([pa.array(["a  é\x1fa", None, ""] * 300)])))
    assert sum(map(len, out)) == 900 and max(map(len, out)) <= fn.ROWS
    ids = pa.concat_arrays(out)
    assert ids[:3].to_pylist() == [[257, 258, 1 + 0xC3, 1 + 0xA9, 257], None, []]
    assert pa.concat_arrays(list(m.decoder().func(iter([ids]))))[:3].to_pylist() == ["a é a", None, ""]


def test_words_are_remembered_as_ids():
    m = model()
    assert m.encode("a b a") == m.encode("a b a") and all(isinstance(k, int) for ids in m.words.values() for k in ids)
    assert m.decode([257, 1 + 0xC3, -1, 10**6, 1 + 0xA9, 257]) == "a�⁇⁇� a"
