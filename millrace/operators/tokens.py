"""Subword tokenizer of the SentencePiece BPE kind, and model rows and batches made of its ids."""

from __future__ import annotations

import heapq
import itertools
import re
import struct
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import by_slices
from ..functions.types import IDS

#: Ids of pad, bos, eos, unk, and the user-defined symbols that follow them.
PAD, BOS, EOS, UNK = 0, 1, 2, 3
SYMBOLS = (
    "<object>", "</object>", "<entry>", "</entry>", "<key>", "</key>", "<value>", "</value>", "<array>", "</array>",
    "<![CDATA[", "]]>",
)
STRUCTURAL_MAX = UNK + len(SYMBOLS)
IGNORED = -100
SPACE = "▁"
_WORD = re.compile(f"{SPACE}?[^{SPACE}]+|{SPACE}")
_BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
#: Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message: whole numbers, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """Pieces (text, score, type) by id."""

    pieces: Sequence[tuple[str, float, int]]
    dummy_prefix: bool = True
    strip: bool = True
    ids: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        self.ids = {p: k for k, (p, _, kind) in enumerate(self.pieces) if kind not in (UNUSED,)}
        unknown = [k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN]
        if not unknown:
            raise ValueError("a model needs an unknown piece")
        self.unk = unknown[0]
        users = sorted((p for p, _, kind in self.pieces if kind == USER), key=len, reverse=True)
        self.users = re.compile("|".join(map(re.escape, users))) if users else None
        self.mergeable = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER)}
        # Where no piece has a space after its first characters, merges stay inside words and words can be remembered.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.mergeable)
        self.words: dict[str, list[int]] = {}
        self.bytes = {int(m[1], 16): k for k, (p, _, kind) in enumerate(self.pieces) if kind == BYTE and (m := _BYTE.fullmatch(p))}
        # Texts of ids, the last for ids of no piece; None for bytes, which are put together first.
        told = [None if kind == BYTE else " ⁇ ".strip() if kind == UNKNOWN else "" if kind == CONTROL else p for p, _, kind in self.pieces]
        self.texts = [*told, told[self.unk]]

    @classmethod
    def load(cls, path: str) -> Model:
        """From a model file: pieces with their types, user-defined ones among them, and how white space is treated."""
        with open(path, "rb") as f:
            data = f.read()
        pieces, spaces = [], {3: 1, 4: 1}
        for number, value in _fields(data):
            if number == 1:
                piece = {2: b"\0" * 4, 3: NORMAL, **dict(_fields(value))}
                pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
            elif number == 3:
                spaces |= dict(_fields(value))
        return cls(pieces, dummy_prefix=bool(spaces[3]), strip=bool(spaces[4]))

    def _merge(self, text: str) -> list[str]:
        """Adjacent pieces of the highest score joined first, the leftmost where equal, with a heap over a linked list."""
        parts = list(text)
        left, right = [k - 1 for k in range(len(parts))], [k + 1 for k in range(len(parts))]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int) -> None:
            b = right[a]
            if b < len(parts) and (score := self.mergeable.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-score, a, b, parts[a] + parts[b]))

        for k in range(len(parts) - 1):
            offer(k)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if right[a] != b or parts[a] + (parts[b] or "\0") != joined or not parts[a]:
                continue
            parts[a], parts[b] = joined, ""
            right[a] = right[b]
            if right[b] < len(parts):
                left[right[b]] = a
            if left[a] >= 0:
                offer(left[a])
            offer(a)
        return [p for p in parts if p]

    def _ids(self, pieces: Iterable[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.bytes:
                out += [self.bytes.get(b, self.unk) for b in piece.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unk)
        return out

    def _learn(self, word: str) -> list[int]:
        if len(self.words) >= 200_000:
            self.words.clear()
        ids = self.words[word] = self._ids(self._merge(word))
        return ids

    def _split(self, text: str) -> list[int]:
        """The ids of text between user-defined symbols."""
        if not self.by_word or SPACE * 2 in text:
            return self._ids(self._merge(text))
        out: list[int] = []
        for word in _WORD.findall(text):
            out += self.words.get(word) or self._learn(word)
        return out

    def encode(self, text: str, bos: bool = False, eos: bool = False) -> list[int]:
        """Ids of text, its white space collapsed where the model says so; user-defined symbols are never merged with others."""
        text = (" ".join(text.split()) if self.strip else text).replace(" ", SPACE)
        if self.dummy_prefix and text:
            text = SPACE + text
        out, at = [BOS] if bos else [], 0
        for m in [*(self.users.finditer(text) if self.users else ()), None]:
            out += self._split(text[at : m.start() if m else len(text)])
            if m:
                out.append(self.ids[m[0]])
                at = m.end()
        return out + ([EOS] if eos else [])

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: runs of byte pieces as UTF-8, controls left out, unknown ones and ids of no piece as U+2047."""
        last = len(self.pieces)
        ids = [k if 0 <= k < last else last for k in ids]
        out = [self.texts[k] for k in ids]
        if None in out:
            out = [self._run(run) if whole else "".join(self.texts[k] for k in run) for whole, run in itertools.groupby(ids, lambda k: self.texts[k] is None)]
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def _run(self, ids: Iterable[int]) -> str:
        """The text of a run of byte pieces."""
        return bytes(int(_BYTE.fullmatch(self.pieces[k][0])[1], 16) for k in ids).decode("utf-8", "replace")

    def encoder(self, bos: bool = False, eos: bool = False):
        """A vectorised function text -> array<int>; the model travels with it."""

        return by_slices(IDS)(lambda text: None if text is None else self.encode(text, bos, eos))

    def decoder(self):
        """A vectorised function array<int> -> text."""
        return by_slices(T.StringType())(lambda ids: None if ids is None else self.decode(ids))


def corpus_lines(train: DataFrame, val: DataFrame, most: int | None = 200_000, order: str = "sample_id") -> DataFrame:
    """Input and target of each record as lines of their own, of the first `most` records in order, train before val;
    None: of all records. Places come from range partitions, so that no task sorts the records that are kept."""
    both = train.select(F.lit(0).alias("_s"), order, "input", "target").union(val.select(F.lit(1).alias("_s"), order, "input", "target"))
    if most is not None:
        from .placing import with_place

        both = with_place(both, [F.col("_s"), F.col(order)], "_place").where(F.col("_place") < most)
    return both.select(F.explode(F.array("input", "target")).alias("value"))


def train_bpe(lines: DataFrame, vocab: int, column: str = "value", symbols: Sequence[str] = SYMBOLS) -> Model:
    """A small BPE model: words are counted in Spark, merges are chosen on the driver from the distinct words.

    For vocabularies of some thousand pieces over corpora whose distinct words fit the driver.
    """
    spread = F.regexp_replace(column, "|".join(re.escape(s) for s in symbols), " ") if symbols else F.col(column)
    words = lines.select(F.explode(F.split(F.trim(F.regexp_replace(spread, r"\s+", " ")), " ")).alias("w")).where("w <> ''")
    counts = {tuple(SPACE + r.w): r.n for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    chars = sorted({c for w in counts for c in w})
    base = [("<pad>", 0.0, CONTROL), ("<s>", 0.0, CONTROL), ("</s>", 0.0, CONTROL), ("<unk>", 0.0, UNKNOWN)]
    base += [(s, 0.0, USER) for s in symbols] + [(f"<0x{b:02X}>", 0.0, BYTE) for b in range(256)]
    merged: list[str] = []
    while len(base) + len(chars) + len(merged) < vocab:
        pairs: Counter = Counter()
        for w, n in counts.items():
            for pair in zip(w, w[1:]):
                pairs[pair] += n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merged.append("".join(best))
        new = {}
        for w, n in counts.items():
            out, k = [], 0
            while k < len(w):
                if w[k : k + 2] == best:
                    out.append(merged[-1])
                    k += 2
                else:
                    out.append(w[k])
                    k += 1
            new[tuple(out)] = new.get(tuple(out), 0) + n
        counts = new
    learned = [(m, -float(k), NORMAL) for k, m in enumerate(merged)]
    return Model(base + learned + [(c, -float(len(merged) + k), NORMAL) for k, c in enumerate(chars)])


def model_rows(df: DataFrame, src: str = "src", tgt: str = "tgt", max_src: int = 1152, max_tgt: int = 1535) -> DataFrame:
    """Token arrays cut to length: src_ids, tgt_input (after BOS) and tgt_labels (before EOS)."""
    t = F.slice(tgt, 1, max_tgt)
    return df.withColumn("src_ids", F.slice(src, 1, max_src)).withColumn("tgt_input", F.concat(F.array(F.lit(BOS)), t)).withColumn("tgt_labels", F.concat(t, F.array(F.lit(EOS))))


def padded(c: Column, width: Column, value: int) -> Column:
    return F.concat(c, F.array_repeat(F.lit(value), (width - F.size(c)).cast("int")))


def collate(rows: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Rows padded to the widest of their batch, and the mask of padded source places."""
    most = rows.groupBy(batch).agg(F.max(F.size("src_ids")).alias("_s"), F.max(F.size("tgt_input")).alias("_t"))
    wide = rows.join(most, batch)
    src = padded(F.col("src_ids"), F.col("_s"), PAD)
    return wide.select(
        *[c for c in rows.columns if c not in ("src_ids", "tgt_input", "tgt_labels")],
        src.alias("src_ids"), padded(F.col("tgt_input"), F.col("_t"), PAD).alias("tgt_input"),
        padded(F.col("tgt_labels"), F.col("_t"), IGNORED).alias("tgt_labels"),
        F.transform(src, lambda x: x == PAD).alias("src_mask"),
    )


def within_tokens(df: DataFrame, model: Model, most: int, limit: int, column: str = "input", order: str = "sample_id") -> DataFrame:
    """The first `limit` rows in order of at most `most` tokens."""
    return df.withColumn("n_tokens", F.size(model.encoder()(column))).where(F.col("n_tokens") <= most).orderBy(order).limit(limit)
