"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

Encoding. A sequence of tokens is the BPE encoding of a string exactly where each token encodes itself and each pair of
neighbours is what its own concatenation encodes to. So the last token of every prefix follows from the last tokens of
the prefixes a token's length back: the longest token that ends there and fits the one before it. The transducer keeps
these last tokens, symbol by symbol. A token is emitted once it is stable, which the merge list bounds: two inputs that
agree up to some place can differ in their tokens only as far left of it as a chain of merges of rising rank reaches,
each of which straddles the start of the one before. `sufficient_lookahead` computes the longest such chain; tokens
that start farther back than that are final whatever follows. Mostly they are final long before: a token to come starts
at one of the last places, no farther back than the longest token is long, and where the ways back from all these places
meet, all before is final. The transducer looks for that place every few tokens' lengths and emits up to it. Memory is
the window at most, however long a word is, and words come in pieces.

Words (pre-tokens) are encoded one by one, as merges do not cross them. Words and chunks of text that were seen are
remembered in tables of bounded size. Long texts are taken in pieces cut at white space; a long piece without white space
is split into words one after another, and a long word is spelled piece by piece, so that besides the text and its ids
nothing grows with them.

Decoding. Tokens are turned into bytes and run through a UTF-8 state machine that keeps at most three bytes between
pieces and writes U+FFFD for what is not UTF-8.

The file of a public tokenizer (JSON with vocabulary, merges and added tokens) is read on the driver and sent to the
tasks; its size does not depend on the data.

Defined results: a null text is encoded as an empty one, null ids are decoded as none; repeated rows are encoded each;
empty tables give empty tables. The columns in `keep` are passed on, whatever their names; one that is called as a
result is replaced by it.
"""

from __future__ import annotations

import codecs
import gc
import itertools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import BatchEncoder, ChunkStore, ChunkTable, ragged
from .common import give_back, row_slices

#: Characters of a piece of text, tokens of a piece of ids, entries of the tables of words and of pairs and prefixes.
PIECE, DECODED, REMEMBERED_WORDS, REMEMBERED = 1 << 18, 1 << 16, 2_000_000, 200_000
#: Words of at most so many symbols, all within any window, need no emitting on the way.
SHORT = 32

# White space (the property White_Space), as a regular expression's class.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Letters and numbers of Unicode 17, which the tokenizers' older tables do not have as such.
_NOT_YET = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    r"\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    r"\U0003d000-\U0003fc3f"
)
# Lower-case forms of newer Unicode versions, and capital sigma wherever it stands.
_LOWER = str.maketrans(
    {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5}
    | {0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
    | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
    | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
)


def byte_spelling() -> list[str]:
    """The character by which byte-level vocabularies spell each byte: itself if printable Latin-1, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_SPELL = byte_spelling()


def spelled(piece: str) -> str:
    if piece.isascii() and piece.isprintable() and " " not in piece:
        return piece
    return "".join([_SPELL[b] for b in piece.encode("utf-8", "surrogatepass")])


@dataclass
class Vocabulary:
    """Tables of a byte-level BPE tokenizer; `end` marks the last symbol of a word ('' where words have no end)."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    end: str
    added: dict[str, int]
    lower: bool
    joiner: str | None
    lookahead: int = 0
    longest: int = 0
    tails: frozenset = frozenset()
    alone: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        kinds = [n["type"] for n in (data["normalizer"] or {}).get("normalizers", [])]
        made = cls(
            ids=model["vocab"],
            ranks={m: k for k, m in enumerate(merges)},
            end=model.get("end_of_word_suffix") or "",
            added={t["content"]: t["id"] for t in data["added_tokens"]},
            lower="Lowercase" in kinds,
            joiner=None if data["decoder"] else " ",
        )
        made.alone = {t: i for t, i in made.ids.items() if made.merged(made.symbols(t)) == [t]}
        made.longest = max(len(made.symbols(t)) for t in made.alone)
        made.tails = frozenset(t[k:] for t in made.alone for k in range(len(t)))
        made.lookahead = sufficient_lookahead([(made.symbols(a), made.symbols(b)) for a, b in merges])
        return made

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "sent"}

    def shipped(self, spark: SparkSession) -> Broadcast:
        """This vocabulary as a broadcast variable, one for all uses in an application."""
        app, sent = getattr(self, "sent", (None, None))
        if app != spark.sparkContext.applicationId:
            sent = spark.sparkContext.broadcast(self)
            self.sent = (spark.sparkContext.applicationId, sent)
        return sent

    def symbols(self, token: str) -> list[str]:
        """The symbols that merges start from: characters, the last one together with the end mark."""
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1:] + self.end]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """The encoding by merging the pair of lowest rank, leftmost first, again and again: for short strings."""
        parts, ranks, never = list(symbols), self.ranks.get, 1 << 60
        costs = [ranks(pair, never) for pair in zip(parts, parts[1:])]
        while costs:
            least = min(costs)
            if least == never:
                break
            k = costs.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del costs[k]
            if k:
                costs[k - 1] = ranks((parts[k - 1], parts[k]), never)
            if k < len(costs):
                costs[k] = ranks((parts[k], parts[k + 1]), never)
        return parts


def sufficient_lookahead(merges: Sequence[tuple[list[str], list[str]]]) -> int:
    """Symbols beyond a token's start after which the token is final, from the merges in the order of rank.

    At each rank the place up to which two continuations agree moves left only by a merge that straddles it, to that
    merge's start. A later merge moves it on only if its text runs over that start: a proper suffix of it begins like
    the earlier merge's text, or is begun by all of it. reach[m] is the farthest that a chain ending in m comes.
    """
    by_prefix: dict[tuple[str, ...], int] = {}
    whole: dict[tuple[str, ...], int] = {}
    most = 0
    for left, right in merges:
        text = (*left, *right)
        before = 0
        for k in range(1, len(text)):
            tail = text[k:]
            before = max(before, by_prefix.get(tail, 0))
            for n in range(1, len(tail)):
                before = max(before, whole.get(tail[:n], 0))
        reach = before + len(text) - 1
        whole[text] = max(whole.get(text, 0), reach)
        for n in range(1, len(text) + 1):
            if by_prefix.get(text[:n], 0) < reach:
                by_prefix[text[:n]] = reach
        most = max(most, reach)
    return most + 1


class Transducer:
    """Encodes words; holds the pairs of tokens seen so far and the window of the word at hand."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.pairs: dict[tuple[str, str], bool] = {}
        self.prefixes: dict[str, str] = {}
        self.window = 2 * (vocabulary.lookahead + vocabulary.longest)

    def _fits(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[a, b] = self.v.merged([*self.v.symbols(a), *self.v.symbols(b)]) == [a, b]
        return known

    def encode(self, word: str) -> list[int]:
        """Ids of one spelled word."""
        whole = self.v.alone.get(word + self.v.end)
        if whole is not None:
            return [whole]
        if len(word) <= SHORT:
            return self._short(word)
        out = array("I")
        for part in self.stream(word[k : k + PIECE] for k in range(0, len(word), PIECE)):
            out += part
        return out.tolist()

    def stream(self, pieces: Iterable[str]) -> Iterator[array]:
        """Ids of one word that comes in pieces, as they become stable."""
        end, pairs, longest = self.v.end, self.pairs, self.v.longest
        base, last, held, out = 0, [""], "", array("I")  # last[k]: the last token of the prefix that ends at base + k
        due = 4 * longest
        pieces = iter(pieces)
        ahead = next(pieces, "")
        while ahead:  # held: the symbols from base on
            piece, ahead = ahead, next(pieces, "")
            first, final = len(held) + 1, len(held) + len(piece)
            held += piece
            at = first
            while at <= final:
                for n, token in self._ending(held[max(0, at - longest) : at], end if at == final and not ahead else ""):
                    before = last[at - n]
                    if not before or (pairs.get((before, token)) or self._fits(before, token)):
                        last.append(token)
                        break
                else:
                    raise ValueError(f"no token ends {held[:at]!r}")
                at += 1
                if len(last) > due and (at <= final or ahead):
                    cut, last = self._emit(base, last, out)
                    cut -= base
                    if cut:
                        base, held, at, final = base + cut, held[cut:], at - cut, final - cut
                    due = len(last) + 4 * longest
                    if len(out) > PIECE:
                        yield out
                        out = array("I")
        self._drain(last, len(last) - 1, out)
        yield out

    def _ending(self, text: str, final: str) -> list[tuple[int, str]]:
        """The tokens that end text + final with their lengths in text, longest first."""
        alone, tails = self.v.alone, self.v.tails
        found = []
        for n in range(1, len(text) + 1):
            tail = text[-n:] + final
            if tail not in tails:
                break
            if tail in alone:
                found.append((n, tail))
        return found[::-1]

    def _last(self, prefix: str) -> str:
        """The last token of a word's prefix, remembered for words that begin alike."""
        known = self.prefixes.get(prefix)
        if known is None:
            if len(self.prefixes) >= REMEMBERED:
                self.prefixes.clear()
            known = self.prefixes[prefix] = self._choose(prefix, "")
        return known

    def _choose(self, text: str, final: str) -> str:
        for n, token in self._ending(text, final):
            if n == len(text):
                return token
            before = self._last(text[:-n])
            known = self.pairs.get((before, token))
            if known or (known is None and self._fits(before, token)):
                return token
        raise ValueError(f"no token ends {text!r}")

    def _short(self, word: str) -> list[int]:
        """A word shorter than the window: only the prefixes that are asked for, from its end."""
        token = self._choose(word, self.v.end)
        out, at = [self.v.alone[token]], len(word) - len(token) + len(self.v.end)
        while at > 0:
            token = self._last(word[:at])
            out.append(self.v.alone[token])
            at -= len(token)
        return out[::-1]

    def _stable(self, last: list[str]) -> int:
        """The place up to which tokens are final: where the ways back from all places meet that a token to come may
        start at, the last `longest` ones. 0 if they do not meet."""
        ways = set(range(max(0, len(last) - self.v.longest), len(last)))
        while len(ways) > 1:
            far = max(ways)
            ways.remove(far)
            ways.add(far - len(last[far]) if last[far] and far else 0)
        return ways.pop()

    def _emit(self, base: int, last: list[str], out: array) -> tuple[int, list[str]]:
        """Emit the tokens that are final; the last of them stays as the context of what follows."""
        cut = self._stable(last)
        if not cut:
            return base, last
        self._drain(last, cut, out)
        return base + cut, last[cut:]

    def _drain(self, last: list[str], at: int, out: array) -> None:
        """Emit the tokens on the way back from a place; the context, at place 0, is emitted before."""
        tokens = []
        while at > 0:
            tokens.append(self.v.alone[last[at]])
            at -= len(last[at]) - (len(self.v.end) if self.v.end and last[at].endswith(self.v.end) else 0)
        out.extend(tokens[::-1])


def word_pattern(ended: bool) -> str:
    """The expression (of the regex module) that splits normalised text into words, as the public tokenizers do."""
    contractions = "'s|'t|'re|'ve|'m|'ll|'d"
    letter, number = rf"[\p{{L}}--[{_NOT_YET}]]", rf"[\p{{N}}--[{_NOT_YET}]]"
    other = rf"[^{_SPACE}{letter}{number}]"
    if ended:
        return rf"(?V1){contractions}|{letter}+|{number}|{other}+"
    space, rest = f"[{_SPACE}]", f"(?![^{_SPACE}])"
    return rf"(?V1){contractions}| ?{letter}+| ?{number}+| ?{other}+|{space}+{rest}|{space}+"


class Encoder(BatchEncoder):
    """Texts to ids. Texts are split into words, words go through the transducer; chunks of text between white space and
    words that were seen before are looked up."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__(list(vocabulary.added))
        self.v, self.transducer, self.spaced = vocabulary, Transducer(vocabulary), not vocabulary.end
        self.words, self.word_table = regex.compile(word_pattern(bool(vocabulary.end))), ChunkTable()
        self.word_store = ChunkStore()
        self.special = regex.compile("|".join(map(re.escape, sorted(vocabulary.added, key=len, reverse=True))) or r"(?!)")
        self.breaks = re.compile(rf"[^{_SPACE}](?=[{_SPACE}])")

    def _normal(self, text: str) -> str:
        if not self.v.lower:
            return text
        text = unicodedata.normalize("NFC", text)
        return text.lower() if text.isascii() else text.translate(_LOWER).lower()

    def _pieces(self, text: str) -> Iterator[str]:
        """Text cut before white space that follows other text, so that no word or run of space is cut."""
        at = 0
        while len(text) - at > PIECE:
            found = self.breaks.search(text, at + PIECE)
            if not found:
                break
            yield text[at : found.end()]
            at = found.end()
        yield text[at:]

    def _streamed(self, text: str) -> Iterator[array]:
        """Ids of text, word by word."""
        for found in self.words.finditer(self._normal(text)):
            start, end = found.span()
            if end - start <= PIECE:
                yield array("I", self.transducer.encode(spelled(found.group())))
            else:
                yield from self.transducer.stream(spelled(found.string[k : min(k + PIECE, end)]) for k in range(start, end, PIECE))

    def _learn_words(self, words: list[str]) -> np.ndarray:
        found = [self.transducer.encode(spelled(w)) for w in words]
        return self.word_store.enter([np.array([i for ids in found for i in ids], dtype=np.uint32)], [len(ids) for ids in found])

    def _entered(self, chunks: list[str], before: str) -> np.ndarray:
        """Entries for chunks, with `before` before each."""
        if self.word_store.count > REMEMBERED_WORDS:
            self.word_store.forget()
            self.word_table.clear()
        words, counts = [], []
        longer = {k: None for k, chunk in enumerate(chunks) if len(chunk) > PIECE}
        for k in longer:
            longer[k] = np.frombuffer(b"".join(p.tobytes() for p in self._streamed(before + chunks[k])), dtype="<u4")
            chunks[k] = ""
        if self.v.lower and self.v.end:  # no chunk has a line end
            chunks = self._normal("\n".join(chunks)).split("\n")
        else:
            chunks = [self._normal(before + c) for c in chunks]
        for k, chunk in enumerate(chunks):
            some = [] if k in longer else self.words.findall(chunk)
            words += some
            counts.append(len(some))
        different = pa.array(words, pa.large_string()).dictionary_encode()
        entry = self._word_entries(different.dictionary)[different.indices.to_numpy()] if words else np.empty(0, np.int64)
        sizes = self.word_store.sizes[entry]
        of = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        ids = ragged(self.word_store.ids, self.word_store.starts[entry], sizes)
        if not longer:
            return self.store.enter([ids], np.diff(of).tolist())
        parts = [longer[k] if k in longer else ids[of[k] : of[k + 1]] for k in range(len(chunks))]
        return self.store.enter(parts, [len(p) for p in parts])

    def _word_entries(self, words: pa.LargeStringArray) -> np.ndarray:
        keys, checks, short = self.word_table.hashes(words)
        found = np.where(short, self.word_table.find(keys, checks), -1)
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = self._learn_words(words.take(pa.array(new)).to_pylist())
            new = new[short[new]]
            self.word_table.add(keys[new], checks[new], found[new])
        return found

    def learn(self, chunks: list[str]) -> np.ndarray:
        return self._entered(chunks, "" if self.v.end else " ")

    def learn_heads(self, chunks: list[str]) -> np.ndarray:
        return self._entered(chunks, "")

    def whole(self, text: str) -> np.ndarray:
        parts, at = [], 0
        for found in itertools.chain(self.special.finditer(text), [None]):
            for piece in self._pieces(text[at : found.start() if found else len(text)]):
                parts += [p.tobytes() for p in self._streamed(piece)]
            if found:
                parts.append(self.v.added[found.group()].to_bytes(4, "little"))
                at = found.end()
        return np.frombuffer(b"".join(parts), dtype="<u4")

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As BatchEncoder does; long texts are taken in pieces, a batch of a few at a time."""
        texts = texts.cast(pa.large_string()).fill_null("")
        long = np.flatnonzero(pc.utf8_length(texts).to_numpy() > 4 * PIECE).tolist()
        if not long:
            return super().encode_flat(texts)
        ids, sizes, at = [], np.zeros(len(texts), dtype=np.int64), 0
        for k in [*long, len(texts)]:
            some, found = super().encode_flat(texts.slice(at, k - at))
            ids.append(some)
            sizes[at:k] = found
            if k < len(texts):
                for piece in self._pieces(texts[k].as_py()):
                    some, _ = super().encode_flat(pa.array([piece], pa.large_string()))
                    ids.append(some)
                    sizes[k] += len(some)
            at = k + 1
        return np.concatenate(ids), sizes

    def encode(self, text: str | None) -> bytes:
        """Ids of one text as little-endian 32-bit words."""
        return self.encode_flat(pa.array([text], pa.large_string()))[0].astype("<u4").tobytes()


class Decoder:
    """Ids to text: bytes of tokens through an incremental UTF-8 state machine."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        byte_of = {c: b for b, c in enumerate(_SPELL)}
        names = {i: t for t, i in {**vocabulary.ids, **vocabulary.added}.items()}
        self.joiner = (vocabulary.joiner or "").encode()
        made = {
            i: (t.encode() if vocabulary.joiner is not None or not all(c in byte_of for c in t) else bytes(byte_of[c] for c in t))
            + self.joiner
            for i, t in names.items()
        }
        every = [made.get(i, b"") for i in range(max(made, default=-1) + 2)]  # the last stands for ids that are none
        self.bytes = np.frombuffer(b"".join(every), dtype=np.uint8)
        self.sizes = np.array([len(t) for t in every], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the tokens, and how many each has."""
        ids = np.minimum(ids, len(self.sizes) - 1)
        sizes = self.sizes[ids]
        return ragged(self.bytes, self.starts[ids], sizes), sizes

    def decode(self, ids: bytes | np.ndarray | None) -> str:
        """Ids that the vocabulary does not have are left out."""
        numbers = ids if isinstance(ids, np.ndarray) else np.frombuffer(ids or b"", dtype="<u4")
        return self._text(self._bytes(numbers[k : k + DECODED])[0].tobytes() for k in range(0, len(numbers), DECODED))

    def _text(self, parts: Iterable[bytes]) -> str:
        state = codecs.getincrementaldecoder("utf-8")("replace")
        text = "".join([state.decode(part) for part in parts]) + state.decode(b"", final=True)
        return text[: len(text) - len(self.joiner)] if self.joiner and text else text

    def decode_flat(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of ids that stand one text after another; short ones are turned into bytes together."""
        ends = np.cumsum(sizes)
        out, at = [], 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + DECODED, side="right")))
            first = int(ends[at] - sizes[at])
            if to == at + 1:
                out.append(self.decode(ids[first : ends[at]]))
            else:
                data, of = self._bytes(ids[first : ends[to - 1]])
                cuts = np.append(0, np.cumsum(of))[ends[at:to] - first]
                data = data.tobytes()
                out += [self._text((data[s:e],)) for s, e in zip([0, *cuts.tolist()], cuts.tolist())]
            at = to
        return out


def _mapped(df: DataFrame, vocabulary: Vocabulary, keep: Sequence[str], column: str, out: dict[str, str], work) -> DataFrame:
    """The columns in keep and those in out (name to kind), which work(vocabulary) makes of a batch of a column's values.

    Columns in keep that have a name in out are left out: the new ones take their place.
    """
    shipped = vocabulary.shipped(df.sparkSession)
    keep = [c for c in keep if c.lower() not in {n.lower() for n in out}]
    taken = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{column}`").alias("value"))
    named = [*(f"k{i}" for i in range(len(keep))), *(f"o{i}" for i in range(len(out)))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = work(shipped.value)
        for batch in row_slices(it):
            made = make(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=named)
            del made
            give_back()
        del make  # the tables go before the next task of this worker makes its own
        gc.collect()
        give_back()

    kinds = [*(f.dataType.simpleString() for f in taken.schema.fields[:-1]), *out.values()]
    return taken.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(named, kinds))).toDF(*keep, *out)


def _binary(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Ids that stand one text after another as a column of binary values."""
    offsets = pa.array(np.append(0, 4 * np.cumsum(sizes)).astype(np.int64))
    data = pa.py_buffer(np.ascontiguousarray(ids, dtype="<u4"))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, offsets.buffers()[1], data]).cast(pa.binary())


def encode(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", keep: Sequence[str] = ("doc_id",), name: str = "ids") -> DataFrame:
    """The columns in keep and `name`: the ids of the text as binary, little-endian unsigned 32-bit."""

    def work(v: Vocabulary):
        encoder = Encoder(v)
        return lambda texts: [_binary(*encoder.encode_flat(texts))]

    return _mapped(df, vocabulary, keep, text_col, {name: "binary"}, work)


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", keep: Sequence[str] = ("doc_id",), name: str = "decoded") -> DataFrame:
    """The columns in keep and `name`: the text of the ids, special tokens included."""

    def work(v: Vocabulary):
        decoder = Decoder(v)
        return lambda ids: [pa.array([decoder.decode(x.as_py()) for x in ids], pa.string())]

    return _mapped(df, vocabulary, keep, ids_col, {name: "string"}, work)


def round_trip(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns in keep, `ids` as encode gives them and `decoded`, the text that decode makes of these ids, in one pass."""

    def work(v: Vocabulary):
        encoder, decoder = Encoder(v), Decoder(v)

        def make(texts: pa.Array) -> list[pa.Array]:
            ids, sizes = encoder.encode_flat(texts)
            return [_binary(ids, sizes), pa.array(decoder.decode_flat(ids, sizes), pa.string())]

        return make

    return _mapped(df, vocabulary, keep, text_col, {"ids": "binary", "decoded": "string"}, work)
