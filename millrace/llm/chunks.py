"""Encoding texts a batch at a time over a table of the chunks seen before.

Texts are cut into chunks that can be encoded by themselves; each different chunk of a batch is looked up once, new ones
are encoded, and the ids of all texts are gathered by array operations. The table holds numbers only, about 40 bytes a
chunk, and is emptied when it is full; results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks remembered, characters of text that are looked up together, bytes of the longest chunk that is remembered, and
#: new chunks that are learnt together.
REMEMBERED, BATCH, LONGEST, LEARNT = 3_000_000, 2_000_000, 64, 1 << 14


def grown(held: np.ndarray, size: int) -> np.ndarray:
    """held with room for size elements."""
    return held if size <= len(held) else np.concatenate([held, np.empty(max(len(held), size), dtype=held.dtype)])


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of values from starts, of the given sizes, one after another."""
    total = np.cumsum(sizes)
    return values[np.arange(total[-1] if len(total) else 0) + np.repeat(starts - total + sizes, sizes)]


def strings(words: pa.Array) -> list[str]:
    """Strings without spaces as Python's, many times faster than one by one."""
    if not len(words):
        return []
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
    return pc.binary_join(one, " ")[0].as_py().split(" ")


class ChunkTable:
    """Chunks of at most LONGEST bytes, told apart by two 64-bit hashes, and the number of each one's entry."""

    def __init__(self) -> None:
        rng = np.random.default_rng(17)
        self.weights = rng.integers(0, 2**64, (2, LONGEST + 1), dtype=np.uint64) | np.uint64(1)
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks, self.entries = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)

    def hashes(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of the bytes by random weights of their places and of the length, twice; and which words are short."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        lengths = np.diff(offsets)
        short = lengths <= LONGEST
        kept = lengths * short
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        ends = np.cumsum(kept)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - kept, kept)
        codes = data[np.repeat(offsets[:-1], kept) + place].astype(np.uint64) + np.uint64(1)
        found = []
        for weights in self.weights:
            sums = np.append(np.uint64(0), np.cumsum(codes * weights[place]))
            found.append(sums[ends] - sums[ends - kept] + kept.astype(np.uint64) * weights[LONGEST])
        return found[0], found[1], short

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The entries of the hashed chunks, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (self.checks[at] == checks), self.entries[at], -1)

    def add(self, keys: np.ndarray, checks: np.ndarray, entries: np.ndarray) -> None:
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.checks = np.insert(self.checks, at, checks[order])
        self.entries = np.insert(self.entries, at, entries[order])


class ChunkStore:
    """Ids of chunks, in one array, under the numbers of their entries."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.count = self.held = 0
        self.ids = np.empty(1 << 20, dtype=np.uint32)
        self.starts, self.sizes = (np.empty(1 << 18, dtype=np.int64) for _ in range(2))

    def enter(self, parts: list[np.ndarray], sizes: list[int]) -> np.ndarray:
        """Entries for chunks whose ids stand one after another in parts."""
        new, count, start = np.concatenate(parts), len(sizes), self.count
        self.ids = grown(self.ids, self.held + len(new))
        self.starts, self.sizes = grown(self.starts, start + count), grown(self.sizes, start + count)
        self.ids[self.held : self.held + len(new)] = new
        self.sizes[start : start + count] = sizes
        self.starts[start : start + count] = self.held + np.cumsum(sizes) - sizes
        self.held += len(new)
        self.count += count
        return np.arange(start, start + count)

    def find(self, table: ChunkTable, words: pa.LargeStringArray, learn: Callable[[list[str]], np.ndarray]) -> np.ndarray:
        """The entry of each of the different words; new ones are learnt, and short ones among them remembered."""
        keys, checks, short = table.hashes(words)
        found = np.where(short, table.find(keys, checks), -1)
        every = np.flatnonzero(found < 0)
        for first in range(0, len(every), LEARNT):
            new = every[first : first + LEARNT]
            found[new] = learn(strings(words.take(pa.array(new))))
        every = every[short[every]]
        if len(every):
            table.add(keys[every], checks[every], found[every])
        return found


class BatchEncoder:
    """Encodes texts by their chunks. Subclasses say how a text is cut and how new chunks and whole texts are encoded.

    spaced: chunks stand between single spaces; a text's first chunk has no space before it, all others have, and texts
    where a space borders on other white space are encoded whole. Else chunks stand between any white space.
    """

    spaced = True

    def __init__(self, marks: list[str]) -> None:
        self.marks, self.store, self.known, self.heads = marks, ChunkStore(), ChunkTable(), ChunkTable()

    def learn(self, chunks: list[str]) -> np.ndarray:
        """Entries for chunks (with a space before each, where chunks are spaced)."""
        raise NotImplementedError

    def learn_heads(self, chunks: list[str]) -> np.ndarray:
        """Entries for chunks as beginnings of texts."""
        raise NotImplementedError

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text that is not cut."""
        raise NotImplementedError

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after another, and how many each has; null is an empty text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = np.zeros(len(texts), dtype=bool)
        for mark in self.marks:
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        if not self.spaced:  # white space to Arrow, but not to a tokenizer
            whole |= pc.match_substring_regex(texts, r"[\x1c-\x1f]").to_numpy(zero_copy_only=False)
        even = np.flatnonzero(~whole)
        group = np.cumsum(pc.utf8_length(texts).to_numpy()[even]) // BATCH
        parts, starts, sizes, held = [np.empty(0, np.uint32)], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), 0
        for k in np.unique(group).tolist():
            some = even[group == k]
            ids, found, uneven = self._gather(texts.take(pa.array(some)))
            parts.append(ids)
            starts[some], sizes[some] = held + np.cumsum(found) - found, found
            whole[some[uneven]] = True
            held += len(ids)
        rest = np.flatnonzero(whole).tolist()
        if not rest:
            return np.concatenate(parts), sizes
        for k in rest:
            ids = self.whole(texts[k].as_py())
            parts.append(ids)
            starts[k], sizes[k] = held, len(ids)
            held += len(ids)
        return ragged(np.concatenate(parts), starts, sizes), sizes

    @staticmethod
    def _uneven(words: pa.Array, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Texts where a space borders on other white space: a chunk but the first begins with it, or one but the last
        ends with it, or an inner chunk is empty."""
        empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        begins = pc.not_equal(words, pc.utf8_ltrim_whitespace(words)).to_numpy(zero_copy_only=False)
        ends = pc.not_equal(words, pc.utf8_rtrim_whitespace(words)).to_numpy(zero_copy_only=False)
        odd = empty | begins | ends
        at = np.flatnonzero(odd[index])
        if not len(at):
            return np.zeros(len(bounds) - 1, dtype=bool)
        text = np.searchsorted(bounds, at, side="right") - 1
        first, last, word = at == bounds[text], at == bounds[text + 1] - 1, index[at]
        bad = (begins[word] & ~first) | (ends[word] & ~last) | (empty[word] & ~first & ~last)
        return np.bincount(text[bad], minlength=len(bounds) - 1) > 0

    def _gather(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, how many each has, and which texts are uneven; of those nothing is encoded."""
        chunks = pc.split_pattern(texts, " ") if self.spaced else pc.utf8_split_whitespace(texts)
        bounds = chunks.offsets.to_numpy()
        coded = chunks.values.dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary
        uneven = self._uneven(words, index, bounds) if self.spaced else np.zeros(len(texts), dtype=bool)
        firsts = chunks.values.take(pa.array(bounds[:-1])).dictionary_encode() if self.spaced else None
        del chunks, coded
        if self.store.count > REMEMBERED or self.store.held > 8 * REMEMBERED:
            self.store.forget()
            self.known.clear()
            self.heads.clear()
        entry = self.store.find(self.known, words, self.learn)[index]
        if firsts is not None:
            entry[bounds[:-1]] = self.store.find(self.heads, firsts.dictionary, self.learn_heads)[firsts.indices.to_numpy()]
        starts, sizes = self.store.starts[entry], self.store.sizes[entry]
        if uneven.any():
            sizes[np.repeat(uneven, np.diff(bounds))] = 0
        return ragged(self.store.ids, starts, sizes), np.add.reduceat(sizes, bounds[:-1]), uneven
