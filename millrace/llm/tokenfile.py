"""Token ids as binary files in Simple-8b word-aligned coding.

Texts are encoded with the tokenizers library; an end id closes each document. A 64-bit word holds a selector in its
upper 4 bits and as many ids as fit its other 60 at one width: 60 of 1 bit down to 1 of 60 bits. Selector 0 is an escape:
the next word is one raw 64-bit value. A document begins on a word of its own and its last word is filled with zeros.

File: MAGIC, blocks of words (little-endian), then the footer and its length (8 bytes) and MAGIC again. The footer has
the counts of blocks and documents; for each block its offset in words, its documents, its words and its escapes; for
each document id, ids, words; and the places of the escapes inside their blocks. So a block can be read by itself and is
decoded with array operations, one per selector.

Files hold ranges of ascending document ids, about `docs_per_file` documents each; their bounds come from range partitions
of the ids of all documents. A document is packed where it is encoded, and its words travel to the task that writes its
file. A file appears whole or not at all.

Defined results: a null text is an empty one, and gives the end id alone; null document ids come first; documents that
share an id follow each other, shorter ones first, but if they are more than a file holds they are dealt over several
files in turn. A very long text is encoded and packed by one task like any other. Ids are read as longs: one that is no
number is null. Only the two columns named are read, so that others may have any names. An empty table gives no files.
"""

from __future__ import annotations

import functools
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import BatchEncoder
from .common import cut, give_back, row_slices
from .files import readable, written

MAGIC = b"S8BTOK01"
#: Selector to (count, width); 0 is the escape (fixed by the format).
SELECTORS = ((1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNT = np.array([c for c, _ in SELECTORS], dtype=np.int64)
_PAD = 60
BLOCK_WORDS = 1 << 15
#: The most files; beyond, files hold more documents than asked for.
MAX_FILES = 1 << 16
_LEAST = -(1 << 63)
#: New chunks that are encoded together.
TOGETHER = 64


class LibraryEncoder(BatchEncoder):
    """The tokenizers library, with the encodings of chunks of text remembered.

    A byte-level tokenizer encodes " word" alike wherever it stands, if no white space borders on the space. New chunks
    are encoded together and told apart by the bytes of their tokens. Texts with special tokens go to the library whole.
    """

    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        by_id = {i: t for t, i in self.tokenizer.get_vocab().items()}
        # A byte-level token is spelled with a character for each byte.
        self.bytes_of = np.array([0 if i in added else len(by_id.get(i, "")) for i in range(max(by_id) + 1)])
        super().__init__([t.content for t in added.values()])

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def learn(self, chunks: list[str]) -> np.ndarray:
        """TOGETHER chunks are encoded as one text."""
        odd = np.array([c[-1:].isspace() for c in chunks])
        plain = [c for c, o in zip(chunks, odd) if not o]
        parts = self._library([" " + c for c, o in zip(chunks, odd) if o])
        sizes = [len(p) for p in parts]
        lengths = pc.binary_length(pa.array(plain, pa.large_string())).to_numpy() + 1
        firsts = range(0, len(plain), TOGETHER)
        for first, ids in zip(firsts, self._library([" " + " ".join(plain[k : k + TOGETHER]) for k in firsts])):
            cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(lengths[first : first + TOGETHER])) + 1
            parts.append(ids)
            sizes += np.diff(cuts, prepend=0).tolist()
        found = np.empty(len(chunks), dtype=np.int64)
        found[np.argsort(~odd, kind="stable")] = self.store.enter(parts, sizes)
        return found

    def learn_heads(self, chunks: list[str]) -> np.ndarray:
        parts = self._library(chunks)
        return self.store.enter(parts, [len(p) for p in parts])

    def whole(self, text: str) -> np.ndarray:
        return self._library([text])[0]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, sizes = self.encode_flat(pa.array(texts, pa.large_string()))
        return np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []


@functools.cache
def _encoder(tokenizer_json: str) -> LibraryEncoder:
    """One encoder for all tasks of a Python worker, so that what one has seen serves the next."""
    return LibraryEncoder(tokenizer_json)


def pack(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays of ids (uint64) to words, words per array, and the places of escapes among the words."""
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    return pack_flat(np.concatenate(ids) if ids else np.empty(0, dtype=np.uint64), sizes)


def pack_flat(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What pack does, from all ids one array after another and the sizes of the arrays."""
    begins = np.cumsum(sizes + _PAD) - sizes - _PAD
    values = np.zeros(int((sizes + _PAD).sum()) + _PAD, dtype=ids.dtype)  # fillers stand between the arrays
    values[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)) * _PAD, sizes)] = ids
    width = ((values.astype(np.float64).view(np.uint64) >> np.uint64(52)).astype(np.int16) - 1022).clip(0).astype(np.uint8)
    big = values >= min(1 << 52, np.iinfo(ids.dtype).max)  # beyond exact floats
    if big.any():
        width[big] = [int(v).bit_length() for v in values[big]]
    choice = np.full(len(values), len(SELECTORS), dtype=np.uint8)
    widest, have = width, 1
    for selector in range(len(SELECTORS) - 1, 0, -1):
        count, bits = SELECTORS[selector]
        while have < count:  # widest: of `have` neighbours each
            step = min(have, count - have)
            widest = np.append(np.maximum(widest[:-step], widest[step:]), widest[len(widest) - step :])
            have += step
        np.minimum(choice, np.where(widest <= bits, np.uint8(selector), np.uint8(len(SELECTORS))), out=choice)
    choice[choice == len(SELECTORS)] = 0
    starts = _walk(_COUNT.astype(np.uint8)[choice], begins, begins + sizes)
    per = np.diff(np.searchsorted(starts, np.append(begins, len(values))))
    chosen = choice[starts]
    words = np.zeros(len(starts), dtype=np.uint64)
    for selector in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == selector)
        count, bits = SELECTORS[selector]
        if selector:
            at_word, held = starts[mine], np.full(len(mine), selector << 60, dtype=np.uint64)
            for k in range(count):
                held |= values[at_word + k].astype(np.uint64) << np.uint64(k * bits)
            words[mine] = held
    escaped = np.flatnonzero(chosen == 0)
    if len(escaped):
        owner = np.repeat(np.arange(len(sizes)), per)
        words = np.insert(words, escaped + 1, values[starts[escaped]])
        per += np.bincount(owner[escaped], minlength=len(sizes))
        escaped = escaped + np.arange(len(escaped))
    return words, per, escaped


def _walk(step: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places that walks from begins to ends touch, ascending; from each place they go on by its step. All walks go
    together as long as there are many, then each for itself."""
    touched = np.zeros(len(step), dtype=bool)
    at, end = begins[begins < ends], ends[begins < ends]
    while len(at) >= 32:
        touched[at] = True
        at = at + step[at]
        on = at < end
        if not on.all():
            at, end = at[on], end[on]
    single = step.tobytes() if len(at) else b""
    for place, stop in zip(at.tolist(), end.tolist()):
        places = []
        while place < stop:
            places.append(place)
            place += single[place]
        touched[places] = True
    return np.flatnonzero(touched)


def unpack(words: np.ndarray, escapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All values of the words (fillers included) and the place of each word's first value among them."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    selector[escapes + 1] = -1
    selector[escapes] = 0
    counts = np.where(selector > 0, _COUNT[selector], 0)
    counts[escapes + 1] = 1
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    out[first[escapes + 1]] = words[escapes + 1]
    for s in np.unique(selector[selector > 0]).tolist():
        mine = np.flatnonzero(selector == s)
        count, bits = SELECTORS[s]
        held, at, mask = words[mine], first[mine], np.uint64((1 << bits) - 1)
        for k in range(count):
            out[at + k] = (held >> np.uint64(k * bits)) & mask
    return out, first


@dataclass
class Footer:
    blocks: np.ndarray
    docs: np.ndarray
    escapes: np.ndarray

    BLOCK = np.dtype([("offset", "<u8"), ("docs", "<u4"), ("words", "<u4"), ("escapes", "<u4")])
    DOC = np.dtype([("id", "<i8"), ("known", "u1"), ("ids", "<u8"), ("words", "<u8")])

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQQ", len(self.blocks), len(self.docs), len(self.escapes))
        return head + self.blocks.tobytes() + self.docs.tobytes() + self.escapes.astype("<u8").tobytes()

    @classmethod
    def of(cls, data: bytes) -> Footer:
        counts = struct.unpack_from("<QQQ", data)
        parts, at = [], 24
        for n, kind in zip(counts, (cls.BLOCK, cls.DOC, np.dtype("<u8"))):
            parts.append(np.frombuffer(data, kind, n, at))
            at += n * kind.itemsize
        return cls(*parts)


class Writer:
    """Writes one file from (document id, ids) in order, a block of words at a time."""

    def __init__(self, out) -> None:
        self.out, self.offset = out, 0
        self.blocks, self.docs, self.escapes = [], [], []
        self.held: list[np.ndarray] = []
        self.block_escapes: list[np.ndarray] = []
        self.held_words = 0
        out.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        words, _, escapes = pack([ids.astype(np.uint64)])
        self.add_words(doc, len(ids), words, escapes)

    def add_words(self, doc: int | None, ids: int, words: np.ndarray, escapes: np.ndarray) -> None:
        """A document that is packed already: its number of ids, its words, and the places of escapes among them."""
        if len(escapes):
            self.block_escapes.append(escapes + self.held_words)
        self.docs.append((doc or 0, doc is not None, ids, len(words)))
        self.held.append(words)
        self.held_words += len(words)
        if self.held_words >= BLOCK_WORDS:
            self.block()

    def block(self) -> None:
        if not self.held:
            return
        escapes = np.concatenate(self.block_escapes) if self.block_escapes else np.empty(0, dtype=np.int64)
        self.blocks.append((self.offset, len(self.held), self.held_words, len(escapes)))
        self.escapes.append(escapes)
        for words in self.held:
            self.out.write(words.astype("<u8").tobytes())
        self.offset += self.held_words
        self.held, self.block_escapes, self.held_words = [], [], 0

    def close(self) -> None:
        self.block()
        escapes = np.concatenate(self.escapes) if self.escapes else np.empty(0, dtype=np.int64)
        footer = Footer(np.array(self.blocks, Footer.BLOCK), np.array(self.docs, Footer.DOC), escapes).to_bytes()
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)


def read_file(uri: str) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The blocks of a file: the documents' records and their ids."""
    with readable(uri) as f:
        size = f.size()
        tail = f.read_at(16, size - 16)
        if f.read_at(8, 0) != MAGIC or tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        length = struct.unpack("<Q", tail[:8])[0]
        footer = Footer.of(f.read_at(length, size - 16 - length))
        doc = escape = 0
        for offset, docs, words, escapes in footer.blocks.tolist():
            data = np.frombuffer(f.read_at(8 * words, len(MAGIC) + 8 * offset), "<u8")
            values, first = unpack(data, footer.escapes[escape : escape + escapes].astype(np.int64))
            records = footer.docs[doc : doc + docs]
            per = records["words"].astype(np.int64)
            begins = np.append(first, len(values))[np.cumsum(per) - per]
            yield records, [values[b : b + n] for b, n in zip(begins.tolist(), records["ids"].tolist())]
            doc, escape = doc + docs, escape + escapes


def file_bounds(ids: DataFrame, files: int) -> np.ndarray:
    """The smallest id of each of about `files` ranges of equal size but the first, ascending; an id with more rows than
    a range has is there several times. At most `files` longs come to the driver. Null counts as the smallest id."""
    ranged = ids.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(files, F.col("id").asc_nulls_first(), "tie")
    lowest = F.min(F.coalesce("id", F.lit(_LEAST))).alias("low")
    found = ranged.groupBy(F.spark_partition_id().alias("pid")).agg(lowest).collect()
    return np.sort(np.array([r.low for r in found], dtype=np.int64))[1:]


def deal(ids: np.ndarray, bounds: np.ndarray, turn: int) -> np.ndarray:
    """The file of each id: the last whose range begins with it or before; where several begin with it, in turn."""
    low, high = np.searchsorted(bounds, ids), np.searchsorted(bounds, ids, side="right")
    several = high - low > 1
    if several.any():
        at = np.flatnonzero(several)
        high[at] = low[at] + 1 + (turn + np.arange(len(at))) % (high[at] - low[at])
    return high


def write_token_files(
    df: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
    docs_per_file: int = 8192,
) -> DataFrame:
    """Write the files and return their list (file, path, n_docs, n_ids, start), start being the ids in files before."""
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = spark.sparkContext.broadcast(f.read())
    ids = df.select(F.col(f"`{id_col}`").try_cast("bigint").alias("id"))
    files = min(MAX_FILES, max(1, -(-ids.count() // docs_per_file)))
    bounds = file_bounds(ids, files) if files > 1 else np.empty(0, dtype=np.int64)

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, turn = _encoder(shipped.value), 0
        for batch in row_slices(it, 1024):
            found, sizes = encoder.encode_flat(batch.column(1))
            found, sizes = np.insert(found, np.cumsum(sizes), end_id), sizes + 1
            words, per, escapes = pack_flat(found, sizes)
            ends = np.cumsum(per)
            offsets = pa.array(np.append(0, 8 * ends).astype(np.int64))
            made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(per), [None, offsets.buffers()[1], pa.py_buffer(words.astype("<u8"))])
            owner = np.searchsorted(ends, escapes, side="right")
            begins = pa.array(np.searchsorted(owner, np.arange(len(per) + 1)).astype(np.int32))
            inside = pa.ListArray.from_arrays(begins, pa.array((escapes - (ends - per)[owner]).astype(np.int64)))
            known = batch.column(0).fill_null(_LEAST).to_numpy(zero_copy_only=False)
            file = deal(known, bounds, turn)
            turn += len(file)
            yield pa.RecordBatch.from_arrays(
                [pa.array(file.astype(np.int32)), batch.column(0), pa.array(sizes), made.cast(pa.binary()), inside],
                names=["file", "id", "n", "words", "escapes"],
            )
            del found, words, made, offsets
            give_back()

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in it:
                few = (batch.column(k).to_pylist() for k in range(3))
                for file, doc, n, words, escapes in zip(*few, batch.column(3), batch.column(4)):
                    yield file, doc, n, np.frombuffer(words.as_buffer(), "<u8"), escapes.values.to_numpy()

        stream = rows()
        row = next(stream, None)
        while row:
            file, docs, total = row[0], 0, 0
            path = f"{folder}/part-{file:06d}.s8b"
            with written(path) as out:
                writer = Writer(out)
                while row and row[0] == file:
                    writer.add_words(*row[1:])
                    docs, total = docs + 1, total + row[2]
                    row = next(stream, None)
                writer.close()
            yield pa.RecordBatch.from_pydict(
                {"file": pa.array([file], pa.int32()), "path": [path], "n_docs": [docs], "n_ids": [total]}
            )

    encoded = df.select(F.col(f"`{id_col}`").try_cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        encode, "file int, id long, n long, words binary, escapes array<long>"
    )
    listed = cut(
        encoded.repartitionById(len(bounds) + 1, F.col("file"))
        .sortWithinPartitions("file", "id", "n", "words")
        .mapInArrow(write, "file int, path string, n_docs long, n_ids long")
    )
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return listed.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """The documents of the listed files: id, start (ids of all documents before), n_ids, and ids as 32-bit binary."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for records, ids in read_file(path):
                    sizes = records["ids"].astype(np.int64)
                    starts = start + np.cumsum(sizes) - sizes
                    start += int(sizes.sum())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(records["id"].astype(np.int64), mask=records["known"] == 0),
                            pa.array(starts),
                            pa.array(sizes),
                            pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                        ],
                        names=["id", "start", "n_ids", "ids"],
                    )

    spread = files.select("path", "start").repartition(max(1, files.count()))
    return spread.mapInArrow(read, "id long, start long, n_ids long, ids binary")
